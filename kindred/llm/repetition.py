"""Quality rules: repetition within a document by suffix arrays over its words.

The suffixes of a batch's documents are sorted side by side by prefix doubling (positions whose prefix is already
unique drop out, so the work follows the repeated part), longest common prefixes of neighbours give the repeats that
cannot be extended, and the union of their spans gives the covered fraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces_of, row_sums

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


def repeat_lengths(codes: np.ndarray, row: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each word the length of the longest string starting there that occurs elsewhere in its row (0 under ``least``).

    ``end`` is the first place after the word's row.
    """
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = row.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    span, enough, level = 1, int(np.log2(max(1, least))), 0
    early = rank.copy()  # ranks by as many words as the largest doubled length within ``least``
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    active = order[shared]
    while len(active):
        first = rank[active]
        ahead = active + span
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        key = first * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, first, key = active[by], first[by], key[by]
        m = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = first[1:] != first[:-1]
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[active] = first + np.maximum.accumulate(np.where(fresh, m, 0)) - np.maximum.accumulate(np.where(group, m, 0))
        span, level = span * 2, level + 1
        if level == enough:
            early = rank.copy()
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        active = active[shared]
    if level < enough:
        early, enough = rank, level
    # neighbours in suffix order that agree on that many words
    suffixes = np.argsort(rank, kind="stable")
    near = early[suffixes[:-1]] == early[suffixes[1:]]
    a, b = suffixes[:-1][near], suffixes[1:][near]
    by = np.argsort(b)
    a, b = a[by], b[by]
    common = common_prefixes(memoryview(np.ascontiguousarray(codes, np.int64)), a.tolist(), b.tolist(), np.minimum(end[a] - a, end[b] - b).tolist(), 1 << enough)
    common[common < least] = 0
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def common_prefixes(codes: memoryview, a: list[int], b: list[int], most: list[int], known: int) -> np.ndarray:
    """Number of words that the suffixes at ``a`` and ``b`` (neighbours in suffix order, ``b`` rising, both at least
    ``known`` words alike unless they end before) have in common, at most ``most``.

    In text order a suffix shares at least all but one word of what the suffix before it shares, so comparisons add up
    to the words in repeats.
    """
    out, last, h = np.zeros(len(a), np.int64), -2, 0
    for k, (x, y, room) in enumerate(zip(a, b, most)):
        h = h - 1 if y == last + 1 and h > known else known
        h = min(h, room)
        while h < room and codes[x + h] == codes[y + h]:
            h += 1
        out[k], last = h, y
    return out


def covered_by(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(texts: pa.Array, least: int) -> dict[str, np.ndarray]:
    """Counts and repetition of each text of a column (null: none)."""
    words = Words(texts)
    raw, at, n = words.raw, words.at, len(words.start)
    in_word = np.zeros(len(raw) + 1, np.int8)
    in_word[words.start] += 1
    in_word[words.end] -= 1
    in_word = np.cumsum(in_word[:-1]) > 0
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": words.counts, "word_chars": row_sums((in_word & ((raw & 0xC0) != 0x80)).astype(np.int64), at), "n_symbols": row_sums(symbol[raw].astype(np.int64), at)}
    # lines begin with a text or after \n, and end at the next \n or with the text
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(at[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    line_row = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, starts)], at[line_row + 1])
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, line_row = starts[with_word], ends[with_word], line_row[with_word]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[np.cumsum(inside[:-1]) > 0]))])
    line_code = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    different = np.unique(line_row * (len(starts) + 1) + line_code) // (len(starts) + 1)
    rows = len(at) - 1
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(different, minlength=rows)
    end = words.row_at[1:][words.row] if n else np.zeros(0, np.int64)
    codes = words.codes.astype(np.int64)
    # three-word windows found twice or more
    window = np.flatnonzero(np.arange(n) + 2 < end)
    key = mix(mix(mix(codes[window] + 1) + codes[window + 1].astype(np.uint64)) + codes[window + 2].astype(np.uint64)) ^ mix(words.row[window] + (1 << 40)) if len(window) else np.zeros(0, np.uint64)
    by = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[by][1:] == key[by][:-1]
    again = window[by[same[:-1] | same[1:]]]
    out["n_repeat_words"] = row_sums(covered_by(again, np.full(len(again), 3), n).astype(np.int64), words.row_at)
    longest = repeat_lengths(codes, words.row, end, least)
    begins = np.flatnonzero(longest)
    out["n_covered_words"] = row_sums(covered_by(begins, longest[begins], n).astype(np.int64), words.row_at)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, words.row[begins], longest[begins])
    out["longest_repeat"] = most
    # repeats that cannot be extended to the left
    previous = np.zeros(n, np.int64)
    previous[1:] = np.where(words.row[1:] == words.row[:-1], longest[:-1], 0) if n else 0
    out["n_repeats"] = row_sums(((longest > 0) & (previous <= longest)).astype(np.int64), words.row_at)
    return out


def repetition(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: int = 10,
    most_covered: float = 0.5,
    most_longest: int = 50,
    piece_bytes: int = 3 << 20,
) -> DataFrame:
    """One row per row of ``docs`` with counts, repeats and a verdict.

    Columns: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, longest_repeat,
    n_repeats, repetitive``.  A repeat is a string of at least ``least`` words that occurs twice or more in the text
    (occurrences may overlap); a document is repetitive when repeats cover more than ``most_covered`` of its words
    or the longest has more than ``most_longest`` words.  Null and empty texts count nothing and are not repetitive;
    texts of any length are taken whole; repeated rows give repeated results; other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_repeats"]

    def measured(batches):
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                got = measures(piece.column("t"), least)
                yield pa.RecordBatch.from_arrays([piece.column("i"), *[pa.array(got[k].astype(np.int64)) for k in names]], ["i", *names])

    source = docs.select(docs[id_col].alias("i"), docs[text].alias("t"))
    kind = source.schema["i"].dataType.simpleString()
    out = source.mapInArrow(measured, f"i {kind}, " + ", ".join(f"{k} long" for k in names))
    repetitive = (F.col("n_covered_words") > most_covered * F.col("n_words")) | (F.col("longest_repeat") > most_longest)
    return out.select(F.col("i").alias(id_col), *names, repetitive.alias("repetitive"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", least_words: int = 50, most_repeated: int = 50, **options) -> DataFrame:
    """:func:`repetition` with ``base_failed`` (too short, or more than ``most_repeated`` % of words in repeated
    three-word windows) and ``kept``: neither base rule nor repeats object.  An empty table gives no rows."""
    rules = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return repetition(docs, id_col, **options).withColumn("base_failed", rules).withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive"))
