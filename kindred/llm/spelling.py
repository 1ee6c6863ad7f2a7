"""Spelling variants: words one edit apart, grouped under their commonest form.

A vocabulary in sorted order is a tree: neighbours share the prefix that their longest common prefix (LCP) tells.
Words look for their near words by walking that list with a banded edit matrix of three cells a row: a row is computed
once for all words that share a prefix, ranges whose row already exceeds one edit are skipped, and a range is cut into
the next letters' ranges where LCPs are no longer than the depth.  All words of a block walk at once, level by level.

Of two words one edit apart, an edit in the second half leaves the first half of the shorter one a common prefix, one in
the first half leaves the second half a common suffix.  So words meet only those they share a half with: keyed by
(length of the shorter, half), suffixes reversed, which is what Spark shuffles.  A key with many words is dealt over
several tasks: each takes a share of the words as queries and all as the list.  Pairs never leave a task, only a word's
count of near words and its best one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat_text, joined_hot, partitions, removed, tidy, written

RUN_PATTERN = r"[A-Za-zÀ-ÿ]{%d,}"
#: Bytes before a code: the length of a list's shorter words and its side.
HEADER = 5
#: Long lists are broadcast up to so many (a row each).
BROADCAST_ROWS = 100_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = 5, least_n: int = 3, thinned: int | None = None) -> DataFrame:
    """``word, n`` of runs of Latin letters, A-Z lower-cased, of at least ``least_chars`` code points and ``least_n``
    occurrences.

    With ``thinned``, a run loses the code point ``h % length`` where that number divides ``h``, the CRC-32 of
    ``<id>:<run>`` (planted misspellings).  Counts are partial before the shuffle, so a hot word is a row for each task.
    """
    runs = F.regexp_extract_all(docs[text], F.lit(RUN_PATTERN % least_chars), F.lit(0))
    each = docs.select(docs[id_col].alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", CAPITALS, SMALL)
    if thinned:
        each = each.select("id", word.alias("run"))
        h = F.crc32(F.encode(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % thinned == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = each.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def met(words: DataFrame) -> DataFrame:
    """``code, head, n``: each word in the four lists where it may meet a near one.

    ``code`` is the length of the list's shorter words (four bytes), its side, and a byte for each code point, reversed
    in lists of suffixes; ``head`` is as much of it as the list's words share.
    """
    lists = []
    for size in (F.length("word"), F.length("word") - 1):
        half = F.floor(size / 2).cast("int")
        for side, said, shared in ((0, F.col("word"), half), (1, F.reverse("word"), size - half)):
            mark = F.unhex(F.concat(F.lpad(F.hex(size), 8, "0"), F.lit(f"0{side}")))
            code = F.concat(mark, F.encode(said, "ISO-8859-1"))
            lists.append(F.struct(code.alias("code"), code.substr(F.lit(1), shared + HEADER).alias("head")))
    return words.select("n", F.explode(F.array(*lists)).alias("x")).select("x.*", "n")


def dealt(lists: DataFrame, most: int) -> DataFrame:
    """``lists`` with ``cell, asks, listed``: lists of more than ``most`` words are cut into blocks, and every block of
    queries meets every block of the list in a cell of its own."""
    sizes = written(lists.groupBy("head").agg(F.count("*").alias("rows")).filter(F.col("rows") > most), "long_lists")
    cut = sizes.select("head", "rows", F.ceil(F.col("rows") / most).cast("int").alias("blocks"))
    cut = F.broadcast(cut) if sizes.count() <= BROADCAST_ROWS else cut
    own, k = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda q, x: (q * F.col("blocks") + x).alias("cell")
    asking = F.transform(k, lambda x: F.struct(cell(F.col("own"), x), F.lit(True).alias("asks"), (x == F.col("own")).alias("listed")))
    listed = F.transform(F.filter(k, lambda x: x != F.col("own")), lambda x: F.struct(cell(x, F.col("own")), F.lit(False).alias("asks"), F.lit(True).alias("listed")))
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("asks"), F.lit(True).alias("listed")))
    cells = lists.join(cut, "head", "left").withColumn("own", own).withColumn("x", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(asking, listed))))
    return cells.select("head", "code", "n", "x.*")


class Sorted:
    """A sorted list of byte strings, as one array with starts and lengths, and the LCPs of neighbours."""

    def __init__(self, codes: pa.Array):
        self.raw, at = flat_text(codes)
        self.start, self.size = at[:-1], np.diff(at)
        self.lcp = np.zeros(len(codes) + 1, np.int64)
        open_, depth = np.arange(1, len(codes)), 0
        while len(open_):
            open_ = open_[np.minimum(self.size[open_], self.size[open_ - 1]) > depth]
            open_ = open_[self.raw[self.start[open_] + depth] == self.raw[self.start[open_ - 1] + depth]]
            depth += 1
            self.lcp[open_] = depth

    def letter(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """The byte at ``depth`` of each row, 0 behind its end."""
        inside = depth < self.size[rows]
        return np.where(inside, self.raw[np.where(inside, self.start[rows] + depth, 0)], 0)

    def same_tail(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether two rows agree on their last ``n`` bytes."""
        same, last_a, last_b = np.ones(len(a), bool), self.start[a] + self.size[a] - 1, self.start[b] + self.size[b] - 1
        for k in range(int(n.max(initial=0))):
            look = np.flatnonzero(same & (k < n))
            same[look] = self.raw[last_a[look] - k] == self.raw[last_b[look] - k]
        return same


def near_rows(words: Sorted, asked: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``query, found``: rows one edit from the rows ``asked``, among ``low <= row < high``, which share the query's first
    ``depth`` bytes.

    A state is a query, a range that shares a prefix, and three cells of the edit matrix: the costs of turning that
    prefix into the query's first depth - 1, depth and depth + 1 bytes.
    """
    queries, found = [], []
    q, lo, hi, cost = (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 3), np.int8),)
    for d in range(int(depth.min(initial=0)), int(words.size.max(initial=0)) + 1):
        new = np.flatnonzero(depth == d)
        q, lo, hi = np.append(q, asked[new]), np.append(lo, low[new]), np.append(hi, high[new])
        cost = np.concatenate([cost, np.tile(np.array([1, 0, 1], np.int8), (len(new), 1))])
        if not len(q):
            continue
        # a word that ends here stands first in its range
        ends, over = words.size[lo] == d, words.size[q] - d
        hit = np.flatnonzero(ends & (np.abs(over) <= 1))
        hit = hit[cost[hit, over[hit] + 1] == 1]
        queries.append(q[hit])
        found.append(lo[hit])
        lo = lo + ends
        # ranges of the next letter begin where a row's LCP with the row before is no longer than d
        cuts = np.flatnonzero(words.lcp <= d)
        first_cut, last_cut = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="left")
        n = np.where(lo < hi, last_cut - first_cut + 1, 0)
        owner = np.repeat(np.arange(len(q)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        cut = first_cut[owner] + place
        first = np.where(place == 0, lo[owner], cuts[cut - 1])
        last = np.where(place == n[owner] - 1, hi[owner], cuts[np.minimum(cut, len(cuts) - 1)])
        q, old, c = q[owner], cost[owner], words.letter(first, d)
        cost = np.empty((len(q), 3), np.int8)
        cost[:, 0] = np.minimum(old[:, 0] + (words.letter(q, d - 1) != c), old[:, 1] + 1)
        cost[:, 1] = np.minimum(np.minimum(old[:, 1] + (words.letter(q, d) != c), old[:, 2] + 1), cost[:, 0] + 1)
        cost[:, 2] = np.minimum(old[:, 2] + (words.letter(q, d + 1) != c), cost[:, 1] + 1)
        go = cost.min(axis=1) <= 1  # ranges beyond one edit are skipped
        q, lo, hi, cost = q[go], first[go], last[go], cost[go]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(queries), join(found)


def near_of(table: pa.Table, states: int = 400_000) -> pa.RecordBatch | None:
    """``word, n_near, best_n, best`` of the asking rows of whole lists, sorted by list and code."""
    words, n = Sorted(table.column("code").combine_chunks()), table.column("n").to_numpy()
    asks, listed = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "listed"))
    heads = table.column("head").combine_chunks()
    cell = table.column("cell").to_numpy()
    head_size = np.diff(flat_text(heads)[1])
    # a list ends where the row before shares less than the head, or the cell changes
    begins = np.flatnonzero(np.append(True, (words.lcp[1:-1] < head_size[1:]) | (head_size[1:] != head_size[:-1]) | (cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(begins, len(n)))
    low, high = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    asked = np.flatnonzero(asks & (high - low > 1))
    block = np.cumsum(np.minimum(high - low, 1000)[asked]) // states
    queries, found = [], []
    for part in np.split(asked, np.flatnonzero(np.diff(block)) + 1):
        a, b = near_rows(words, part, low[part], high[part], head_size[part])
        shorter, side = words.raw[words.start[a, None] + np.arange(4)].astype(np.int64) @ (256 ** np.arange(3, -1, -1)), words.raw[words.start[a] + 4]
        right = listed[b] & (np.minimum(words.size[a], words.size[b]) == shorter + HEADER)
        # pairs that share the first half too have met in its list
        right &= (side == 0) | ~words.same_tail(a, b, np.where(right & (side == 1), shorter // 2, 0))
        queries.append(a[right])
        found.append(b[right])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (queries, found))
    if not len(a):
        return None

    def said(row: int) -> str:
        code = words.raw[words.start[row] + HEADER : words.start[row] + words.size[row]]
        return (code[::-1] if words.raw[words.start[row] + 4] else code).tobytes().decode("latin-1")

    rows = np.unique(b)
    texts = [said(r) for r in rows.tolist()]
    rank = np.empty(len(rows), np.int64)
    rank[np.argsort(np.array(texts, object), kind="stable")] = np.arange(len(rows))
    at = np.searchsorted(rows, b)
    order = np.lexsort((rank[at], -n[b], a))
    first = np.flatnonzero(np.append(True, np.diff(a[order]) > 0))
    best = order[first]
    near = np.diff(np.append(first, len(order)))
    columns = [pa.array([said(r) for r in a[best].tolist()], pa.string()), pa.array(near, pa.int64()), pa.array(n[b[best]], pa.int64()), pa.array([texts[k] for k in at[best].tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, most: int = 50_000, chunk: int = 100_000) -> DataFrame:
    """``word, n_near, best_n, best`` of the words ``(word, n)`` that have a near one: how many, and of those with the
    largest n the first in code-point order."""

    @tidy
    def walked(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < chunk:
                continue
            table = pa.Table.from_batches(held)
            # the last list may go on in the next batch
            same = pc.and_(pc.equal(table.column("head"), table.column("head")[-1]), pc.equal(table.column("cell"), table.column("cell")[-1]))
            whole = table.num_rows - pc.sum(same).as_py()
            held = table.slice(whole).to_batches()
            if whole and (out := near_of(table.slice(0, whole))) is not None:
                yield out
        if held and (out := near_of(pa.Table.from_batches(held))) is not None:
            yield out

    cells = dealt(met(words), most).repartition(partitions(words.sparkSession), "head", "cell").sortWithinPartitions("head", "cell", "code")
    found = cells.mapInArrow(walked, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, form, root``: from each word follow forms to the last one.

    Every round a word takes its root's root, so that rounds are as many as the logarithm of the longest way; only
    words that have a form travel.
    """
    current = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        used = current.groupBy(F.col("root").alias("at")).agg(F.count("*").alias("rows"))
        further = written(used.join(current.select(F.col("word").alias("at"), F.col("root").alias("next")), "at"), "further")
        if not further.limit(1).count():
            return forms.join(current, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"))
        moved = joined_hot(current.withColumn("at", F.col("root")), further, ["at"], "rows", 10_000, "left")
        step = written(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
        removed(current)
        removed(further)
        current = step


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = 5, least_n: int = 3, times: int = 2, thinned: int | None = None, most: int = 50_000) -> DataFrame:
    """One row per word of the vocabulary of ``docs``: ``word, form, root, n, n_near, form_n``.

    Words are near if exactly one code point is inserted, deleted or replaced.  A word's form is its near word of largest
    ``n`` (ties: the first in code-point order) if that is at least ``times`` the word's own, else null with a null
    ``form_n``; ``root`` follows forms to the last, and is the word itself where there is none.  As ``n`` grows along
    forms, they end.

    Null and empty texts have no words; repeated rows count as often as they stand there; a null id counts as an empty
    one; texts and words of any length are taken whole; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    words = written(vocabulary(docs, id_col, text, least_chars, least_n, thinned), "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    named = F.col("best_n") >= times * F.col("n")
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("best")).alias("form"), F.when(named, F.col("best_n")).alias("form_n"))
    forms = written(forms, "forms")
    roots = with_roots(forms.select("word", "form")).select("word", "root")
    return forms.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
