"""Pack token sequences into windows by non-negative least squares over length combinations.

Documents are tokenised once; whole windows stand alone, and what is left of each document (its tail) is packed.
Shallow combinations of up to three tail lengths (in bins) that fill a window are enumerated, repeat counts that
best reproduce the histogram of tails are solved by non-negative least squares and rounded down, and the residual is
packed greedily.  Tails for which no good partner is left are cut into blocks, which fill windows exactly.  The
planner sees a histogram (at most as many rows as a window has tokens); pieces are dealt to the plan's places by
their number within their bin, counted in salted buckets.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bounded_batches, ordinals, pieces_of, tidy, worker_cache, written

# --- tokens -------------------------------------------------------------------------------------------------


class WordTokens:
    """Token ids of words by the tokenizers library, kept for words seen before (as little-endian 32-bit bytes)."""

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre, steps = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if pre is None or steps is None or pre.pre_tokenize_str("a b")[1][0] != "b":
            raise ValueError("only tokenizers that drop white space tokenise word by word")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.lowers = steps.normalize_str("AZ") == "az"
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        made = dict(zip(new, self.encoded(new)))
        self.known.update((w, t) for w, t in made.items() if len(w) <= 64)
        known = self.known
        return [made[w] if w in made else known[w] for w in words]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Words of Latin letters, at most with a stop or comma behind, are encoded a thousand at a time in a line:
        each gives one end-of-word token for the letters and one for the mark."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out: list[bytes | None] = [None] * len(texts)
        plain, parts, rest = [], [], []
        for k, t in enumerate(texts):
            head = t[:-1] if t[-1] in ".," else t
            if head.isalpha() and max(head) < "İ":
                plain.append(k)
                parts.append(2 if len(head) < len(t) else 1)
            else:
                rest.append(k)
        for a in range(0, len(plain), 1000):
            some, ends = plain[a : a + 1000], np.cumsum(parts[a : a + 1000])
            ids = np.array(self.tokenizer.encode(" ".join([texts[k] for k in some]), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.ends[ids])
            if len(at) != ends[-1] or not len(at):
                rest.extend(some)
                continue
            cuts = [0, *(at[ends - 1] + 1).tolist()]
            raw = ids.tobytes()
            for k, x, y in zip(some, cuts, cuts[1:]):
                out[k] = raw[4 * x : 4 * y]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out


def token_rows(texts: pa.Array, tokens: WordTokens, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a column of texts, each text's ids followed by ``last``; and where each text begins."""
    # the tokenizer lower-cases and parts a word from the mark behind it, so fewer different words need its work
    special = pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py()
    words = Words(texts, lower=tokens.lowers and not special, marks=True)
    each = tokens.of(words.dictionary.to_pylist())
    sizes = np.fromiter(map(len, each), np.int32, len(each)) // 4
    flat = np.frombuffer(b"".join(each), "<u4")
    begin = (np.cumsum(sizes) - sizes).astype(np.int32)
    per_word = sizes[words.codes]
    total = np.zeros(len(per_word) + 1, np.int32)
    np.cumsum(per_word, out=total[1:])
    at = total[words.row_at].astype(np.int64)
    ids = flat[np.repeat(begin[words.codes] - total[:-1], per_word) + np.arange(total[-1], dtype=np.int32)] if total[-1] else np.zeros(0, "<u4")
    return np.insert(ids, at[1:], np.uint32(last)).astype("<u4"), at + np.arange(len(at))


# --- the plan -----------------------------------------------------------------------------------------------


def nonnegative_least_squares(shapes: list[tuple[int, ...]], target: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Repeat counts x >= 0 of shapes that come nearest to the target histogram in least squares.

    Accelerated projected gradients; a shape's column of the (sparse) matrix has a one for each bin it holds.
    """
    members = np.array([(*s, *[0] * (3 - len(s))) for s in shapes])
    used = members > 0
    wanted = np.concatenate([[0.0], target])

    def mixed(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(wanted))
        for k in range(3):
            total += np.bincount(members[:, k], weights=x * used[:, k], minlength=len(wanted))
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return (r[members] * used).sum(axis=1)

    v = np.ones(len(shapes))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(mixed(v))
        largest = float(np.linalg.norm(v))
        v /= largest
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(mixed(y) - wanted) / (1.05 * largest))
        if (new - x) @ (y - new) > 0:  # the momentum points uphill: start it afresh
            t = 1.0
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def combinations(bins: int) -> list[tuple[int, ...]]:
    """Multisets of one to three bin numbers that sum up to ``bins``."""
    pairs = [(i, bins - i) for i in range(1, bins // 2 + 1)]
    triples = [(i, j, bins - i - j) for i in range(1, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    return [(bins,), *pairs, *triples]


def greedy(counts: np.ndarray, sizes: np.ndarray, window: int, least_fill: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns (indices of ``sizes``, repeats) that fill a window largest first, and the counts left over.

    A pattern is repeated as often as its counts allow, so the number of patterns follows the number of sizes.  One
    that fills less than ``least_fill`` of the window gives its largest size up.
    """
    left, open_, out = counts.astype(np.int64).copy(), counts > 0, []
    by_size = np.argsort(-sizes, kind="stable").tolist()
    while True:
        room, use = window, {}
        for k in by_size:
            if (open_[k] or use) and left[k] > 0 and sizes[k] <= room:
                use[k] = min(int(left[k]), int(room // sizes[k]))
                room -= use[k] * int(sizes[k])
        if not use:
            return out, left
        if window - room < least_fill * window:
            open_[next(iter(use))] = False
            continue
        times = min(int(left[k]) // u for k, u in use.items())
        for k, u in use.items():
            left[k] -= times * u
        out.append((tuple(k for k, u in use.items() for _ in range(u)), times))


def pack_plan(histogram: dict[int, int], window: int, grain: int, least_fill: float = 0.985) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for tails: rows (bin, first, last, slot, sequence): the bin's tails first..last-1 go to that slot of
    sequences from ``sequence`` on.  Tails beyond a bin's last row are to be cut.  Also: the number of sequences.
    """
    bins = window // grain
    counts = np.zeros(bins + 1, np.int64)
    for length, n in histogram.items():
        counts[-(-length // grain)] += n
    patterns: list[tuple[tuple[int, ...], int]] = []
    if counts.sum():
        shapes = combinations(bins)
        solved = nonnegative_least_squares(shapes, counts[1:].astype(float))
        left = counts.copy()
        for k in np.argsort(-solved, kind="stable"):
            times = int(solved[k] + 0.5)
            shape = shapes[k]
            times = min([times, *(int(left[b]) // shape.count(b) for b in shape)])
            if times > 0:
                patterns.append((shape, times))
                for b in shape:
                    left[b] -= times
        more, _ = greedy(left[1:], np.arange(1, bins + 1) * grain, window, least_fill)
        patterns += [(tuple(k + 1 for k in shape), times) for shape, times in more]
    return places(patterns)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, times in patterns:
        for slot, b in enumerate(shape):
            first = taken.get(b, 0)
            rows.append((int(b), first, first + times, slot, sequence))
            taken[b] = first + times
        sequence += times
    return rows, sequence


# --- the operator -------------------------------------------------------------------------------------------


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text: str, last: int, window: int, block: int, piece_bytes: int) -> DataFrame:
    """Whole windows and the tail of each document: ``i, start, length, crc, doc_tokens, blocks`` (checksums of the
    tail's blocks)."""

    name = f"packing:{tokenizer}"

    @functools.partial(tidy, cache=name)
    def cut(batches):
        own = worker_cache(name)
        tokens = own.get("tokens") or own.setdefault("tokens", WordTokens(tokenizer))
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                ids, at = token_rows(piece.column("t"), tokens, last)
                raw = memoryview(ids.tobytes())
                names = piece.column("i")
                rows: list[list] = [[], [], [], [], [], []]
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    for x in range(a, b, window):
                        y = min(x + window, b)
                        blocks = None if y - x == window else [zlib.crc32(raw[4 * z : 4 * min(z + block, y)]) for z in range(x, y, block)]
                        for column, value in zip(rows, (k, x - a, y - x, zlib.crc32(raw[4 * x : 4 * y]), b - a, blocks)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows[0], pa.int64())), *[pa.array(r, pa.int64()) for r in rows[1:5]], pa.array(rows[5], pa.list_(pa.int64()))],
                    ["i", "start", "length", "crc", "doc_tokens", "blocks"],
                )

    source = docs.select(docs[id_col].alias("i"), docs[text].alias("t"))
    kind = source.schema["i"].dataType.simpleString()
    return source.mapInArrow(cut, f"i {kind}, start long, length long, crc long, doc_tokens long, blocks array<long>")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    last: int = 1,
    grain: int = 8,
    block: int = 256,
    piece_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its whole text's ids (bytes that are not UTF-8 read as U+FFFD) followed by ``last``; a null or empty
    text has that id alone.  Every id lies in one
    piece, a sequence holds at most ``window`` ids, and offsets leave no gaps.  Documents that share an id are
    packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if window % block or window % grain:
        raise ValueError("grain and block must divide the window")
    pieces = written(tokenised(docs, tokenizer, id_col, text, last, window, block, piece_bytes), "pieces")
    rows = pieces.count()
    tails = pieces.filter(F.col("length") < window).withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r[0]: r[1] for r in tails.groupBy("length").count().collect()}  # at most a row per length
    plan, planned = pack_plan(histogram, window, grain)
    schema = "bin int, _first long, _last long, slot int, _sequence long"
    order = ["i", "start", "crc", "doc_tokens"]
    numbered = written(ordinals(tails, ["bin"], order, "_n", rows), "numbered")
    taken = spark.createDataFrame([(b, max(r[2] for r in plan if r[0] == b)) for b in {r[0] for r in plan}] or [(-1, 0)], "bin int, _taken long")
    marked = numbered.join(F.broadcast(taken), "bin", "left")
    whole = marked.filter(F.col("_n") < F.col("_taken")).join(F.broadcast(spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], schema)), "bin")
    whole = whole.filter((F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_last"))).withColumn("sequence_id", F.col("_sequence") + F.col("_n") - F.col("_first"))
    columns = ["i", "start", "length", "crc", "doc_tokens", "sequence_id", "slot"]
    # the rest is cut: full blocks fill windows in order, what is under a block is packed greedily
    cut = marked.filter(F.col("_taken").isNull() | (F.col("_n") >= F.col("_taken"))).select("i", "start", "length", "doc_tokens", F.posexplode("blocks").alias("_k", "crc"))
    cut = written(cut.select("i", (F.col("start") + F.col("_k") * block).alias("start"), F.least(F.lit(block), F.col("length") - F.col("_k") * block).cast("long").alias("length"), "crc", "doc_tokens"), "cut")
    per = window // block
    full = ordinals(cut.filter(F.col("length") == block).withColumn("_all", F.lit(0)), ["_all"], order, "_n", rows)
    full = full.withColumn("sequence_id", F.floor(F.col("_n") / per) + planned).withColumn("slot", (F.col("_n") % per).cast("int"))
    small = {r[0]: r[1] for r in cut.filter(F.col("length") < block).groupBy("length").count().collect()}
    n_full = cut.filter(F.col("length") == block).count()
    lengths = sorted(small)
    patterns, _ = greedy(np.array([small[x] for x in lengths], np.int64), np.array(lengths, np.int64), window, 0.0)
    base = planned + -(-n_full // per)
    rest_plan, packed = places([(tuple(lengths[k] for k in shape), times) for shape, times in patterns])
    rest_plan = [(b, f, x, s, q + base) for b, f, x, s, q in rest_plan]
    rest = ordinals(cut.filter(F.col("length") < block).withColumn("bin", F.col("length").cast("int")), ["bin"], order, "_n", rows)
    rest = rest.join(F.broadcast(spark.createDataFrame(rest_plan or [(-1, 0, 0, 0, 0)], schema)), "bin")
    rest = rest.filter((F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_last"))).withColumn("sequence_id", F.col("_sequence") + F.col("_n") - F.col("_first"))
    shared = whole.select(*columns).union(full.select(*columns)).union(rest.select(*columns))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
    alone = ordinals(pieces.filter(F.col("length") == window).withColumn("_all", F.lit(0)), ["_all"], order, "_n", rows)
    alone = alone.withColumn("sequence_id", F.col("_n") + base + packed).withColumn("offset", F.lit(0).cast("long"))
    out = ["i", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    return shared.select(*out).union(alone.select(*out)).withColumnRenamed("i", id_col).withColumnRenamed("crc", "ids_crc32")
