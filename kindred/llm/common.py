"""Helpers shared by the corpus operators: durable tables, skew-safe numbering, components, Arrow text.

Nothing here brings rows to the driver.  What must survive a lost executor is written to the folder that the
session names in ``spark.checkpoint.dir`` and read again, which also cuts the lineage.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII spaces (fixed values).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A local session (tests) that names none gets a new one; on a cluster that would be a folder of one machine, which
    nobody else reads, so it raises there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again (lineage ends there)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with marks behind it what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Bound the Arrow batches that go to Python by bytes, unless the session sets a bound of its own: Spark's batches
    of 10,000 rows, of up to 64 MB, are held by the executor and by each Python worker besides their work."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def first_by_draw(df: DataFrame, draw: Column, order: list, most: int) -> DataFrame:
    """The first ``most`` rows by ``order``, which begins with ``draw``, a number spread evenly over 0 to 1.

    Only rows under a threshold, about twice as many as wanted, go to the task that orders them: a task does not send
    ``most`` rows of its own.  Where the threshold leaves too few, as where draws repeat, all rows are asked again.
    """
    n = df.count()
    if n > 4 * most + 400:
        some = df.filter(draw <= (2 * most + 200) / n)
        if some.count() >= most:
            df = some
    return df.orderBy(*order).limit(most)


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Number rows 0, 1, ... within ``keys`` without putting one key into one task.

    Rows of a key are dealt into hash buckets of ``order``; buckets are counted, the counts are summed up in order,
    and a row's number is its bucket's start plus its place there.  ``rows`` sets the number of buckets, so that a
    bucket stays near ``rows_per_bucket`` rows even if a single key holds every row.
    """
    buckets = max(32, -(-rows // rows_per_bucket))
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = bucketed.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return place.join(starts, [*keys, "_bucket"]).select(*df.columns, (F.col("_start") + F.col("_place") - 1).cast("long").alias(out))


def joined_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, limit: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` (a row for each ``on``), where keys of many rows do not gather in a task.

    ``right`` counts in ``rows`` how many rows of ``left`` a key has.  Keys with more than ``limit`` are few (at most
    the rows of ``left`` over ``limit``, a proven bound) and are broadcast; all others are shuffled.
    """
    new = [c for c in right.columns if c not in (*on, rows)]
    hot = F.broadcast(right.filter(F.col(rows) > limit).select(*on, F.struct(F.lit(True).alias("_is"), *new).alias("_hot")))
    marked = left.join(hot, on, "left")
    found = marked.filter("_hot is not null").select(*left.columns, *[F.col("_hot")[c].alias(c) for c in new])
    rest = marked.filter("_hot is null").select(*left.columns).join(right.filter(F.col(rows) <= limit).select(*on, *new), on, how)
    return found.unionByName(rest.select(*left.columns, *new))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for each id in ``edges(a, b)``; returns ``(id, component)``.

    Alternates the large-star and small-star steps: every round links nodes to the smallest neighbour known, which
    needs logarithmically many rounds and never gathers the graph anywhere.  Each round is written to the shared
    folder, so a lost executor costs one round at most.  Nodes with many edges are joined by broadcast (at most 400).
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
        linked = joined_hot(both, least, ["a"], "rows", max(1000, n // 200))
        if large:
            return linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        to_least = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return to_least.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def sketch(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = sketch(current)
    while True:  # the labels fall with each round, so it ends
        wide = written(star(current, True, seen[0]), "edges")
        step = written(star(wide, False, seen[0]), "edges")
        now = sketch(step)
        removed(current)
        removed(wide)
        current = step
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def first_of_keys(docs: DataFrame, key: Column, dropped: DataFrame, repeated: DataFrame, broadcast_ids: int) -> DataFrame:
    """``docs`` without rows whose key is in ``dropped(_dropped)``, and one row for each key in ``repeated(_repeated)``.

    A row of the caller travels as one struct, so that no name of its columns can clash.
    """
    small = lambda x: F.broadcast(x) if x.count() <= broadcast_ids else x
    left = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(small(dropped), F.col("_key") == F.col("_dropped"), "left_anti")
    if not repeated.limit(1).count():
        return left.select("_row.*")
    again = small(repeated)
    # the least row by a hash of all columns: an aggregate, so that a hot row is reduced before the shuffle
    once = left.join(again, F.col("_key") == F.col("_repeated"), "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return left.join(again, F.col("_key") == F.col("_repeated"), "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text], F.lit(""))


def worker_cache(name: str | None) -> dict:
    """A dictionary that tasks of one kind share within a Python worker, for compiled tables.

    It lives until the worker takes a task of another kind: workers go on from stage to stage, and tables of those before
    would stand beside what the present one needs.
    """
    kept = sys.__dict__.setdefault("_kindred_cache", {})
    for other in [k for k in kept if k != name]:
        del kept[other]
    return kept.setdefault(name, {}) if name else {}


def given_back() -> None:
    """Hand memory that this Python worker no longer uses to the system: workers wait for other tasks after this one,
    and Spark keeps several of them for an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(task, cache: str | None = None):
    """A task's function over batches that hands its memory back at the end, and at the start the tables that tasks of
    other kinds left to this worker; ``cache`` names its own (:func:`worker_cache`)."""

    @functools.wraps(task)
    def whole(batches):
        if any(k != cache for k in sys.__dict__.get("_kindred_cache", {})):
            worker_cache(cache)
            given_back()
        yield from task(batches)
        given_back()

    return whole


# --- Arrow text, inside tasks -------------------------------------------------------------------------------


def pieces_of(batch: pa.RecordBatch, text: str, most_bytes: int) -> list[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about ``most_bytes`` of text (at least a row each)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each row begins (one more at the end); null is empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def readable(column: pa.Array) -> pa.Array:
    """The column itself where its texts are valid UTF-8; else bytes that are not become U+FFFD, text by text."""
    raw, at = flat_text(column)
    begins = raw[at[:-1][np.diff(at) > 0]]
    try:
        raw.tobytes().decode("utf-8")
        if not ((begins & 0xC0) == 0x80).any():  # no text goes on with the end of the one before it
            return column
    except UnicodeDecodeError:
        pass
    return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], column.type)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


class Words:
    """The words of a column of texts: codes into a dictionary, byte spans, and each row's range of words.

    ``lower`` lower-cases A-Z; ``marks`` makes a stop or comma behind a word's last ASCII letter a word of its own.
    """

    def __init__(self, column: pa.Array, lower: bool = False, marks: bool = False):
        raw, at = flat_text(column)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        space = _IS_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        before = np.ones(len(raw) + 1, bool)
        before[1:] = space
        after = np.ones(len(raw) + 1, bool)
        after[:-1] = space
        first, last = ~space & (before[:-1] | edge[:-1]), ~space & (after[1:] | edge[1:])
        if marks and len(raw):
            mark = ((raw == 46) | (raw == 44)) & last & ~first
            mark[1:] &= _IS_LETTER[raw[:-1]]
            first |= mark
            last[:-1] |= mark[1:]
        self.raw, self.at = raw, at
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, at).astype(np.int64)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.row_at))
        self.counts = np.diff(self.row_at)
        offsets = np.zeros(len(self.start) + 1, np.int32 if len(raw) < 2**31 else np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        each = pa.Array.from_buffers(kind, len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])])
        coded = each.dictionary_encode()
        self.codes, self.dictionary = coded.indices.to_numpy(), coded.dictionary


def row_sums(values: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between neighbours of ``row_at`` (0 for an empty range)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[row_at[1:]] - total[row_at[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) on unsigned integers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
