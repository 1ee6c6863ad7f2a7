"""Mix sources to target weights (DataFrame operations only).

Sizes are aggregated per source, targets follow the weights with a limit on repetition, and each document is taken
``floor(rate)`` times plus once more, with a probability equal to the fraction, when its hash-seeded draw is among the
least of the source's documents of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, removed, written

#: Targets are broadcast up to so many sources (a row each); beyond it Spark shuffles and splits skewed sources.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with a ``target`` for each source.

    Sources by code point, null last, take the weights in turn.  A target stops at ``most`` times the source's size;
    the excess goes to the others by weight until none is above.  Written in closed form: in ascending order of
    limit by weight, sources are held at their limit as long as the level ``rest / remaining weight`` exceeds it.
    One row per source, so the windows over all sources see no documents.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    weighted = sizes.withColumn("weight", turn).withColumn("limit", F.col("source_size") * most)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighted.withColumn("level", rest.cast("double") / weight_left)
    held = F.col("limit").cast("double") / F.col("weight") < F.col("level")
    # the first source that is not held sets the level of all that follow
    level = F.first(F.when(~held, F.col("level")), ignorenulls=True).over(Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leveled.select(
        "source", "source_size", F.when(held | level.isNull(), F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target")
    )


def hash_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` only (13 hex digits of MD5)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """A size with all but its three highest bits cleared: sizes of a class differ by less than a quarter."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - 3)).cast("long")
    return size - size % step


def small(table: DataFrame) -> DataFrame:
    """``table`` as a broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def draw_limits(rows: DataFrame, targets: DataFrame, seed: str, steps: int = 1 << 14) -> DataFrame:
    """``source, class, limit``: the greatest draw that earns a document of this source and class one more copy.

    ``rows(source, class, draw)``.  A source's classes stand in order of size, and from a hashed start each class gets
    as many more copies as the running sum of fractions crosses whole numbers there, so that the copies follow the
    target over small and large documents alike and each document's chance is the fraction.  The count of a class
    becomes a limit by counts in steps of the draw and a rank within the one step where the count is reached: no class
    and no source is ranked in one task.
    """
    stepped = rows.withColumn("step", F.floor(F.col("draw") * steps).cast("int"))
    counted = written(stepped.groupBy("source", "class", "step").agg(F.count("*").alias("n")), "draws")
    classes = counted.groupBy("source", "class").agg(F.sum("n").alias("docs"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chance = small(targets).select(F.col("source").alias("s"), (rate - F.floor(rate)).alias("fraction"), hash_draw(F.concat(F.lit("s"), "source"), seed).alias("start"))
    upto = F.sum("docs").over(Window.partitionBy("source").orderBy("class"))
    quota = classes.join(chance, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", upto)
    crossed = lambda docs: F.floor(F.col("start") + F.col("fraction") * docs)
    more = crossed(F.col("upto")) - crossed(F.col("upto") - F.col("docs"))
    quota = written(quota.select(F.col("source").alias("s"), F.col("class").alias("c"), more.alias("more")).filter("more > 0"), "quota")
    here = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    summed = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "class").orderBy("step"))).join(small(quota), here)
    reached = summed.filter("upto - n < more and more <= upto").select("s", "c", F.col("step").alias("at"), (F.col("more") - F.col("upto") + F.col("n")).alias("place"))
    last = stepped.join(small(written(reached, "reached")), here & (F.col("step") == F.col("at")))
    ranked = last.select("source", "class", "draw", "place", F.row_number().over(Window.partitionBy("source", "class").orderBy("draw")).alias("k"))
    limits = written(ranked.filter("k = place").select("source", "class", F.col("draw").alias("limit")), "limits")
    removed(counted)
    return limits


def with_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """``row, size, source_size, target, copies`` with the caller's row as a struct, so that no name can clash; the
    texts are not shuffled.

    ``size`` is the number of words (null and empty texts: 0).  A source without words has target 0 and its documents 0
    copies.  Reruns agree, since draws hash the id; documents that share an id, a source and a size draw alike.  An
    empty table gives no rows, a null source is a source of its own, texts of any length count whole, and other columns
    pass through.  No document is taken over ``most`` times.
    """
    source_of, draw = docs[source], hash_draw(docs[id_col], seed)
    rows = written(docs.select(source_of.alias("source"), word_count(docs[text]).alias("size"), draw.alias("draw")), "rows")
    # partial sums before the shuffle: a hot source costs a row for each task
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, most), "targets")
    limits = draw_limits(rows.select("source", size_class(F.col("size")).alias("class"), "draw"), targets, seed)
    removed(rows)
    own = docs.select(F.struct("*").alias("row"), source_of.alias("own"), word_count(docs[text]).alias("size"), draw.alias("draw"))
    joined = own.join(small(targets), F.col("own").eqNullSafe(F.col("source"))).drop("source")
    joined = joined.join(small(limits), F.col("own").eqNullSafe(F.col("source")) & (size_class(F.col("size")) == F.col("class")), "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.coalesce(F.col("draw") <= F.col("limit"), F.lit(False)).cast("long")
    return joined.select("row", "size", "source_size", "target", (whole + more).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, copies, taken`` (see :func:`with_copies`)."""
    mixed = with_copies(docs, id_col, **options)
    return mixed.select(F.col("row")[id_col].alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mixed = with_copies(docs, id_col, **options).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
