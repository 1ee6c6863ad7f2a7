"""Shards of near equal bytes: best-fit decreasing over groups that must stay together.

Sizes of groups fall into classes (12 significant bits; at most about 110,000 classes whatever the input), so the
planner sees classes with their number of groups and bytes, never the groups.  It takes classes by falling size, and
each class enters the tightest bin with room through an ordered tree of remaining capacities.  A class's groups are
dealt to its bins by their number within the class, counted in salted buckets.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordinals, written


def size_class(size):
    """A size with all but its 12 highest bits cleared."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - 12)).cast("long")
    return size - size % step


class RemainingCapacities:
    """Bins ordered by remaining capacity: a balanced order with search, removal and insertion by capacity."""

    def __init__(self, bins: int, capacity: float):
        self.order = [(capacity, b) for b in range(bins)]

    def tightest(self, size: float) -> tuple[float, int] | None:
        """Take out the bin with the least room that still holds ``size``; None if none has it."""
        k = bisect.bisect_left(self.order, (size, -1))
        return self.order.pop(k) if k < len(self.order) else None

    def roomiest(self) -> tuple[float, int]:
        return self.order.pop()

    def put(self, room: float, number: int) -> None:
        bisect.insort(self.order, (room, number))


def best_fit_decreasing(classes: list[tuple[int, int, int]], bins: int, capacity: float) -> list[tuple[int, int, int, int]]:
    """``classes`` of (class, groups, bytes) to rows (class, first, last, bin): groups numbered first..last-1 go there.

    A class's groups count with their mean size.  Where no bin has room for one more, the roomiest bin takes groups
    one share at a time, so that the bins stay near equal.
    """
    tree, out = RemainingCapacities(bins, capacity), []
    for name, groups, size in sorted(classes, reverse=True):
        each, at = size / groups, 0
        while at < groups:
            found = tree.tightest(each) if each > 0 else tree.roomiest()
            if found:
                room, b = found
                take = min(groups - at, max(1, int(room // each))) if each > 0 else groups - at
            else:
                room, b = tree.roomiest()
                take = min(groups - at, max(1, -(-(groups - at) // bins)))
            out.append((name, at, at + take, b))
            tree.put(room - take * each, b)
            at += take
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 8, slot_rows: int = 1_000_000, hot_share: int = 2_000) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length plus one; equal texts (null as none, that is empty) form a group that never
    splits, so a group above the capacity fills a shard alone.  ``slot`` numbers a shard's rows from 0 without gaps,
    by id in hashed buckets.  Repeated ids are rows of their own; an empty table gives no rows; other columns are
    ignored.  Texts are read once and never shuffled: a group is known by SHA-256 and length.
    """
    content = F.encode(F.coalesce(docs[text], F.lit("")), "UTF-8")
    sized = written(
        docs.select(
            docs[id_col].cast("long").alias("_id"), (F.length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.sha2(content, 256).alias("_key")
        ),
        "sized",
    )
    rows = sized.count()
    groups = sized.groupBy("_key").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    groups = written(groups.withColumn("_class", size_class(F.col("_bytes"))), "groups")
    # bounded by the number of classes, not of groups
    classes = [tuple(r) for r in groups.groupBy("_class").agg(F.count("*"), F.sum("_bytes")).collect()]
    total = sum(c[2] for c in classes)
    plan = best_fit_decreasing(classes, shards, -(-total // shards))
    spark = docs.sparkSession
    ranges = spark.createDataFrame(plan, "_class long, _first long, _last long, shard int") if plan else spark.createDataFrame([], "_class long, _first long, _last long, shard int")
    numbered = ordinals(groups, ["_class"], ["_key"], "_ordinal", rows)
    at = F.col("_ordinal").between(F.col("_first"), F.col("_last") - 1)
    placed = numbered.join(F.broadcast(ranges), "_class").filter(at).select("_key", "_n", "shard")
    # at most hot_share keys can have more than rows / hot_share rows: a proven bound for the broadcast
    limit = max(256, rows // hot_share)
    hot = F.broadcast(placed.filter(F.col("_n") > limit).select("_key", F.col("shard").alias("_hot_shard")))
    marked = sized.join(hot, "_key", "left")
    dealt = marked.filter("_hot_shard is not null").withColumn("shard", F.col("_hot_shard")).select("_id", "size", "text_crc32", "shard").union(
        marked.filter("_hot_shard is null").join(placed.filter(F.col("_n") <= limit), "_key").select("_id", "size", "text_crc32", "shard")
    )
    slotted = ordinals(written(dealt, "dealt"), ["shard"], ["_id", "text_crc32", "size"], "slot", rows, slot_rows)
    return slotted.withColumnRenamed("_id", id_col)
