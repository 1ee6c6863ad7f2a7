"""A manifest of a dataset as a tree of hashes, with a proof for every row (DataFrame operations only).

Rows are leaves; a source's leaves are folded sixteen by sixteen to its subroot, and subroots likewise to the root.
On each level lag and lead columns of fixed offsets, masked by a node's slot and the length of its run, give a node
its siblings, and the rows of first children hash their parents.

Places within a source come from a range partitioning by (source, id): a row's place is its place in its partition and
the rows of its source in earlier partitions, so that no source gathers in a task.  Windows see blocks of whole runs,
``BLOCK`` nodes at most, for the same reason.  Texts are read once, where leaves are hashed, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, partitions, written

FAN = 16
BLOCK = FAN**3
#: Starts of ranges are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
WIDTH = 64


def sha(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts (UTF-8)."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: for each field ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    said = [f.cast("string") for f in fields]
    return sha(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes(grp, ...)``, written, with the place ``i`` of each row in its group by ``order`` and the group's size ``n``.

    Rows are range-partitioned and sorted; of a group the rows before a partition are added up from counts, a row for
    each group and partition.
    """
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    table = written(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = table.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("grp", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("grp")).alias("n"))
    starts = written(starts, f"{name}_starts")
    met = table.withColumn("_part", part).join(small(starts), ["grp", "_part"])
    return met.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).select(*nodes.columns, "i", "n")


def with_siblings(nodes: DataFrame, node: str = "node") -> DataFrame:
    """``nodes(grp, i, n, node)`` with ``left`` and ``right``: the hashes of the others of a node's run, in order."""
    slot, run = F.col("i") % FAN, F.least(F.lit(FAN), F.col("n") - F.col("i") + F.col("i") % FAN)
    order = Window.partitionBy("grp", F.floor(F.col("i") / BLOCK)).orderBy("i")
    left = [F.when(slot >= d, F.lag(node, d).over(order)) for d in range(FAN - 1, 0, -1)]
    right = [F.when(slot + d < run, F.lead(node, d).over(order)) for d in range(1, FAN)]
    return nodes.withColumn("left", F.concat_ws("", *left)).withColumn("right", F.concat_ws("", *right))


def parents(nodes: DataFrame, node: str = "node") -> DataFrame:
    """The level above ``nodes(grp, i, n, node)``: first children hash their run; a group of one node is done."""
    slot, run = F.col("i") % FAN, F.least(F.lit(FAN), F.col("n") - F.col("i") + F.col("i") % FAN)
    order = Window.partitionBy("grp", F.floor(F.col("i") / BLOCK)).orderBy("i")
    rest = [F.when(slot + d < run, F.lead(node, d).over(order)) for d in range(1, FAN)]
    first = nodes.filter("n > 1").withColumn("_up", F.sha2(F.concat_ws("", node, *rest), 256)).filter(slot == 0)
    return first.select("grp", F.floor(F.col("i") / FAN).alias("i"), F.ceil(F.col("n") / FAN).alias("n"), F.col("_up").alias(node))


def levels_of(leaves: DataFrame, name: str) -> list[DataFrame]:
    """``leaves(grp, i, n, node)`` and the levels above, up to one node a group, each written."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(parents(levels[-1].select("grp", "i", "n", "node")), f"{name}_{len(levels)}"))
        most = -(-most // FAN)
    return levels


def step(left: str = "left", right: str = "right") -> Column:
    return F.array(F.struct(F.col(left).alias("left"), F.col(right).alias("right")))


def paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """``levels[0]`` with ``path``, the siblings on each level up to the root, ``subroot`` and ``root``.

    ``top(grp, path, subroot, root)`` is what stands above each group's last node.  Only the way up is carried, so that
    a level has as many rows as nodes.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        ends = nodes.filter("n = 1").join(top, "grp").select(*nodes.columns, "path", "subroot", "root")
        if above is None:
            above = ends
            continue
        up = above.select(F.col("grp"), F.col("i").alias("_up"), "path", "subroot", "root")
        inner = with_siblings(nodes.filter("n > 1")).withColumn("_up", F.floor(F.col("i") / FAN)).join(up, ["grp", "_up"])
        inner = inner.select(*nodes.columns, F.concat(step(), "path").alias("path"), "subroot", "root")
        above = inner.unionByName(ends)
        if k:
            above = written(above, "paths")
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path make."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings from the leaf up to the root in a row."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def manifest(docs: DataFrame, id_col: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), others: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, leaf, subroot, root, path`` and one more hash of a row for each of ``others``.

    ``path`` holds ``left`` and ``right`` siblings for each level up to the root.  ``others`` names leaves to carry
    along that the tree does not hold, such as those of altered rows.  Leaves of a source ascend by id (null first,
    repeated ids by their leaf); a null source is the first of sources.  Null fields and texts are told from empty
    ones; texts of any length are hashed whole; an empty table gives no rows; columns besides ``fields`` are ignored,
    whatever their names.
    """
    extra = {free_name(docs, f"_other{k}"): c for k, c in enumerate((others or {}).values())}
    hashed = docs.select(
        # sources keep their order, and null comes first
        F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("")).alias("grp"),
        docs[id_col].alias("id"),
        leaf([docs[c] for c in fields]).alias("node"),
        *[c.alias(name) for name, c in extra.items()],
    )
    levels = levels_of(placed(hashed, ["id", "node"], "leaves"), "nodes")
    ends = [x.filter("n = 1").select(F.col("grp").alias("source"), "node") for x in levels]
    subroots = ends[0]
    for x in ends[1:]:
        subroots = subroots.unionByName(x)
    above = levels_of(placed(subroots.withColumn("grp", F.lit(0)), ["source"], "subroots"), "roots")
    root = above[-1].filter("n = 1").select("grp", F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = paths(above, root).select(F.col("source").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    done = paths(levels, small(written(tops, "tops")))
    return done.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(c).alias(n) for c, n in zip(extra, others or {})])
