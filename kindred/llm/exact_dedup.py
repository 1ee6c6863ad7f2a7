"""Exact duplicates by content sort (DataFrame operations only).

Sampled splitters (``repartitionByRange``) range-partition the normalised bytes, each range is sorted externally so
that equal texts become neighbours, and the window compares whole neighbouring texts to number the runs.  The
splitter key is a bounded prefix plus a hash of the text, so that what is sampled to the driver does not grow with
the length of the texts; equal texts have equal keys and the full text is the next sort column.

Hot groups: a text whose copies exceed ``1 / hot_share`` of all rows (at most ``hot_share`` texts can) is salted
over as many ranges as its size asks for, and its per-salt results, a row for each salt, are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of_keys, partitions, written


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str | Column = "text",
    keep: str = "smallest",
    hot_share: int = 2_000,
    prefix: int = 24,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``text`` names a column or is a normalising expression; null counts as the empty text, so all null and empty
    texts form one group.  Of equal texts the row with the smallest (or, ``keep="largest"``, largest) id stays; if an
    id itself is repeated with the same text, all its rows carry the same verdict.  Other columns are ignored, and
    an empty input gives an empty result.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs[text] if isinstance(text, str) else text, F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("_id"), content.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    total = docs.count()
    limit = max(256, total // hot_share)
    # at most hot_share hashes can have more rows than total / hot_share: a proven bound for the broadcast
    hot = rows.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select("_hash", F.ceil(F.col("_n") / limit).alias("_salts"))
    rows = rows.join(F.broadcast(hot), "_hash", "left").withColumn(
        # copies of one row share their id: the task that reads them tells them apart
        "_salt", F.when(F.col("_salts") > 0, F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.col("_salts")).cast("int")).otherwise(F.lit(-1))
    )
    ranged = rows.withColumn("_prefix", F.substring("_text", 1, prefix)).repartitionByRange(
        max(partitions(spark), 1), "_prefix", "_hash", "_salt"
    )
    run = Window.partitionBy("_prefix", "_hash", "_salt", "_text")
    best = F.min if keep == "smallest" else F.max
    marked = ranged.select(
        "_id", "_salt", best("_id").over(run).alias("_best"), F.count("*").over(run).alias("_size"), F.sha2("_text", 256).alias("text_sha256")
    )
    # merged runs of hot texts: no more than hot_share of them, a row for each salt before the merge
    merged = (
        rows.filter("_salt >= 0")
        .groupBy(F.sha2("_text", 256).alias("text_sha256"))
        .agg(best("_id").alias("_all_best"), F.count("*").alias("_all_size"))
    )
    whole = marked.join(F.broadcast(merged), "text_sha256", "left")
    keep_id = F.coalesce("_all_best", "_best")
    return whole.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_all_size", "_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_ids: int = 4_000_000, **options) -> DataFrame:
    """One row of each text, that with the smallest (or largest) id; rows without an id stay only where no other has the text."""
    several = exact_duplicates(docs, id_col, text, **options).filter("group_size > 1")
    # 128 bits of the id and the text's SHA-256: keys of other rows are not met by chance
    key = lambda i, sha: F.unhex(F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("-")), sha)))
    rows = several.select(key(F.col(id_col), F.col("text_sha256")).alias("_key"), F.col("kept").alias("_stays"))
    judged = written(rows.groupBy("_key", "_stays").agg(F.count("*").alias("_rows")), "judged")
    dropped, repeated = judged.filter("not _stays").select(F.col("_key").alias("_dropped")), judged.filter("_stays and _rows > 1").select(F.col("_key").alias("_repeated"))
    return first_of_keys(docs, key(docs[id_col].cast("long"), F.sha2(F.coalesce(docs[text], F.lit("")), 256)), dropped, repeated, broadcast_ids)
