"""Filters over candidate pairs and over annotated items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import signature_match
from ..sources.shared import small, written


def signature_prefilter(pairs: DataFrame, a: str, b: str, least: float = 0.6, query: str = "query_id") -> DataFrame:
    """Pairs whose signatures agree enough; a query for which no pair does keeps all."""
    fit = signature_match(F.col(a), F.col(b))
    marked = pairs.withColumn("signature_score", fit).withColumn("_any", F.max((fit >= least).cast("int")).over(Window.partitionBy(query)))
    return marked.filter((F.col("signature_score") >= least) | (F.col("_any") == 0)).drop("_any")


def with_best(entities: DataFrame, block: str, sig: str) -> DataFrame:
    """``entities`` with ``_best``, the largest score of their ``sig`` with any other entity's of their ``block``; null for none.

    Equal signatures of a block are counted first, so this meets pairs of different signatures and no pair of entities.
    """
    kinds = written(entities.filter(F.col(block).isNotNull() & F.col(sig).isNotNull()).groupBy(F.col(block).alias("_block"), F.col(sig).alias("_sig")).agg(F.count("*").alias("_n")), "signatures")
    spread = kinds.repartition(4 * entities.sparkSession.sparkContext.defaultParallelism, "_block", "_sig")  # few rows, each of which meets many
    met = spread.join(small(kinds.select("_block", F.col("_sig").alias("_other"))), "_block").filter((F.col("_sig") != F.col("_other")) | (F.col("_n") > 1))
    best = met.groupBy("_block", "_sig").agg(F.max(signature_match(F.col("_sig"), F.col("_other"))).alias("_best"))
    near = small(written(best, "best"))
    return entities.join(near, (F.col(block) == F.col("_block")) & (F.col(sig) == F.col("_sig")), "left").select(*entities.columns, "_best")


def fit_or_all(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """:func:`signature_prefilter` of pairs that have their ``signature_score`` and the query's ``_best`` (:func:`with_best`);
    pairs pass as they arise and are made once."""
    return pairs.filter((F.col("signature_score") >= least) | (F.coalesce("_best", F.lit(0.0)) < least)).drop("_best")


def null_tolerant_gate(items: DataFrame, annotations: DataFrame, gates: dict[tuple[str, str], tuple[str, Sequence[str]]], id_col: str = "id") -> DataFrame:
    """Items whose annotations do not speak against them.

    ``gates`` maps (feature, annotation type) to ("allow" | "deny", values).  An item without that annotation passes.
    All gates are read in one pass over the annotations.
    """
    bad: list[Column] = []
    for (feature, kind), (mode, values) in gates.items():
        listed = F.col("feature_value").isin(*values)
        bad.append((F.col("feature_name") == feature) & (F.col("annotation_type") == kind) & F.col("feature_value").isNotNull() & (listed if mode == "deny" else ~listed))
    refused = annotations.filter(F.coalesce(F.greatest(*bad) if len(bad) > 1 else bad[0], F.lit(False))).select(F.col("id").alias("_refused")).distinct()
    return items.join(refused, items[id_col] == F.col("_refused"), "left_anti")
