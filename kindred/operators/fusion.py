"""Weights and strategies that fuse per-group similarities into one score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weights_of(groups: list[str], overrides: dict[str, float] | None = None, numeric: float = 0.10) -> dict[str, float]:
    """Equal weights beside the numeric one, overridden by name, scaled to sum 1."""
    raw = {g: (1 - numeric) / len(groups) for g in groups} | {"numeric": numeric} | (overrides or {})
    total = sum(raw.values())
    return {g: w / total for g, w in raw.items()} if total else raw


def resolve_weights(spark: SparkSession, groups: list[str], overrides: dict[str, float] | None = None, numeric: float = 0.10) -> DataFrame:
    """:func:`weights_of` as ``grp, w`` (a row for each group)."""
    raw = {g: (1 - numeric) / len(groups) for g in groups} | {"numeric": numeric} | (overrides or {})
    table = spark.createDataFrame(sorted(raw.items()), "grp string, w double")
    return table.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))


def fuse_weighted(sims: dict[str, Column], numeric: Column, weights: dict[str, float]) -> Column:
    """Sum of weight times similarity, the numeric one included."""
    return sum((F.lit(weights.get(g, 0.0)) * s for g, s in sims.items()), F.lit(weights.get("numeric", 0.0)) * numeric)


def fuse_rrf(ranks: dict[str, Column], numeric: Column, numeric_weight: float, pool_k: int, k: int = 60) -> Column:
    """Reciprocal ranks, an absent one counting as behind the pool, scaled by the best possible; blended with numeric."""
    total = sum((1.0 / (k + F.coalesce(r, F.lit(pool_k + 1))) for r in ranks.values()), F.lit(0.0))
    return (1 - numeric_weight) * total / (len(ranks) / (k + 1)) + numeric_weight * numeric


def fuse_contrastive(sims: dict[str, Column], stats: dict[str, tuple[Column, Column]], numeric: Column, weights: dict[str, float], z: float = 0.0) -> Column:
    """Only groups whose similarity stands out by more than ``z`` deviations count (all, if none does)."""
    passes = {g: (sims[g] - stats[g][0]) / stats[g][1] > z for g in sims}
    some = sum((p.cast("int") for p in passes.values()), F.lit(0)) > 0
    use = {g: F.coalesce(passes[g], F.lit(False)) | ~F.coalesce(some, F.lit(False)) for g in sims}
    weight = sum((F.when(use[g], weights.get(g, 0.0)).otherwise(0.0) for g in sims), F.lit(0.0))
    score = sum((F.when(use[g], weights.get(g, 0.0) * sims[g]).otherwise(0.0) for g in sims), F.lit(0.0))
    part = F.when(weight > 0, score / weight).otherwise(0.0)
    numeric_weight = weights.get("numeric", 0.0)
    return (1 - numeric_weight) * part + numeric_weight * numeric


def blend(embedding: Column, jaccard: Column, alpha: float = 0.5) -> Column:
    return alpha * embedding + (1 - alpha) * jaccard


#: Strategies by name; each is given what :func:`kindred.operators.retrieve.scored` has for a candidate.
STRATEGIES: dict[str, Callable[..., Column]] = {
    "weighted": lambda c: fuse_weighted(c["sims"], c["numeric"], c["weights"]),
    "rrf": lambda c: fuse_rrf(c["ranks"], c["numeric"], c["weights"].get("numeric", 0.0), c["pool_k"]),
    "contrastive": lambda c: fuse_contrastive(c["sims"], c["stats"], c["numeric"], c["weights"]),
}


def register_strategy(name: str, function: Callable[..., Column]) -> None:
    STRATEGIES[name] = function
