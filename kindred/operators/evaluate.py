"""Retrieval quality against known pairs, and tuning sweeps over one candidate matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bidirectional(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair in both directions as ``query_id, target_id``."""
    return pairs.select(F.explode(F.array(F.struct(F.col(a).alias("query_id"), F.col(b).alias("target_id")), F.struct(F.col(b).alias("query_id"), F.col(a).alias("target_id")))).alias("p")).select("p.*")


def target_rank(directed: DataFrame, results: DataFrame) -> DataFrame:
    """The rank of each target among its query's results; null where missing, ``error`` where the query has none."""
    asked = results.select("query_id").distinct().withColumn("_known", F.lit(True))
    found = results.select("query_id", F.col("cand_id").alias("target_id"), "rank")
    out = directed.join(found, ["query_id", "target_id"], "left").join(asked, "query_id", "left")
    return out.withColumn("error", F.when(F.col("_known").isNull(), "no results")).drop("_known")


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: total, errors, and hits and recall at each k (errors count as misses)."""
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")
    columns = [x for k in ks for x in (F.sum(hit(k)).alias(f"hits_{k}"), F.avg(hit(k)).alias(f"recall_{k}"))]
    return ranks.agg(F.count("*").alias("total"), F.count("error").alias("errors"), *columns)


def recall_by_category(ranks: DataFrame, category: Column, k: int = 5) -> DataFrame:
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")
    return ranks.groupBy(category.alias("category")).agg(F.count("*").alias("total"), F.sum(hit).alias("hits"), F.avg(hit).alias("recall"))


def pass_rate(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate in which failing queries do not count."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")
    return ranks.filter("error is null").agg(F.count("*").alias("total"), F.sum(hit).alias("passed"), F.avg(hit).alias("pass_rate"))


def rescore(matrix: DataFrame, configs: DataFrame, groups: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall of each configuration; a target's rank is its place by score, ties by candidate id.

    ``matrix(query_id, cand_id, target_id, <groups>, numeric, jaccard, gate_form, gate_surface, gate_size)`` is computed
    once; see :func:`rescore_bulk`.
    """
    return rescore_bulk(matrix, configs, groups, ks, by_id=True)


def rescore_many(matrix: DataFrame, configs: DataFrame, groups: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Like :func:`rescore`, but only strictly better candidates stand before a target, so ties favour it."""
    return rescore_bulk(matrix, configs, groups, ks)


def rescore_bulk(matrix: DataFrame, configs: DataFrame, groups: list[str], ks: tuple[int, ...] = (1, 3, 5), pairs_per_task: int = 200, by_id: bool = False) -> DataFrame:
    """Recall of up to thousands of configurations: a matrix product per pair, hits summed up per task.

    A configuration ``(config_id, w_..., alpha, use_form, use_surface, use_size)`` scores ``alpha`` times the weighted
    similarities and the rest times ``jaccard``, to nine digits, of the candidates that pass the gates it uses.

    What a task returns is a row per configuration, however many pairs it has seen; the list of configurations is
    written by the caller and travels to the tasks.
    """
    rows = configs.select("config_id", *[f"w_{g}" for g in groups], "w_numeric", "alpha", "use_form", "use_surface", "use_size").toPandas()
    names = rows["config_id"].tolist()
    weights = rows[[*[f"w_{g}" for g in groups], "w_numeric"]].to_numpy(float).T * rows["alpha"].to_numpy(float)
    rest = 1 - rows["alpha"].to_numpy(float)
    use = rows[["use_form", "use_surface", "use_size"]].to_numpy(bool)
    shared = matrix.sparkSession.sparkContext.broadcast((names, weights, rest, use))
    total = matrix.select("query_id", "target_id").distinct().count()
    tasks = max(1, -(-total // pairs_per_task))

    def hits(table: pa.Table) -> pa.Table:
        names, weights, rest, use = shared.value
        table = table.sort_by([("query_id", "ascending"), ("target_id", "ascending")])
        column = lambda c: table.column(c).to_numpy()
        query, target, cand = column("query_id"), column("target_id"), column("cand_id")
        x = np.column_stack([column(c) for c in (*groups, "numeric")]).astype(float)
        jaccard, passed = column("jaccard").astype(float), np.column_stack([column(f"gate_{g}") for g in ("form", "surface", "size")]).astype(bool)
        cuts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (target[1:] != target[:-1]))).tolist() + [len(query)]
        counts = np.zeros((len(ks), len(names)), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            own = np.flatnonzero(cand[a:b] == target[a])
            if not len(own):
                continue
            score = np.round(x[a:b] @ weights + jaccard[a:b, None] * rest, 9)
            open_ = (~use[None] | passed[a:b, None]).all(axis=2)
            before = score > score[own[0]]
            if by_id:
                before |= (score == score[own[0]]) & (cand[a:b, None] < target[a])
            better = (before & open_).sum(axis=0)
            for k, most in enumerate(ks):
                counts[k] += (better < most) & open_[own[0]]
        return pa.table({"config_id": pa.array(names, pa.string()), **{f"_h{k}": pa.array(c) for k, c in zip(ks, counts)}})

    block = F.pmod(F.xxhash64("query_id", "target_id"), F.lit(tasks))
    parts = matrix.groupBy(block).applyInArrow(hits, "config_id string, " + ", ".join(f"_h{k} long" for k in ks))
    summed = parts.groupBy("config_id").agg(*[F.sum(f"_h{k}").alias(f"_h{k}") for k in ks])
    return summed.select("config_id", F.lit(total).cast("long").alias("total"), *[(F.col(f"_h{k}") / total).alias(f"recall_{k}") for k in ks])


def field_weights(df: DataFrame, n: int, fields: list[str], seed: int = 7, most: float = 5.0) -> DataFrame:
    """``config_id, w_<field>``: ``n`` draws of weights from 0 to ``most``, by hash, so that engines agree."""
    u = lambda f: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"), F.lit(f"|{f}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.sparkSession.range(n).select(F.col("id").cast("string").alias("config_id"), *[(u(f) * most).alias(f"w_{f}") for f in fields])


def weights_by_category(matrix: DataFrame, configs: DataFrame, fields: list[str], category: str = "category", k: int = 5, least: int = 3, pairs_per_task: int = 200) -> DataFrame:
    """``category, config_id, total, hits, recall`` of each category with at least ``least`` directed pairs.

    ``matrix(category, query_id, target_id, cand_id, <fields>)`` holds field scores, null where they do not compare; a
    candidate's score is their mean by the configuration's weights over the fields that do (0 where none does), and a
    target is hit if fewer than ``k`` candidates score strictly higher.  A task takes pairs of a category as one matrix
    product each and returns a row per configuration, however many pairs it has; a category of many pairs is dealt over
    many tasks.  Configurations are a list that the caller writes; they travel to the tasks.
    """
    rows = configs.select("config_id", *[f"w_{f}" for f in fields]).orderBy("config_id").toPandas()
    shared = matrix.sparkSession.sparkContext.broadcast((rows["config_id"].tolist(), rows[[f"w_{f}" for f in fields]].to_numpy(float).T))
    counts = matrix.select(category, "query_id", "target_id").distinct().groupBy(category).agg(F.count("*").alias("total")).filter(F.col("total") >= least)
    tasks = matrix.join(counts.select(category, "total"), category).withColumn("_task", F.pmod(F.xxhash64("query_id", "target_id"), F.ceil(F.col("total") / pairs_per_task)))

    def hits(table: pa.Table) -> pa.Table:
        names, weights = shared.value
        table = table.sort_by([("query_id", "ascending"), ("target_id", "ascending")])
        query, target, cand = (table.column(c).to_numpy() for c in ("query_id", "target_id", "cand_id"))
        x = np.column_stack([table.column(f).to_numpy(zero_copy_only=False).astype(float) for f in fields])
        known = ~np.isnan(x)
        score, weight = np.where(known, x, 0) @ weights, known @ weights
        score = np.round(np.divide(score, weight, out=np.zeros_like(score), where=weight > 0), 9)
        cuts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (target[1:] != target[:-1]))).tolist() + [len(query)]
        found = np.zeros(len(names), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            own = np.flatnonzero(cand[a:b] == target[a])
            if len(own):
                found += (score[a:b] > score[a + own[0]]).sum(axis=0) < k
        return pa.table({"category": pa.array([table.column(category)[0].as_py()] * len(names), pa.string()), "config_id": names, "_hits": found})

    parts = tasks.groupBy(category, "_task").applyInArrow(hits, "category string, config_id string, _hits long")
    summed = parts.groupBy("category", "config_id").agg(F.sum("_hits").alias("hits"))
    return summed.join(counts.withColumnRenamed(category, "category"), "category").select("category", "config_id", "total", "hits", (F.col("hits") / F.col("total")).alias("recall"))


def best_by_category(scored: DataFrame) -> DataFrame:
    """The configuration with the most hits of each category, ties by id."""
    place = Window.partitionBy("category").orderBy(F.desc("hits"), "config_id")
    return scored.withColumn("_k", F.row_number().over(place)).filter("_k = 1").drop("_k")


def sample_weights(df: DataFrame, n: int, groups: list[str], seed: int = 42, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """``n`` weight vectors drawn evenly from the simplex (by hash, so that engines agree) by gates and alphas."""
    names = [*groups, "numeric"]
    u = lambda g: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("n").cast("string"), F.lit(f"|{g}"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    drawn = df.sparkSession.range(n).select(F.col("id").alias("n")).withColumns({f"e_{g}": -F.log(u(g)) for g in names})
    total = sum((F.col(f"e_{g}") for g in names), F.lit(0.0))
    weights = drawn.select("n", *[(F.col(f"e_{g}") / total).alias(f"w_{g}") for g in names])
    flags = F.array(F.lit(False), F.lit(True))
    grid = weights.withColumn("use_form", F.explode(flags)).withColumn("use_surface", F.explode(flags)).withColumn("use_size", F.explode(flags))
    grid = grid.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    key = F.concat_ws("-", "n", *[F.col(f).cast("int").cast("string") for f in ("use_form", "use_surface", "use_size")], F.col("alpha").cast("string"))
    return grid.withColumn("config_id", key)


def best(results: DataFrame, by: tuple[str, ...] = ("recall_5", "recall_3", "recall_1"), most: int = 10) -> DataFrame:
    """The best configurations, ties by id."""
    return results.orderBy(*[F.desc(c) for c in by], "config_id").limit(most)
