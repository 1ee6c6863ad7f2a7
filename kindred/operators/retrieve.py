"""Ranked confusable entities for whole batches of queries, and lookups around them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import context_boost, gate_equal, gate_opposite, long_words, words_shared
from ..sources.shared import small, written
from . import vectors as V
from .fusion import STRATEGIES, blend, weights_of
from .gates import signature_prefilter
from .pairs import PairSpec, block_pairs, numbered_values, numeric_similarity, pair_features, sides, soft_jaccard, value_scores, with_scores
from .ranker import fuse_learned


@dataclass
class Search:
    """Settings of a retrieval."""

    groups: list[str]
    overrides: dict[str, float] = field(default_factory=dict)
    numeric: float = 0.10
    top_k: int = 10
    strategy: str = "weighted"
    alpha: float = 1.0
    category: str | None = None
    gates: tuple[str, ...] = ()
    dangerous: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    priority: tuple[str, ...] = ()
    signature: str | None = None
    context: tuple[str, str, str, str] | None = None  # query's region, listed regions, query's season, listed seasons

    @property
    def pool_k(self) -> int:
        return max(5 * self.top_k, 60) * (2 if self.dangerous else 1)


def candidates(queries: DataFrame, entity_vectors: DataFrame, s: Search) -> DataFrame:
    """Hits of each query by group: within its category where asked, unless that leaves too few."""
    free = V.topk_by_group(queries, entity_vectors, s.pool_k)
    if not s.category:
        return free
    return V.with_fallback(V.topk_by_group(queries, entity_vectors, s.pool_k, s.category), free, s.pool_k).drop("fallback")


def scored(hits: DataFrame, entities: DataFrame | None, s: Search, spec: PairSpec | None = None, id_col: str = "entity_id") -> DataFrame:
    """Candidates with similarities, numeric and vocabulary scores and the fused ``score``."""
    weights = weights_of(s.groups, s.overrides, s.numeric)
    per_group = [F.max(F.when(F.col("grp") == g, F.col("sim"))).alias(g) for g in s.groups]
    ranks = [F.max(F.when(F.col("grp") == g, F.col("rank"))).alias(f"rank_{g}") for g in s.groups]
    # one grouping gives the union of candidates, whether a priority group has them, and their columns
    wanted = F.max(F.col("grp").isin(*s.priority)) if s.priority else F.lit(True)
    wide = hits.groupBy("query_id", "cand_id").agg(*per_group, *ranks, wanted.alias("_wanted"), F.count("*").alias("n_groups"))
    wide = wide.filter("_wanted").drop("_wanted").fillna(0.0, s.groups)
    if s.strategy == "contrastive":
        stats = V.group_stats(hits)
        flat = stats.groupBy("query_id").agg(*[F.max(F.when(F.col("grp") == g, F.col(k))).alias(f"{k}_{g}") for g in s.groups for k in ("mean", "std")])
        wide = wide.join(flat, "query_id")
    wide = wide.withColumn("numeric", F.lit(0.0)).withColumn("jaccard", F.lit(0.0))
    if entities is not None:
        # values are numbered on the entities, so that no pair is written to find the different ones
        values = value_scores(spec) if spec else {}
        entities, found = numbered_values(entities, values)
        wide = sides(wide, entities, id_col)
        # the signature rules over the whole pool, before the gates: a query without a fit keeps its pool
        if s.signature:
            wide = signature_prefilter(wide, f"a_{s.signature}", f"b_{s.signature}")
        for gate in s.gates:
            wide = wide.filter(gate_equal(F.col(f"a_{gate}"), F.col(f"b_{gate}")))
        if s.dangerous:
            column, safe, dangerous = s.dangerous
            wide = wide.filter(gate_opposite(F.col(f"a_{column}"), F.col(f"b_{column}"), safe, dangerous))
        if spec:
            wide = with_scores(wide, values, found).withColumn("numeric", numeric_similarity(spec, listed=True)).withColumn("jaccard", soft_jaccard(spec, listed=True))
    given = {
        "sims": {g: F.col(g) for g in s.groups},
        "ranks": {g: F.col(f"rank_{g}") for g in s.groups},
        "stats": {g: (F.col(f"mean_{g}"), F.col(f"std_{g}")) for g in s.groups},
        "numeric": F.col("numeric"),
        "weights": weights,
        "pool_k": s.pool_k,
    }
    total: Column = blend(STRATEGIES[s.strategy](given), F.col("jaccard"), s.alpha)
    if s.context:
        region, regions, season, seasons = s.context
        total = F.least(F.lit(1.0), total + context_boost(F.col(f"a_{region}"), F.col(f"b_{regions}"), F.col(f"a_{season}"), F.col(f"b_{seasons}")))
    return wide.withColumn("score", F.round(F.round(F.least(F.lit(1.0), total), 9), 4))


def top(candidates_: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by id, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    return candidates_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lookalikes(queries: DataFrame, entity_vectors: DataFrame, s: Search, entities: DataFrame | None = None, spec: PairSpec | None = None) -> DataFrame:
    """All queries in one plan: pool by group, gates, fused score, best ``top_k``."""
    return top(scored(candidates(queries, entity_vectors, s), entities, s, spec), s.top_k)


def lookalikes_learned(queries: DataFrame, entity_vectors: DataFrame, s: Search, entities: DataFrame, spec: PairSpec, model, features: list[str]) -> DataFrame:
    """All queries by a learned ranker: a pool twice as large, gates as set, and the ranker's probability in place of the
    fused score and its boosts."""
    wide = scored(candidates(queries, entity_vectors, replace(s, top_k=2 * s.top_k)), entities, replace(s, context=None), spec)
    rows = wide.drop("score").withColumns({k: v for k, v in pair_features(spec, listed=True).items()})
    ranked = fuse_learned(rows, model, features).select("query_id", "cand_id", F.round("score", 6).alias("score"))
    return top(ranked, s.top_k)


def compare_features(asked: DataFrame, profiles: DataFrame, block: str) -> DataFrame:
    """A row per pair within a block and field that either side has: both texts and whether they share a word.

    ``profiles(entity_id, <block>, field, value)`` is long; ``asked`` are the rows of the entities that ask.  Each entity
    gets a row for every field that there is, so a pair's row arises whole where its second side is read.  Different
    values are compared once; where they are too many, a pair's words are.
    """
    at = ["entity_id", block]
    scores = {"shared": ("value", words_shared)}
    rows, found = numbered_values(profiles, scores)
    listed = [c for c in ("_no_shared",) if c in rows.columns]
    values = rows.groupBy(*at, "field").agg(*[F.max(c).alias(c) for c in ("value", *listed)])  # numbers are in the order of values
    full = rows.select(*at).distinct().crossJoin(small(rows.select("field").distinct())).join(values, [*at, "field"], "left")
    full = written(full if listed else full.withColumn("words", long_words(F.col("value"))), "profiles")
    met = block_pairs(full.join(small(asked.select(*at).distinct()), at, "left_semi"), full, "entity_id", [block, "field"], found=found)
    said = met.filter(F.col("a_value").isNotNull() | F.col("b_value").isNotNull())
    similar = F.col("sim_shared") if listed else F.arrays_overlap("a_words", "b_words")
    said = with_scores(said, scores, found) if listed else said
    return said.select("query_id", "cand_id", F.col("a_field").alias("field"), F.col("a_value").alias("query_value"), F.col("b_value").alias("cand_value"), F.coalesce(similar, F.lit(False)).alias("is_similar"))


def lookup_entity(names: DataFrame, entities: DataFrame, name: str, key: str) -> DataFrame:
    """Exact names without regard to case; a name that is unknown stays as a row with an error."""
    known = entities.select(F.lower(name).alias("_k"), F.col(key).alias("entity_id")).groupBy("_k").agg(F.min("entity_id").alias("entity_id"))
    found = names.withColumn("_k", F.lower("name")).join(known, "_k", "left").drop("_k")
    return found.withColumn("error", F.when(F.col("entity_id").isNull(), F.concat(F.lit("unknown: "), "name")))


def with_links(candidates_: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Attach each candidate's source links, sorted, as ``sources``: a list of (name, url), empty for none."""
    links = sources.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "url"))).alias("sources"))
    return candidates_.join(links, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<name:string,url:string>>")))


def enrich(candidates_: DataFrame, images: DataFrame, key: str, sources: DataFrame | None = None) -> DataFrame:
    """Attach each candidate's image references, sorted, as a list of (url, source); a plain text has no source.  With
    ``sources(key, name, url)`` its source links too (:func:`with_links`)."""
    if sources is not None:
        candidates_ = with_links(candidates_, sources, key)
    refs = images.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("url", F.coalesce("source", F.lit("")).alias("source")))).alias("images"))
    return candidates_.join(refs, key, "left").withColumn("images", F.coalesce("images", F.array().cast("array<struct<url:string,source:string>>")))


def entity_summary(entities: DataFrame, name: str, status: str) -> DataFrame:
    """``name, status, n`` of all entities, in order; entities that share both are counted."""
    return entities.groupBy(F.col(name).alias("name"), F.col(status).alias("status")).agg(F.count("*").alias("n")).orderBy("name", "status")


def entity_profile(names: DataFrame, entities: DataFrame, name: str, key: str, fields: list[str], sources: DataFrame) -> DataFrame:
    """A row per asked ``name``, without regard to case: the entity's id, its own spelling as ``known_as``, its fields, the
    sorted source links (``sources(key, name, url)``, none: empty) and how many; an unknown name has an error and nulls."""
    found = lookup_entity(names, entities, name, key)
    profile = entities.select(F.col(key).alias("entity_id"), F.col(name).alias("known_as"), *fields)
    linked = with_links(profile, sources.withColumnRenamed(key, "entity_id"), "entity_id").withColumn("source_count", F.size("sources"))
    return found.join(linked, "entity_id", "left")


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing in a stable order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def with_feature(entities: DataFrame, name: str, *features: str) -> DataFrame:
    """Names of entities with any of the features known."""
    return entities.filter(F.coalesce(*[F.col(f).cast("string") for f in features]).isNotNull()).select(name).distinct()


def query_stats(results: DataFrame) -> DataFrame:
    """Candidates returned and best score of each query."""
    return results.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.max("score").alias("top_score"))
