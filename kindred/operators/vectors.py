"""Vector retrieval per group of fields: exact in blocks, and what follows from hits.

``entity_vectors(entity_id, grp, vec)`` is long: a new group is rows, not columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, written
from . import pivots

DIGITS = 6
#: A task of a search by blocks reads about so many rows, queries' visits and vectors.
TASK_ROWS = 400_000
#: Candidates within their queries' bounds that a task orders at once.
BOUNDED = 1 << 18


def group_vectors(df: DataFrame, id_col: str, vec: str, groups: int, width: int) -> DataFrame:
    """Cut vectors into ``groups`` slices of ``width``: ``entity_id, grp, vec`` with the other columns kept."""
    slices = F.array(*[F.struct(F.lit(f"g{g}").alias("grp"), F.slice(vec, 1 + g * width, width).alias("vec")) for g in range(groups)])
    other = [c for c in df.columns if c not in (id_col, vec)]
    return df.select(F.col(id_col).alias("entity_id"), *other, F.explode(slices).alias("s")).select("entity_id", *other, "s.grp", "s.vec")


_matrix = pivots.unit_rows


def topk_by_group(queries: DataFrame, vectors: DataFrame, k: int, category: str | None = None, block: int = 50_000, query_block: int = 20_000) -> DataFrame:
    """The k nearest by cosine for each query and group: ``query_id, grp, cand_id, sim, rank``.

    Both sides are ``(entity_id, grp, vec)``; with ``category`` only candidates of the query's category count
    (none is one too).  Null vectors are skipped and a query never finds itself.  Similarities are rounded to six digits and ties go to the
    smaller id.

    Up to ``block`` vectors, queries meet all of them.  Beyond, vectors stand in blocks around pivots, and it is queries
    that travel: first to their nearest blocks, which gives each query a bound, then to the blocks that the triangle
    inequality cannot rule out within it.  Neither side is broadcast and no table of all pairs arises; see :func:`cells`.
    Hits are then written once, as the search is far more work than what reads them.
    """
    return topk_and_meetings(queries, vectors, k, category, block, query_block)[0]


def topk_and_meetings(queries: DataFrame, vectors: DataFrame, k: int, category: str | None = None, block: int = 50_000, query_block: int = 20_000, first: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """:func:`topk_by_group`, and ``grp, blocks, met``: how many meetings of a query and a block there could be and were
    (None where there are no blocks)."""
    keys = ["grp", *(["_of"] if category else [])]
    # no category is one of its own, and joins need keys that are not null
    of = [F.coalesce(F.concat(F.lit("="), F.col(category).cast("string")), F.lit("")).alias("_of")] if category else []
    q, v = (x.filter("vec is not null").select("grp", *of, "entity_id", "vec") for x in (queries, vectors))
    n = v.count()
    if n <= block:
        one = F.lit(0).alias("_block")
        chunks = pivots.spread(q.sparkSession, q.count(), query_block)
        dealt = q.select("*", one, F.pmod(F.xxhash64("entity_id"), F.lit(chunks)).cast("int").alias("_q"), F.lit(0).alias("_v"))
        copies = v.select("*", one, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_q"), F.lit(0).alias("_v"))
        return ranked(_nearest(dealt, copies, keys, k), k), None
    centres = pivots.pivots_of(v, n, pivots.pivot_count(n, block))
    placed = written(pivots.with_distances(v, centres, nearest=True), "placed")
    about = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.max("_dist").alias("_far"), F.min("_dist").alias("_near"))
    about = written(about, "blocks")
    listed = small(about.groupBy(*keys).agg(F.collect_list(F.struct("_block", "_far", "_near")).alias("_blocks")))  # as many as pivots
    asked = pivots.with_distances(q, centres, nearest=False).join(listed, keys)
    away = F.array_sort(F.transform("_blocks", lambda b: F.struct(F.get("_to", b["_block"]).alias("d"), b["_block"].alias("b"), b["_far"].alias("far"), b["_near"].alias("near"))))
    asked = written(asked.select(*keys, "entity_id", "vec", away.alias("_away")), "asked")
    visits = asked.select(*keys, "entity_id", "vec", F.explode(F.slice("_away", 1, first)["b"]).alias("_block"))
    found = written(ranked(_nearest(*cells(visits, placed, about, keys, block, query_block), keys, k), k), "found")
    limit = found.filter(F.col("rank") == k).select(F.col("query_id").alias("entity_id"), "grp", F.col("sim").alias("_least"), pivots.bound_of(F.col("sim")).alias("_within"))
    open_ = asked.join(limit, ["entity_id", "grp"], "left").withColumn("_within", F.coalesce("_within", F.lit(9.0)))
    rest = F.filter(F.slice("_away", first + 1, F.greatest(F.size("_away") - first, F.lit(0))), lambda b: (b["d"] - b["far"] <= F.col("_within")) & (b["near"] - b["d"] <= F.col("_within")))
    more = written(open_.select(*keys, "entity_id", "vec", "_least", F.explode(rest["b"]).alias("_block")), "visits")
    further = _nearest(*cells(more, placed, about, keys, block, query_block), keys, k)
    met = visits.groupBy("grp").agg(F.count("*").alias("met")).union(more.groupBy("grp").agg(F.count("*").alias("met"))).groupBy("grp").agg(F.sum("met").alias("met"))
    counts = asked.groupBy("grp").agg(F.sum(F.size("_away")).alias("blocks")).join(met, "grp")
    return written(ranked(found.drop("rank").unionByName(further), k), "hits"), counts


def cells(visits: DataFrame, placed: DataFrame, about: DataFrame, keys: list[str], block: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors with ``_q, _v``, so that a cell has at most about ``block`` vectors and ``query_block`` queries.

    A block of many vectors is cut into parts that each of its queries visits; vectors are copied once for every
    ``query_block`` queries that visit their block, and those of a block that none visits not at all.

    Where visits are many (a query may visit all blocks, and these grow in number too), cells are dealt over more tasks
    than ``spark.sql.shuffle.partitions``, so that a task sorts about ``TASK_ROWS`` rows, whatever the input.
    """
    at = [*keys, "_block"]
    asked = visits.groupBy(*at).agg(F.count("*").alias("_m")).join(about, at)
    parts, chunks = F.ceil(F.col("_n") / block).cast("int"), F.ceil(F.col("_m") / query_block).cast("int")
    shape = written(asked.select(*at, parts.alias("_parts"), chunks.alias("_chunks"), (F.col("_m") * parts + F.col("_n") * chunks).alias("_rows")), "cells")
    rows = shape.agg(F.sum("_rows")).first()[0] or 0
    shape = small(shape.drop("_rows"))
    own = lambda n: F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(shape, at).select(*visits.columns, own("_chunks").alias("_q"), each("_parts").alias("_v"))
    right = placed.join(shape, at).select(*at, "entity_id", "vec", own("_parts").alias("_v"), each("_chunks").alias("_q"))
    tasks = pivots.spread(visits.sparkSession, rows, TASK_ROWS)
    if tasks > int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = (x.repartition(tasks, *at, "_q", "_v") for x in (left, right))
    return left, right


def _nearest(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``query_id, grp, cand_id, sim``: the k nearest within each cell, of those no farther than the query's ``_least``
    where it has one (k hits elsewhere are as near, so no other can count)."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        who, found, near, grp = [], [], [], ""
        if left.num_rows and right.num_rows:
            ids, names, width = right.column("entity_id").to_numpy(), left.column("entity_id").to_numpy(), 1 + (1 << 22) // right.num_rows
            rows, candidates = _matrix(left.column("vec")), _matrix(right.column("vec")).T
            grp = left.column("grp")[0].as_py()
            least = left.column("_least").to_numpy().astype(np.float64)  # none is NaN
            for start in range(0, len(names), width):  # bounded memory, whatever the cell
                asked, low = names[start : start + width], least[start : start + width]
                raw = rows[start : start + width] @ candidates
                open_ = ~(raw < (low - 10.0**-DIGITS)[:, None])  # what rounding could bring to the bound too
                if np.count_nonzero(open_) <= BOUNDED:  # few are within the bounds: all queries at once
                    r, c = np.nonzero(open_)
                    sim = np.round(raw[r, c], DIGITS)
                    kept = (ids[c] != asked[r]) & ~(sim < low[r])
                    r, c, sim = r[kept], c[kept], sim[kept]
                    order = np.lexsort((ids[c], -sim, r))
                    r, c, sim = r[order], c[order], sim[order]
                    best = np.arange(len(r)) - np.searchsorted(r, r) < k
                    who.append(asked[r[best]])
                    found.append(ids[c[best]])
                    near.append(sim[best])
                    continue
                for name, row, bound in zip(asked.tolist(), np.round(raw, DIGITS), low.tolist()):
                    open_ = np.flatnonzero((ids != name) & ~(row < bound))
                    if len(open_) > 4 * k:  # all that tie with the k-th stay for the order by id
                        cut = np.partition(row[open_], len(open_) - k)[len(open_) - k]
                        open_ = open_[row[open_] >= cut]
                    best = open_[np.lexsort((ids[open_], -row[open_]))][:k]
                    who.append(np.full(len(best), name))
                    found.append(ids[best])
                    near.append(row[best])
        flat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        whose = flat(who, pa.int64())
        return pa.table({"query_id": whose, "grp": pa.array([grp], pa.string()).take(pa.array(np.zeros(len(whose), np.int32))), "cand_id": flat(found, pa.int64()), "sim": flat(near, pa.float64())})

    if "_least" not in queries.columns:
        queries = queries.withColumn("_least", F.lit(None).cast("double"))
    by = [*keys, "_block", "_q", "_v"]
    return queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInArrow(nearest, "query_id long, grp string, cand_id long, sim double")


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Ranks from 1 within query and group by falling similarity, ties by id; the first k of them."""
    order = Window.partitionBy("query_id", "grp").orderBy(F.desc("sim"), "cand_id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k) if k else out


def recall(found: DataFrame, exact: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the exact hits that were found (one row, or one for each value of ``by``)."""
    both = exact.select("query_id", "grp", "cand_id").join(found.select("query_id", "grp", "cand_id", F.lit(1).alias("_hit")), ["query_id", "grp", "cand_id"], "left")
    return both.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count("*").alias("n_hits"))


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, pool_k: int) -> DataFrame:
    """A query's filtered hits, unless they name fewer than ``pool_k`` candidates: then its unfiltered ones."""
    enough = filtered.groupBy("query_id").agg(F.countDistinct("cand_id").alias("_n")).filter(F.col("_n") >= pool_k).select("query_id")
    return filtered.join(enough, "query_id", "left_semi").withColumn("fallback", F.lit(False)).unionByName(
        unfiltered.join(enough, "query_id", "left_anti").withColumn("fallback", F.lit(True))
    )


def candidate_union(hits: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Distinct candidates of each query over all groups; with ``priority`` only those hit in one of these groups."""
    wanted = F.col("grp").isin(*priority) if priority else F.lit(True)
    return hits.groupBy("query_id", "cand_id").agg(F.max(wanted).alias("_wanted"), F.count("*").alias("n_groups")).filter("_wanted").drop("_wanted")


def sims_matrix(hits: DataFrame, groups: list[str]) -> DataFrame:
    """A column of similarity for each group, 0 where a candidate is not among the group's hits."""
    return hits.groupBy("query_id", "cand_id").pivot("grp", groups).agg(F.max("sim")).fillna(0.0, groups)


def group_stats(hits: DataFrame) -> DataFrame:
    """Mean and population deviation (at least 1e-6) of a group's similarities for each query."""
    return hits.groupBy("query_id", "grp").agg(F.avg("sim").alias("mean"), F.greatest(F.stddev_pop("sim"), F.lit(1e-6)).alias("std"))


def hashed_encoder(texts: DataFrame, id_cols: list[str], text: str, features: int = 256) -> DataFrame:
    """A default text encoder: hashed term frequencies by inverse document frequency, to unit length."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+").transform(texts)
    counts = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features).transform(words)
    scaled = IDF(inputCol="_tf", outputCol="_i", minDocFreq=1).fit(counts).transform(counts)
    unit = Normalizer(inputCol="_i", outputCol="_u").transform(scaled)
    return unit.select(*id_cols, vector_to_array("_u", "float32").alias("vec"))


def embed_groups(entities: DataFrame, id_col: str, groups: dict[str, list[str]], numeric: tuple[str, ...] = (), encoder=hashed_encoder) -> DataFrame:
    """``entity_id, grp, text, vec``: a text per group of fields and its vector; no text, null vector.

    A group without fields gives no rows; numeric fields belong in no group.
    """
    from ..functions.scalars import profile_text

    wrong = [f for fields in groups.values() for f in fields if f in numeric]
    if wrong:
        raise ValueError(f"numeric fields in a group: {wrong}")
    said = F.array(*[F.struct(F.lit(g).alias("grp"), profile_text([(f, F.col(f)) for f in fields]).alias("text")) for g, fields in groups.items() if fields])
    texts = entities.select(F.col(id_col).alias("entity_id"), F.explode(said).alias("s")).select("entity_id", "s.grp", "s.text")
    vectors = encoder(texts.filter("text <> ''"), ["entity_id", "grp"], "text")
    return texts.join(vectors, ["entity_id", "grp"], "left")
