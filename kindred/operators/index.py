"""Approximate retrieval: coarse lists with product-quantised residuals, re-ranked exactly.

Codebooks are fitted on a bounded sample of each group; every vector is indexed as a list and a few bytes.  A query is
scored against the bytes of its nearest lists by tables of distances, and only its best candidates are compared in full,
in the task that scored them: what comes out is k rows for each query and part of its group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .pivots import distances, unit_rows
from .vectors import DIGITS, ranked

#: Rows of a group that the codebooks are fitted on, at most; all rows are indexed.
SAMPLE = 20_000
CODES = 256


def centres_of(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centres, started at rows drawn far from each other; fewer where there are fewer rows."""
    rng, k = np.random.default_rng(seed), min(k, len(rows))
    centres, near = rows[[rng.integers(len(rows))]], None
    while len(centres) < k:
        d = distances(rows, centres[-1:]).ravel() ** 2
        near = d if near is None else np.minimum(near, d)
        total = near.sum()
        pick = rng.choice(len(rows), p=near / total) if total > 0 else rng.integers(len(rows))
        centres = np.vstack([centres, rows[pick]])
    for _ in range(rounds):
        own = distances(rows, centres).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def codebooks(vectors: DataFrame, lists: int | None, parts: int, seed: int = 42, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each group the lists' centres and, for each of ``parts`` pieces of a residual, its code words.

    All groups are fitted in one job, each on at most ``sample`` rows by hash.  The number of lists grows with a
    group's vectors (a quarter of the root, at least 10) unless ``lists`` sets it.
    """
    counts = vectors.groupBy("grp").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64("entity_id", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    drawn = vectors.join(F.broadcast(counts), "grp").withColumn("_h", draw).filter(F.col("_h") * F.col("_n") <= 1.1 * sample)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("_h", "entity_id"))
    drawn = drawn.select("grp", "vec", "_n", place.alias("_k")).filter(F.col("_k") <= sample)

    def fit(table: pa.Table) -> pa.Table:
        rows, n = unit_rows(table.column("vec")), table.column("_n")[0].as_py()
        coarse = centres_of(rows, lists or max(10, round(n**0.5 / 4)), 15, seed)
        rest = rows - coarse[distances(rows, coarse).argmin(axis=1)]
        words = [centres_of(piece, CODES, 10, seed) for piece in np.array_split(rest, parts, axis=1)]
        made = [("list", 0, c.tolist()) for c in coarse] + [("word", p, w.tolist()) for p, each in enumerate(words) for w in each]
        return pa.table({"grp": [table.column("grp")[0].as_py()] * len(made), "kind": [m[0] for m in made], "part": pa.array([m[1] for m in made], pa.int32()), "place": pa.array(range(len(made)), pa.int32()), "vec": pa.array([m[2] for m in made], pa.list_(pa.float64()))})

    rows = drawn.groupBy("grp").applyInArrow(fit, "grp string, kind string, part int, place int, vec array<double>").orderBy("grp", "place").collect()
    books: dict[str, tuple[list, list]] = {}
    for r in rows:  # lists and code words alone
        coarse, words = books.setdefault(r.grp, ([], [[] for _ in range(parts)]))
        (coarse if r.kind == "list" else words[r.part]).append(r.vec)
    return {g: (np.array(c), [np.array(w) for w in ws]) for g, (c, ws) in books.items()}


def indexed(vectors: DataFrame, books: dict, parts: int, cuts: dict[str, int]) -> DataFrame:
    """``grp, part, ids, lists, codes, rows``: every vector's id, list, a byte for each piece of its residual and itself at
    unit length, packed (a row for each batch, group and part).  ``cuts`` are the parts of a group; an id's hash deals it."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encoded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch.column("grp").to_pylist(), object)
            rows, ids = unit_rows(batch.column("vec")), batch.column("entity_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for grp in set(groups.tolist()) & set(shared.value):
                coarse, words = shared.value[grp]
                with np.errstate(over="ignore"):
                    part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % cuts[grp]
                for p in range(cuts[grp]):
                    own = np.flatnonzero((groups == grp) & (part == p))
                    if len(own):
                        lists = distances(rows[own], coarse).argmin(axis=1)
                        rest = np.array_split(rows[own] - coarse[lists], parts, axis=1)
                        codes = np.stack([distances(x, w).argmin(axis=1) for x, w in zip(rest, words)], axis=1).astype(np.uint8)
                        packed = [x.tobytes() for x in (ids[own], lists.astype(np.int32), codes, rows[own])]
                        yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], ["grp", "part", "ids", "lists", "codes", "rows"])

    return vectors.select("grp", "entity_id", "vec").mapInArrow(encoded, "grp string, part int, ids binary, lists binary, codes binary, rows binary")


class Part:
    """A part of a group's index, list after list, to be searched query by query.

    A code's squared distance is that of the query to the list's centre, a constant of the code, and less twice the query's
    products with the code words, which are looked up (two pieces at a time beyond ``single`` codes).
    """

    def __init__(self, packed: pa.Table, coarse: np.ndarray, words: list[np.ndarray], single: int = 1 << 16):
        joined = lambda c, t: np.frombuffer(b"".join(packed.column(c).to_pylist()), t)
        lists = joined("lists", np.int32)
        by = np.argsort(lists, kind="stable")
        self.coarse, self.words, self.sizes = coarse, words, np.bincount(lists, minlength=len(coarse))
        self.ids = joined("ids", np.int64)[by]
        self.rows = joined("rows", np.float64).reshape(len(by), -1)[by]
        code = joined("codes", np.uint8).reshape(len(by), -1)[by]
        self.constant, at = np.zeros(len(by)), 0
        for p, w in enumerate(words):
            of_list = (w * w).sum(axis=1) + 2 * coarse[:, at : at + w.shape[1]] @ w.T
            self.constant += of_list[lists[by], code[:, p]]
            at += w.shape[1]
        self.paired = len(by) > single and len(words) % 2 == 0
        wide = np.ascontiguousarray(code)
        self.codes = np.ascontiguousarray((wide.view("<u2") if self.paired else wide).T)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]

    def nearest(self, name: int, row: np.ndarray, probes: float | int, full: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the k best of the ``full`` best by code in the query's nearest lists."""
        away = distances(row[None], self.coarse)[0]
        most = min(len(away), int(probes if probes >= 1 else np.ceil(probes * len(away))))
        base = np.full(len(away), np.inf)
        near = np.argsort(away, kind="stable")[:most]
        base[near] = away[near] ** 2
        far = np.repeat(base, self.sizes) + self.constant
        cut = np.cumsum([w.shape[1] for w in self.words])[:-1]
        tables = [-2 * (w @ x) for w, x in zip(self.words, np.split(row, cut))]
        if self.paired:
            tables = [np.add.outer(np.pad(y, (0, CODES - len(y))), np.pad(x, (0, CODES - len(x)))).ravel() for x, y in zip(tables[::2], tables[1::2])]
        for table, code in zip(tables, self.codes):
            far += table[code]
        far[self.by_id[np.searchsorted(self.sorted_ids, name, "left") : np.searchsorted(self.sorted_ids, name, "right")]] = np.inf
        best = np.flatnonzero(far <= (np.partition(far, full - 1)[full - 1] if len(far) > full else np.inf))
        best = best[np.isfinite(far[best])]
        best = best[np.lexsort((self.ids[best], far[best]))][:full]
        sims = np.round((self.rows[best] * row).sum(axis=1), DIGITS)
        first = np.lexsort((self.ids[best], -sims))[:k]
        return self.ids[best][first], sims[first]


def topk_ivf(queries: DataFrame, vectors: DataFrame, k: int, lists: int | None = None, probes: float | int = 0.8, parts: int = 8, rerank: int | None = None, share: float = 0.1, seed: int = 42, part_rows: int = 1_000_000, query_rows: int = 2_000) -> DataFrame:
    """Approximate :func:`~kindred.operators.vectors.topk_by_group`: ``query_id, grp, cand_id, sim, rank``.

    A query's ``probes`` nearest lists (a share of them below 1) are scored by code, and its ``rerank`` best candidates
    over all of them are compared in full: not given, a ``share`` of its group's vectors, from k up to 50 k.  Null
    vectors are skipped, a query never finds itself, and a table without vectors gives no rows.  What travels with the
    tasks are centres and ``parts`` times 256 code words a group.

    A task has about ``query_rows`` queries and the packed index of their group, which is copied for each such chunk of
    queries.  An index of more than ``part_rows`` vectors is cut into parts, each of which compares as many candidates, so
    that a query's are a superset.
    """
    vectors, queries = vectors.filter("vec is not null"), queries.filter("vec is not null")
    books = codebooks(vectors, lists, parts, seed)
    n = {r["grp"]: r["n"] for r in vectors.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for each group, as books
    cuts = {g: -(-n[g] // part_rows) for g in books}
    full = {g: rerank or min(50 * k, max(k, int(np.floor(n[g] * share)))) for g in books}
    m = {r["grp"]: r["n"] for r in queries.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    chunks = {g: -(-m[g] // query_rows) for g in books if g in m}
    shape = queries.sparkSession.createDataFrame([(g, cuts[g], c) for g, c in chunks.items()], "grp string, _parts int, _chunks int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = F.pmod(F.xxhash64("entity_id"), F.col("_chunks")).cast("int")
    left = queries.join(F.broadcast(shape), "grp").select("grp", "entity_id", "vec", own.alias("_q"), each("_parts").alias("part"))
    packed = written(indexed(vectors, books, parts, cuts), "codes")
    right = packed.join(F.broadcast(shape), "grp").select("grp", "part", "ids", "lists", "codes", "rows", each("_chunks").alias("_q"))
    shared = vectors.sparkSession.sparkContext.broadcast((books, full))

    def searched(asking: pa.Table, listed: pa.Table) -> pa.Table:
        who, found, near, grp = [], [], [], ""
        if asking.num_rows and listed.num_rows:
            grp = asking.column("grp")[0].as_py()
            part = Part(listed, *shared.value[0][grp])
            for name, row in zip(asking.column("entity_id").to_pylist(), unit_rows(asking.column("vec"))):
                ids, sims = part.nearest(name, row, probes, shared.value[1][grp], k)
                who.append(np.full(len(ids), name, np.int64))
                found.append(ids)
                near.append(sims)
        flat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        whose = flat(who, pa.int64())
        return pa.table({"query_id": whose, "grp": pa.array([grp] * len(whose), pa.string()), "cand_id": flat(found, pa.int64()), "sim": flat(near, pa.float64())})

    by = ["grp", "part", "_q"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(searched, "query_id long, grp string, cand_id long, sim double")
    return ranked(hits, k)
