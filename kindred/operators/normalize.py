"""Vocabulary normalisation of observations and their reconciliation into one record per entity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import numbered_by, rows_by_key, small
from .pivots import unit_rows

#: References travel to the tasks in blocks of so many.
MOST_REFS = 50_000
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def apply_aliases(df: DataFrame, fields: dict[str, str], alias: DataFrame) -> DataFrame:
    """Replace values by their canonical ones, field by vocabulary key, without regard to case."""
    out, rows = df, rows_by_key(alias, fields.values())
    for field, key in fields.items():
        table = small(alias.filter(F.col("key") == key).select(F.col("alias_lc").alias("_lc"), F.col("canonical").alias("_c")), rows[key])
        out = out.join(table, F.lower(F.trim(out[field])) == table["_lc"], "left").withColumn(field, F.coalesce("_c", field)).drop("_lc", "_c")
    return out


def enforce_vocabulary(df: DataFrame, fields: dict[str, str], canonical: DataFrame, fallback: DataFrame | None = None, open_keys: Sequence[str] = ()) -> DataFrame:
    """Values outside their vocabulary become their fallback ``(key, term, value)`` or null; open vocabularies pass."""
    out, rows = df, rows_by_key(canonical, fields.values())
    near_rows = rows_by_key(fallback, fields.values()) if fallback is not None else {}
    for field, key in fields.items():
        if key in open_keys:
            continue
        table = small(canonical.filter(F.col("key") == key).select(F.col("value").alias("_v")), rows[key])
        out = out.join(table, out[field] == table["_v"], "left")
        value = F.col("_v")
        if fallback is not None:
            near = small(fallback.filter(F.col("key") == key).select(F.col("term").alias("_t"), F.col("value").alias("_f")), near_rows[key])
            out = out.join(near, out[field] == near["_t"], "left")
            value = F.coalesce("_v", "_f")
        out = out.withColumn(field, value).drop("_v", "_t", "_f")
    return out


def nearest_canonical(vectors: DataFrame, refs: DataFrame, least: float = 0.82, block: int = MOST_REFS) -> DataFrame:
    """``id, ref, sim``: the reference nearest by cosine (ties: the first by name), null under ``least``.

    References ``(ref, vec)`` travel to the tasks in blocks of ``block`` rows, a matrix product each; the blocks' best are
    compared afterwards.  A null vector has neither reference nor similarity; without references there are no rows.
    """
    placed = numbered_by(refs.filter("vec is not null"), F.md5(F.col("ref").cast("string")), "ref", "_place")
    n, best = placed.count(), None
    kind = refs.schema["ref"].dataType
    for start in range(0, n, block):
        part = placed.filter((F.col("_place") > start) & (F.col("_place") <= start + block)).orderBy("ref").toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((part.column("ref").to_pylist(), unit_rows(part.column("vec")).T))

        def nearest(batches, shared=shared):
            for batch in batches:
                if batch.num_rows:
                    names, matrix = shared.value
                    known = np.flatnonzero(batch.column("vec").is_valid().to_numpy(zero_copy_only=False))
                    found, sims = [None] * batch.num_rows, [None] * batch.num_rows
                    width = 1 + (1 << 22) // len(names)
                    for a in range(0, len(known), width):
                        rows = known[a : a + width]
                        all_ = np.round(unit_rows(batch.column("vec").take(pa.array(rows))) @ matrix, 6)
                        for r, k, sim in zip(rows.tolist(), all_.argmax(axis=1).tolist(), all_.max(axis=1).tolist()):
                            found[r], sims[r] = names[k], sim
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, to_arrow_type(kind)), pa.array(sims, pa.float64())], ["id", "ref", "sim"])

        given = vectors.select("id", "vec")
        got = given.mapInArrow(nearest, StructType([given.schema["id"], StructField("ref", kind), StructField("sim", DoubleType())]))
        best = got if best is None else best.unionByName(got)
    if best is None:
        return vectors.select("id", F.lit(None).cast(kind).alias("ref"), F.lit(None).cast("double").alias("sim")).limit(0)
    if n > block:
        best = best.groupBy("id").agg(F.min_by("ref", F.struct(-F.col("sim"), F.col("ref"))).alias("ref"), F.max("sim").alias("sim"))
    return best.withColumn("ref", F.when(F.col("sim") >= least, F.col("ref")))


def merge_ranges(observations: DataFrame, entity: str, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Least lower and greatest upper bound per entity, nulls aside: ``<name>_min, <name>_max``."""
    aggs = [x for name, (low, high) in ranges.items() for x in (F.min(low).alias(f"{name}_min"), F.max(high).alias(f"{name}_max"))]
    return observations.groupBy(entity).agg(*aggs)


def merge_lists(observations: DataFrame, entity: str, source: str, listed: str) -> DataFrame:
    """Union of lists per entity in first-seen order: by source, then place in the list (ties by value).

    Repeats collapse before anything is gathered, so a row's list holds distinct values only.
    """
    values = observations.select(entity, F.col(source).alias("_s"), F.posexplode_outer(listed).alias("_k", "_v"))
    first = values.groupBy(entity, "_v").agg(F.min(F.struct("_s", "_k")).alias("_f"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_f", "_v"))))
    return first.groupBy(entity).agg(F.transform(in_order, lambda s: s["_v"]).alias(listed))


def merge_values(observations: DataFrame, entity: str, source: str, value: str) -> DataFrame:
    """Distinct values per entity by the first source that has them (ties by value).

    Repeats collapse before anything is gathered, so a row's list holds distinct values only.
    """
    first = observations.filter(F.col(value).isNotNull()).groupBy(entity, value).agg(F.min(source).alias("_s"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("_s"), F.col(value))))
    return first.groupBy(entity).agg(F.transform(in_order, lambda s: s[value]).alias(value))


def calendar_order(c: Column) -> Column:
    """Month names in calendar order, unknown ones last (by name)."""
    place = lambda m: F.nullif(F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(m)), F.lit(0))
    keyed = F.transform(c, lambda m: F.struct(F.coalesce(place(m), F.lit(99)).alias("k"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda s: s["m"])


def resolve_scalar_conflicts(observations: DataFrame, entity: str, source: str, fields: list[str], safety: Sequence[str] = ()) -> DataFrame:
    """Vote per entity and field: most sources, then the earliest source, then the least value.

    Columns: the fields, ``conflicts`` (fields with several values, in order), ``confidence`` (mean share of the
    winning value, 1.0 with one source) and ``needs_review`` (a safety field conflicts).
    """
    long = observations.select(entity, source, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("s")).select(entity, source, "s.field", "s.value").filter("value is not null")
    votes = long.groupBy(entity, "field", "value").agg(F.countDistinct(source).alias("n"), F.min(source).alias("first"))
    by_field = Window.partitionBy(entity, "field")
    ranked = votes.withColumn("_k", F.row_number().over(by_field.orderBy(F.desc("n"), "first", "value"))).withColumn("_all", F.sum("n").over(by_field)).withColumn("_values", F.count("*").over(by_field))
    won = ranked.filter("_k = 1")
    conflict = F.when(F.col("_values") > 1, F.col("field"))
    return won.groupBy(entity).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields],
        F.sort_array(F.collect_list(conflict)).alias("conflicts"),
        F.avg(F.col("n") / F.col("_all")).alias("confidence"),
        F.coalesce(F.max(conflict.isin(*safety)) if safety else F.lit(None), F.lit(False)).alias("needs_review"),
    )


def safest_value(observations: DataFrame, entity: str, value: str, order: Sequence[str]) -> DataFrame:
    """The most cautious value per entity: the first in ``order``, unknown ones last, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(value)), F.lit(0)), F.lit(99))
    return observations.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, F.struct(rank, F.col(value))).alias(value))


def pick_images(observations: DataFrame, entity: str, source: str, url: str, order: str, most: int = 3) -> DataFrame:
    """The first image of each source, repeats aside, at most ``most`` per entity in source order: a sorted list."""
    first = observations.filter(F.col(url).isNotNull()).groupBy(entity, source).agg(F.min_by(url, F.struct(F.col(order), F.col(url))).alias(url))
    once = first.groupBy(entity, url).agg(F.min(source).alias(source))
    kept = once.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(source, url))).filter(F.col("_k") <= most)
    return kept.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", url))), lambda s: s[url]).alias("images"))


def apply_overrides(entities: DataFrame, directives: DataFrame, entity: str, fields: Sequence[str]) -> DataFrame:
    """Values that people have decided (``entity, field, resolved_value``) replace those of the entity."""
    wide = directives.groupBy(F.col("entity").alias("_e")).agg(*[F.max(F.when(F.col("field") == f, F.col("resolved_value"))).alias(f"_{f}") for f in fields])
    out = entities.join(wide, entities[entity] == F.col("_e"), "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}").cast(dict(entities.dtypes)[f]), F.col(f)) for f in fields}).drop("_e", *[f"_{f}" for f in fields])


def merge_sections(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Partial records of one entity as one row with a struct per part (null where a part is missing)."""
    out = None
    for name, part in parts.items():
        one = part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out


def stale_entities(observations: DataFrame, entities: DataFrame, entity: str, content: list[str], kept_hash: str = "content_hash") -> DataFrame:
    """Entities whose observations' content differs from what they were built from, or that were never built.

    The hash is a sum over rows, so rows may come in any order and no entity's rows are gathered.
    """
    now = observations.groupBy(entity).agg(content_sum(content).alias("new_hash"))
    return now.join(entities.select(entity, F.col(kept_hash).alias("old_hash")), entity, "left").filter(~F.col("new_hash").eqNullSafe(F.col("old_hash")))


def content_sum(content: list[str]) -> Column:
    """A hash of many rows that does not depend on their order."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content])), 1, 12), 16, 10).cast("long")
    return F.sum(part % 1_000_000_007)


def backfill_column(observations: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``key, old, new`` for rows whose value differs from the source's."""
    new = source.select(key, F.col(column).alias("new"))
    return observations.select(key, F.col(column).alias("old")).join(new, key).filter(~F.col("old").eqNullSafe(F.col("new")))


def translate_values(df: DataFrame, value: str, feature: Column, own: DataFrame, shared: DataFrame) -> DataFrame:
    """``translated``: by the feature's dictionary ``(feature, value, text)``, else the shared one ``(value, text)``, else itself."""
    a = small(own.select(F.col("feature").alias("_f"), F.col("value").alias("_v"), F.col("text").alias("_own")))
    b = small(shared.select(F.col("value").alias("_w"), F.col("text").alias("_shared")))
    out = df.withColumn("_feature", feature)
    out = out.join(a, (out["_feature"] == a["_f"]) & (out[value] == a["_v"]), "left").join(b, out[value] == b["_w"], "left")
    return out.withColumn("translated", F.coalesce("_own", "_shared", value)).drop("_feature", "_f", "_v", "_own", "_w", "_shared")
