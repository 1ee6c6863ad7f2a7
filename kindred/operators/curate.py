"""Curation of annotated items: label propagation, manifests, truth tables, splits, samples and audits.

Annotations are long: ``id, feature_name, annotation_type, feature_value, confidence``, one row per the first three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import numbered_by, small, written
from ..sources.tables import insert_ignore
from .gates import null_tolerant_gate


def unpivoted(df: DataFrame, id_col: str, features: Sequence[str], kind: str) -> DataFrame:
    """Columns to annotations; null values give no row."""
    each = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("string").alias("feature_value")) for f in features])
    return df.select(F.col(id_col).alias("id"), F.explode(each).alias("s")).select("id", "s.feature_name", F.lit(kind).alias("annotation_type"), "s.feature_value").filter("feature_value is not null")


def propagate_labels(items: DataFrame, entities: DataFrame, entity: str, fields: dict[str, Sequence[str]], existing: DataFrame, kind: str = "propagated") -> DataFrame:
    """Items take over their entity's values as annotations of confidence 1.

    ``fields`` gives each feature's canonical classes; a value counts without regard to case, others are left out.
    Annotations that exist stay as they are.
    """
    values = unpivoted(entities, entity, list(fields), kind).withColumnRenamed("id", "_entity")
    known = F.create_map(*[x for f, classes in fields.items() for c in classes for x in (F.lit(f"{f}={c.lower()}"), F.lit(c))])
    named = values.withColumn("feature_value", F.try_element_at(known, F.concat("feature_name", F.lit("="), F.lower("feature_value")))).filter("feature_value is not null")
    new = items.select("id", F.col(entity).alias("_entity")).join(named, "_entity").select("id", "feature_name", "annotation_type", "feature_value", F.lit(1.0).alias("confidence"))
    return insert_ignore(new, existing, ["id", "feature_name", "annotation_type"])


def full_pool(items: DataFrame, annotations: DataFrame, gates: dict) -> DataFrame:
    """Items that pass the gates, labelled or not."""
    return null_tolerant_gate(items, annotations, gates)


def build_manifest(items: DataFrame, annotations: DataFrame, feature: str, kind: str, gates: dict, vectors: DataFrame) -> DataFrame:
    """Labelled items that pass the gates and have a vector: the item's columns with ``label``."""
    labelled = annotations.filter((F.col("feature_name") == feature) & (F.col("annotation_type") == kind) & F.col("feature_value").isNotNull()).select("id", F.col("feature_value").alias("label"))
    return full_pool(items, annotations, gates).join(labelled, "id").join(vectors.select("id"), "id", "left_semi")


def pivot_annotations(base: DataFrame, annotations: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per id with a column per feature (the least value where there are several)."""
    wide = annotations.groupBy("id").pivot("feature_name", list(features)).agg(F.min("feature_value"))
    return base.join(wide, "id", "left")


def wide_to_annotations(df: DataFrame, id_col: str, features: Sequence[str], confidence: Column, kind: str) -> DataFrame:
    """Graded records to annotations with numeric confidence (unknown level: 0.5)."""
    level = S.mapped(confidence, S.GRADED_CONFIDENCE, 0.5)
    each = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("string").alias("feature_value")) for f in features])
    return df.select(F.col(id_col).alias("id"), level.alias("confidence"), F.explode(each).alias("s")).select("id", "s.feature_name", F.lit(kind).alias("annotation_type"), "s.feature_value", "confidence")


def exclude_reason(unusable: Column, no_subject: Column, absent: Column) -> Column:
    """The first reason that holds, in this order; null when none does."""
    return F.when(unusable, "unusable").when(no_subject, "no_subject").when(absent, "subject_absent")


def enforce_consistency(df: DataFrame) -> DataFrame:
    """``visible, value, confidence, description`` made to agree: what is not visible has no value and can't be told;
    what can't be told has no value; what has a value is visible."""
    hidden = ~F.coalesce("visible", F.lit(False)) & F.col("value").isNull() | (F.col("visible") == F.lit(False))
    out = df.withColumns({"value": F.when(hidden, None).otherwise(F.col("value")), "description": F.when(hidden, None).otherwise(F.col("description")), "confidence": F.when(hidden, "cannot_tell").otherwise(F.col("confidence"))})
    out = out.withColumn("value", F.when(F.col("confidence") == "cannot_tell", None).otherwise(F.col("value")))
    return out.withColumn("visible", F.when(F.col("value").isNotNull(), True).otherwise(F.coalesce("visible", F.lit(False))))


def merge_stages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two stages of a staged reading: without a first value there is none, a null second value abstains, confidence
    is the lower one and the text the second's, if any.  Both are ``id, value, confidence, text``."""
    b = second.select("id", *[F.col(c).alias(f"_{c}") for c in ("value", "confidence", "text")])
    met = first.join(b, "id", "left")
    value = F.when(F.col("value").isNull() | (F.col("confidence") == "cannot_tell"), None).otherwise(F.col("_value"))
    return met.select("id", value.alias("value"), F.when(value.isNull(), "cannot_tell").otherwise(S.lower_confidence(F.col("confidence"), F.col("_confidence"))).alias("confidence"), F.coalesce("_text", "text").alias("text"))


def truth_multilabel(entities: DataFrame, entity: str, text: str, canonical: Sequence[str], aliases: dict[str, str], corrections: DataFrame | None = None) -> DataFrame:
    """``entity, truths``: canonical values of a free text (itself, its alias, else every canonical it contains), with
    people's corrections ``(entity, value)``, which may add entities; sorted and distinct."""
    c = F.lower(F.trim(F.col(text)))
    names = F.array(*[F.lit(x) for x in canonical])
    alias = F.try_element_at(F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k.lower()), F.lit(v))]), c) if aliases else F.lit(None).cast("string")
    found = F.when(F.array_contains(names, c), F.array(c)).when(alias.isNotNull(), F.array(alias)).otherwise(F.filter(names, lambda x: F.contains(c, x)))
    values = entities.select(F.col(entity).alias("entity"), F.explode(found).alias("value"))
    if corrections is not None:
        values = values.union(corrections.select("entity", "value"))
    return values.groupBy("entity").agg(F.sort_array(F.collect_set("value")).alias("truths"))


def size_gate(df: DataFrame, width: Column, height: Column, least: float = 100, most_aspect: float = 3.0) -> DataFrame:
    """``reason`` for items too small or too long drawn, in this order, else null."""
    short, long = F.least(width, height), F.greatest(width, height)
    small = F.concat(F.lit("too_small ("), width.cast("long").cast("string"), F.lit("x"), height.cast("long").cast("string"), F.lit(")"))
    aspect = long / short
    return df.withColumn("reason", F.when(short < least, small).when(aspect > most_aspect, F.concat(F.lit("bad_aspect ("), F.floor(aspect).cast("string"), F.lit(")"))))


def cap_per_entity(df: DataFrame, entity: str, order: Sequence[Column | str], most: int = 20) -> DataFrame:
    """At most ``most`` rows of each entity, the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def exact_name_first(found: DataFrame, asked: str, name: str, order: Sequence[str]) -> DataFrame:
    """One row of ``found`` for each ``asked`` name: the first in order that bears it, without regard to case, else the first.

    ``exact`` tells which.  An aggregate, so that a name with many finds is reduced before the shuffle.
    """
    exact = F.coalesce(F.lower(name) == F.lower(asked), F.lit(False))
    whole = F.struct(*[c for c in found.columns if c != asked], exact.alias("exact"))
    best = found.groupBy(asked).agg(F.min_by(whole, F.struct(~exact, *order)).alias("_best"))
    return best.select(asked, "_best.*")


def class_counts(df: DataFrame, label: str, entity: str) -> DataFrame:
    """Rows and distinct entities of each class."""
    return df.groupBy(label).agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"))


def drop_rare_classes(df: DataFrame, label: str, entity: str, least: int = 3) -> DataFrame:
    """Rows whose class has at least so many entities."""
    rare = class_counts(df, label, entity).filter(F.col("n_entities") < least).select(F.col(label).alias("_rare"))
    return df.join(rare, df[label].eqNullSafe(F.col("_rare")), "left_anti")


def group_split(df: DataFrame, group: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``group, fold``: whole groups, test first, then validation, by a hash order of the groups' names."""
    groups = df.select(group).distinct()
    n = groups.count()
    test = int((1 - train - val) * n + 0.5 + 1e-9)
    held = test + int((n - test) * val / (train + val) + 0.5)
    place = F.col("_place")
    drawn = numbered_by(groups, F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))), group, "_place")
    return drawn.select(group, F.when(place <= test, "test").when(place <= held, "val").otherwise("train").alias("fold"))


def leakage(assigned: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that are in more than one fold (none, if the split holds)."""
    return assigned.groupBy(group).agg(F.countDistinct(fold).alias("folds")).filter("folds > 1")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, class_weight, sampling_weight``: n / (classes * count), and 1 / sqrt(count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("class_weight"), (1 / F.sqrt("n")).alias("sampling_weight"))


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def random_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) by a hash order; only rows under a threshold go to the task that orders them."""
    total = df.count()
    if total > 4 * n + 400:
        some = df.filter(F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") <= (2 * n + 200) / total * (1 << 32))
        df = some if some.count() >= n else df
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def coverage_select(df: DataFrame, label: str, entity: str, id_col: str, target: int, per_class: int = 3, seed: int = 42, second: str | None = None) -> DataFrame:
    """Entities that cover every class, rarest first, then whole entities by hash order up to about ``target`` rows.

    An entity's class is its most frequent label (ties by name).  With ``second``, classes of a second label that the
    first pass left uncovered get one entity each.  The fill goes through the other entities in hash order: each is taken
    until 0.85 of the target is reached; from there one that would lead beyond 1.15 of it is passed over and the next
    are tried; at 1.15 the fill ends.  Entities without a name are left out; an empty table gives no rows.
    """
    df = df.filter(F.col(entity).isNotNull())

    def classes(name: str) -> DataFrame:
        votes = df.groupBy(entity, name).agg(F.count("*").alias("n"))
        return votes.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), name))).filter("_k = 1").select(entity, F.col(name).alias("_class"))

    def best(c: DataFrame, most: int) -> DataFrame:
        return c.withColumn("_k", F.row_number().over(Window.partitionBy("_class").orderBy(hash_order(entity, seed), entity))).filter(F.col("_k") <= most).select(entity)

    chosen = best(classes(label), per_class)
    if second:
        b = classes(second)
        covered = b.join(chosen, entity, "left_semi").select("_class").distinct()
        chosen = chosen.union(best(b.join(covered, "_class", "left_anti"), 1)).distinct()
    sizes = df.groupBy(entity).agg(F.count("*").alias("n")).join(chosen.withColumn("_chosen", F.lit(1)), entity, "left")
    sizes = written(sizes.withColumn("_d", hash_order(entity, seed)).withColumn("_e", F.col(entity).cast("string")), "sizes")
    start = sizes.agg(F.coalesce(F.sum(F.when(F.col("_chosen").isNotNull(), F.col("n"))), F.lit(0)).alias("n")).first()["n"]
    taken = F.col("_chosen").isNotNull()
    for first, last, most in filled(sizes.filter("_chosen is null"), start, 0.85 * target, 1.15 * target):
        taken = taken | (F.col("_chosen").isNull() & (F.col("n") <= most) & (at() > at(first)) & (at() <= at(last)))
    return sizes.filter(taken).select(entity, F.col("_chosen").isNotNull().alias("for_coverage"))


def at(place: tuple[str, str] | None = None) -> Column:
    """A row's place in hash order, or a given one."""
    return F.struct(F.col("_d"), F.col("_e")) if place is None else F.struct(F.lit(place[0]).alias("_d"), F.lit(place[1]).alias("_e"))


def filled(rows: DataFrame, total: int, enough: float, most: float) -> list[tuple[tuple[str, str], tuple[str, str], float]]:
    """What a sequential fill in the order of ``rows(_d, _e, n)`` takes, as ranges ``(after, up to, largest n)``.

    Until ``enough`` everything is taken.  From there a range is what fits one by one: rows no larger than what is left,
    up to the first that no longer fits with those before it; it is passed over for good, as what is left only falls, and
    the next range begins behind it.  Each range needs sums of 4,096 buckets of the hash and one bucket's rows in
    order, so no task sees all rows; ranges end when nothing fits.
    """
    ranges, after = [], ("", "")
    while total < most:
        free = enough <= total
        # before enough is reached, the row that crosses it is taken whatever its size
        room = most - total if free else enough - total
        open_ = rows.filter((F.col("n") <= room) if free else F.lit(True)).filter(at() > at(after))
        bucket = F.substring("_d", 1, 3)
        before, crossing = 0, None
        for b, n in sorted(tuple(r) for r in open_.groupBy(bucket).agg(F.sum("n")).collect()):  # 4,096 at most
            if before + n > room if free else before + n >= room:
                crossing = b
                break
            before += n
        if crossing is None:  # all that is left is taken
            end = open_.agg(F.max(at())).first()[0]
            if end is None:
                break
            ranges.append((after, tuple(end), float(room) if free else float("inf")))
            after, total = tuple(end), total + before
            if free:
                break
            continue
        within = open_.filter(bucket == crossing).withColumn("_sum", F.lit(before) + F.sum("n").over(Window.partitionBy(bucket).orderBy("_d", "_e")))
        if free:
            got = within.agg(F.max(F.when(F.col("_sum") <= room, at())), F.max(F.when(F.col("_sum") <= room, F.col("_sum"))), F.min(F.when(F.col("_sum") > room, at()))).first()
            end, added, skipped = got[0], got[1] or before, tuple(got[2])
            ranges.append((after, tuple(end) if end else (crossing, ""), float(room)))
            after, total = skipped, total + added
        else:
            end, added = within.filter(F.col("_sum") >= room).agg(F.min(at()), F.min("_sum")).first()
            ranges.append((after, tuple(end), float("inf")))
            after, total = tuple(end), total + added
    return ranges


def stratified_sample(df: DataFrame, strata: list[tuple[str, Column, float]], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows by shares of strata; a row belongs to the first stratum whose condition holds, else to ``random``,
    which also takes what others fall short of."""
    named = F.lit(None).cast("string")
    for name, condition, _ in reversed(strata):
        named = F.when(condition, name).otherwise(named)
    marked = df.withColumn("stratum", F.coalesce(named, F.lit("random")))
    placed = marked.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(id_col, seed), id_col))).filter(F.col("_k") <= n)
    quota = S.mapped(F.col("stratum"), {name: int(share * n) for name, _, share in strata}, 0)
    first = placed.withColumn("_first", F.col("_k") <= quota)
    order = Window.orderBy(F.desc("_first"), hash_order(id_col, seed), id_col)
    return first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_k", "_first", "_n")


def agreement(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``field, verdict, n`` of two opinions (see :func:`kindred.functions.scalars.agree`)."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), S.agree(a, b).alias("verdict")) for f, (a, b) in fields.items()])
    return df.select(F.explode(each).alias("s")).groupBy(F.col("s.field").alias("field"), F.col("s.verdict").alias("verdict")).agg(F.count("*").alias("n"))


def error_audit(predictions: DataFrame, truth: DataFrame, include_correct: bool = False) -> DataFrame:
    """Predictions ``(id, value)`` against ``truth(id, strict, truths)``: strict and multi-label match; abstentions
    are skipped and correct rows left out unless asked for."""
    met = predictions.filter("value is not null").join(truth, "id")
    out = met.withColumns({"strict_match": F.coalesce(F.col("value") == F.col("strict"), F.lit(False)), "multi_match": F.coalesce(F.array_contains("truths", F.col("value")), F.lit(False))})
    return out if include_correct else out.filter("not (strict_match or multi_match)")


def pending_ids(every: DataFrame, done: DataFrame, ok: Column, id_col: str) -> DataFrame:
    """Ids without a successful row; failed ones come again."""
    return every.select(id_col).distinct().join(done.filter(ok).select(id_col), id_col, "left_anti")


def applicability_gate(df: DataFrame, view: str, matrix: DataFrame, feature: str) -> DataFrame:
    """Rows whose view can show the feature, by ``matrix(feature, view)``."""
    allowed = small(matrix.filter(F.col("feature") == feature).select(F.col("view").alias("_view")))
    return df.join(allowed, df[view] == F.col("_view"), "left_semi")
