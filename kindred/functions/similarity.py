"""Column functions that compare two values, lists, vectors or signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def rounded(x: Column, digits: int) -> Column:
    """``x`` at so many digits, halves away from zero.  What rounds to zero keeps its sign, as SQL's round does and Spark's
    does not."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def stepped(x: Column, digits: int) -> Column:
    """``x``, which is not negative, at so many digits, halves up.  SQL rounds a double by this arithmetic too; Spark's round
    goes through decimals, which is most of what a pair costs."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def l2_normalize(v: Column) -> Column:
    """The vector by its length, which counts as 1e-12 at least."""
    return F.transform(doubles(v), lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def vocab_similarity(a: Column, b: Column, matrix: dict[str, float]) -> Column:
    """1 for equal values, else the entry ``a-b`` or ``b-a``, else 0; null when a value is missing.

    The pair is looked up whole, since values may hold hyphens.
    """
    if not matrix:
        return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).otherwise(0.0)
    table = F.create_map(*[x for k, v in matrix.items() for x in (F.lit(k), F.lit(float(v)))])
    listed = F.coalesce(F.try_element_at(table, F.concat(a, F.lit("-"), b)), F.try_element_at(table, F.concat(b, F.lit("-"), a)), F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).otherwise(listed)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def list_similarity(a: Column, b: Column, matrix: dict[str, float]) -> Column:
    """Mean best match of each value in the other list, in both directions, averaged; 0 for an empty list."""
    best = lambda x, other: F.array_max(F.transform(other, lambda y: vocab_similarity(x, y, matrix)))
    both = (mean(F.transform(a, lambda x: best(x, b))) + mean(F.transform(b, lambda y: best(y, a)))) / 2
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0), both).otherwise(0.0)


def category_similarity(a: Column, b: Column, order: Sequence[str]) -> Column:
    """Ordinal distance 0, 1, more to 1, 0.5, 0; null when a category is missing or unknown."""
    at = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))
    apart = F.abs(at(a) - at(b))
    return F.when(apart == 0, 1.0).when(apart == 1, 0.5).when(apart > 1, 0.0)


def proximity(a: Column, b: Column, tolerance: float) -> Column:
    """1 for equal numbers down to 0 at the tolerance; null when a number is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / tolerance))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; null for an empty one."""
    known = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(known, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mean_of_known(*scores: Column) -> Column:
    """Mean of the scores that could be computed; 0 without any."""
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    known = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    return F.when(known > 0, total / known).otherwise(0.0)


def weighted_known(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the scores that are not null (weight 1 by default); 0 without any."""
    weights = weights or {}
    pairs = [(s, float(weights.get(k, 1.0))) for k, s in scores.items()]
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in pairs), F.lit(0.0))
    bottom = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in pairs), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def fuzzy_score(value: Column, truths: Column, matrix: dict[str, float]) -> Column:
    """Best similarity of a value to any truth; 0 for a missing value or no truth."""
    return F.coalesce(F.array_max(F.transform(truths, lambda t: vocab_similarity(value, t, matrix))), F.lit(0.0))


def context_boost(region: Column | None, regions: Column, season: Column | None, seasons: Column, step: float = 0.02) -> Column:
    """A step where the region is part of a listed one, and one where the season is listed (lower case)."""
    boost = F.lit(0.0)
    if region is not None:
        boost = boost + F.when(F.exists(regions, lambda r: F.contains(F.lower(r), F.lower(region))), step).otherwise(0.0)
    if season is not None:
        boost = boost + F.when(F.array_contains(F.transform(seasons, lambda s: F.lower(s)), F.lower(season)), step).otherwise(0.0)
    return boost


def signature_match(a: Column, b: Column) -> Column:
    """Share of equal fields among those known on both sides of two signatures; 0 when none is."""
    pairs = F.zip_with(F.split(a, r"\|"), F.split(b, r"\|"), lambda x, y: F.when((x != "?") & (y != "?"), (x == y).cast("double")))
    return mean_of_known_array(pairs)


def mean_of_known_array(values: Column) -> Column:
    known = F.filter(values, lambda x: x.isNotNull())
    return F.coalesce(F.when(F.size(known) > 0, mean(known)), F.lit(0.0))


def gate_equal(a: Column, b: Column) -> Column:
    """Equal without regard to case; an unknown side passes."""
    return a.isNull() | b.isNull() | (F.lower(a) == F.lower(b))


def gate_lowered(a: Column, b: Column) -> Column:
    """:func:`gate_equal` of values that are in lower case already."""
    return a.isNull() | b.isNull() | (a == b)


def safety(value: Column, safe: Sequence[str], dangerous: Sequence[str]) -> Column:
    """``safe``, ``dangerous`` or null for an unlisted value."""
    return F.when(F.lower(value).isin(*[x.lower() for x in safe]), "safe").when(F.lower(value).isin(*[x.lower() for x in dangerous]), "dangerous")


def gate_opposite(a: Column, b: Column, safe: Sequence[str], dangerous: Sequence[str]) -> Column:
    """Fails only when both sides are known and alike."""
    return gate_safety(safety(a, safe, dangerous), safety(b, safe, dangerous))


def gate_safety(x: Column, y: Column) -> Column:
    """:func:`gate_opposite` of what :func:`safety` gave for both sides."""
    return x.isNull() | y.isNull() | (x != y)


def long_words(text: Column) -> Column:
    """The words longer than one character (white space, lower case)."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 1)


def words_shared(a: Column, b: Column) -> Column:
    """Whether two texts share a word longer than one character."""
    return F.coalesce(F.size(F.array_intersect(long_words(a), long_words(b))) > 0, F.lit(False))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Probabilities of logits at a temperature, shifted by their largest."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    grown = F.transform(doubles(logits), lambda x: F.exp((x - F.array_max(doubles(logits))) / t))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda s, y: s + y))


def predict_contract(probabilities: Column, classes: Sequence[str], confident: float = 0.6, margin: float = 0.2, uncertain: float = 0.3) -> Column:
    """Struct of value, confidence, runner-up and status from class probabilities.

    Confident from a probability and a margin on, uncertain from a lower probability on; else the value is null.
    """
    named = F.arrays_zip(doubles(probabilities).alias("p"), F.sequence(F.lit(0), F.size(probabilities) - 1).alias("k"))
    ranked = F.array_sort(named, lambda x, y: F.when(x["p"] > y["p"], -1).when(x["p"] < y["p"], 1).otherwise(x["k"] - y["k"]))
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    name = lambda e: F.element_at(F.array(*[F.lit(c) for c in classes]), (e["k"] + 1).cast("int"))
    p1, p2 = first["p"], F.coalesce(second["p"], F.lit(0.0))
    status = F.when((p1 >= confident) & (p1 - p2 >= margin), "confident").when(p1 >= uncertain, "uncertain").otherwise("not_determinable")
    return F.struct(F.when(status != "not_determinable", name(first)).alias("value"), p1.alias("confidence"), name(second).alias("second"), p2.alias("second_confidence"), status.alias("status"))
