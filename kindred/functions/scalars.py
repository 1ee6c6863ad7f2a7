"""Column functions over nested profiles, text and measurements.  All stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as false, trimmed and in lower case (fixed values).
FALSE_WORDS = ("false", "no", "none", "null", "0", "absent", "")
#: Words of text fields that stand for null (fixed values).
NULL_WORDS = ("null", "none")
#: Confidence levels by rank, lowest first, and their numbers (fixed values).
LEVELS = ("cannot_tell", "low", "medium", "high")
SIDECAR_CONFIDENCE = {"high": 1.0, "low": 0.5, "cannot_tell": 0.0}
GRADED_CONFIDENCE = {"low": 0.33, "medium": 0.66, "high": 1.0}


def get_path(c: Column, path: str) -> Column:
    """Walk a dot-path through a struct, or through JSON text; null where a step is missing or no object."""
    return reduce(lambda x, step: x.getField(step), path.split("."), c)


def json_path(c: Column, path: str) -> Column:
    """A dot-path through JSON text as text; null where a step is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(c), "$." + path, "string")


def list_text(c: Column) -> Column:
    """A list as text joined by commas without nulls; null when nothing is left."""
    return F.nullif(F.array_join(F.filter(c, lambda x: x.isNotNull()), ", "), F.lit(""))


def bool_text(c: Column) -> Column:
    return F.when(c, "yes").when(~c, "no")


def element(c: Column, index: int) -> Column:
    """The element at a place counted from 0, null outside the list."""
    return F.try_element_at(c, F.lit(index + 1))


def profile_text(fields: Sequence[tuple[str, Column]]) -> Column:
    """``label: value`` sentences of the fields that have a value, in order, closed by a stop; empty without any.

    A label is the last segment of its path with blanks for underscores.
    """
    said = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(path.split(".")[-1].replace("_", " ") + ": "), v.cast("string"))) for path, v in fields]
    joined = F.concat_ws(". ", *said)
    return F.when(joined == "", "").otherwise(F.concat(joined, F.lit(".")))


def coerce_bool(c: Column) -> Column:
    """Text to boolean: everything but a few words is true; null stays null."""
    return ~F.lower(F.trim(c)).isin(*FALSE_WORDS)


def null_words(c: Column) -> Column:
    """Text that says null becomes null."""
    return F.when(F.lower(F.trim(c)).isin(*NULL_WORDS), None).otherwise(c)


def null_words_in_list(c: Column) -> Column:
    """Null words inside a list become null, and a null list becomes empty."""
    return F.coalesce(F.transform(c, null_words), F.array().cast("array<string>"))


def parse_number(c: Column) -> Column:
    """The first number in a text, or the mean of its first two; null without any (or where one is no number)."""
    found = F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"([\d.]+)"), F.lit(1)), 1, 2), lambda x: x.try_cast("double"))
    first, second = F.get(found, 0), F.get(found, 1)
    return F.when(F.size(found) >= 2, (first + second) / 2).otherwise(first)


def range_to_category(low: Column, high: Column, bins: Sequence[tuple[str, float | None]]) -> Column:
    """The first bin whose upper bound the midpoint (or the one end present) reaches; above all, the last."""
    middle = F.coalesce((low + high) / 2, low, high)
    named = reduce(lambda w, b: w.when(middle <= b[1], b[0]), [b for b in bins if b[1] is not None][1:], F.when(middle <= bins[0][1], bins[0][0]))
    return F.when(middle.isNotNull(), named.otherwise(bins[-1][0]))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def content_id(c: Column) -> Column:
    """The first twelve hex digits of the content's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)


def truncate_text(c: Column, most: int = 20_000) -> Column:
    return F.substring(c, 1, most)


def signature(*fields: Column) -> Column:
    """Fields in lower case joined by bars, ``?`` for an unknown one; null when all are unknown."""
    known = [F.lower(F.trim(f)) for f in fields]
    return F.when(F.coalesce(*fields).isNotNull(), F.concat_ws("|", *[F.coalesce(k, F.lit("?")) for k in known]))


def ring_presence(value: Column, kind: Column, persistence: Column) -> Column:
    """Absent stays absent; partial or both that is not fugacious is present; anything else is unknown."""
    return F.when(F.lower(value) == "absent", "absent").when(
        F.lower(kind).isin("partial", "both") & (F.coalesce(F.lower(persistence), F.lit("")) != "fugacious"), "present"
    )


def listed_presence(value: Column, present: Sequence[str], absent: str = "absent") -> Column:
    """``absent`` for the absent word, ``present`` for the listed ones, else null."""
    return F.when(F.lower(value) == absent, "absent").when(F.lower(value).isin(*present), "present")


def rank_of(level: Column, levels: Sequence[str] = LEVELS) -> Column:
    """Rank of a confidence level; unknown and null rank lowest."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in enumerate(levels) for x in (F.lit(v), F.lit(k))]), level), F.lit(0))


def lower_confidence(a: Column, b: Column, levels: Sequence[str] = LEVELS) -> Column:
    """The lower of two levels by rank."""
    return F.element_at(F.array(*[F.lit(x) for x in levels]), F.least(rank_of(a, levels), rank_of(b, levels)) + 1)


def mapped(c: Column, values: dict, default=None) -> Column:
    """A small dictionary applied to a column."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def agree(a: Column, b: Column) -> Column:
    """``agree`` when either text holds the other (trimmed, lower case), ``na`` when one is missing."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), "na").when(F.contains(x, y) | F.contains(y, x), "agree").otherwise("disagree")
