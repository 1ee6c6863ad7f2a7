"""How domain operators bind to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import PairSpec
from ..operators.vectors import group_vectors
from ..sources.tables import read_table

GROUPS = ["g0", "g1", "g2", "g3"]
#: Vocabulary of part types: order by size, similarities of pairs, aliases (fixed values of the binding).
TYPE_MATRIX = {"STANDARD-ECONOMY": 0.7, "SMALL-MEDIUM": 0.5, "MEDIUM-LARGE": 0.5, "PROMO-ECONOMY": 0.4}
SIZE_BINS = [("tiny", 5.0), ("small", 15.0), ("medium", 30.0), ("large", 45.0), ("huge", None)]
SIZE_ORDER = [n for n, _ in SIZE_BINS]
NAME_COLORS = ("red", "blue", "green", "small", "large")
COLOR_MATRIX = {"red-blue": 0.3, "blue-green": 0.5, "small-large": 0.2}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def entity_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``entity_id, label, grp, vec``: four slices of sixteen."""
    return group_vectors(t(spark, d, "embeddings"), "vec_id", "embedding", 4, 16)


def asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: every twentieth entity, against all."""
    return vectors.filter("entity_id % 20 = 0")


def known_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``a < b``: same label and ids less than 15 apart, found by buckets of ids."""
    e = t(spark, d, "embeddings").select("vec_id", "label")
    bucket = F.floor(F.col("vec_id") / 15)
    a = e.select(F.col("vec_id").alias("a"), "label", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = e.select(F.col("vec_id").alias("b"), "label", bucket.alias("bucket"))
    return a.join(b, ["label", "bucket"]).filter("a < b and b - a < 15").select("a", "b")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities: form, size class, category, name and price."""
    from ..functions.scalars import range_to_category, signature

    p = t(spark, d, "part")
    size = F.col("p_size").cast("double")
    out = p.select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("form"),
        F.col("p_brand").alias("category"),
        range_to_category(size, F.lit(None).cast("double"), SIZE_BINS).alias("size_class"),
        size.alias("size"),
        F.col("p_retailprice").alias("price"),
        F.split("p_name", " ").alias("words"),
    )
    return out.withColumn("sig", signature(F.col("form"), F.col("size_class"), F.element_at("words", 1)))


SPEC = PairSpec(scalars={"form": TYPE_MATRIX}, lists={"words": COLOR_MATRIX}, ranges={"size_class": SIZE_ORDER}, singles={"price": 200.0, "size": 20.0}, gates=("form", "size_class"))


#: Measurements of a part's lines, and ranges over them: least, largest, bins.
SPANNED = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "worth": "l_extendedprice"}
SPANS = {
    "quantity": ("quantity_min", "quantity_max", [("few", 20.0), ("some", 26.0), ("many", None)]),
    "discount": ("discount_min", "discount_max", [("low", 0.04), ("mid", 0.055), ("high", None)]),
    "tax": ("tax_min", "tax_max", [("low", 0.03), ("mid", 0.045), ("high", None)]),
    "worth": ("worth_min", "worth_max", [("low", 20000.0), ("mid", 30000.0), ("high", None)]),
}
PROFILE_SPEC = PairSpec(
    scalars={"form": TYPE_MATRIX, "color": COLOR_MATRIX, "thing": {}, "category": {}},
    lists={"words": COLOR_MATRIX, "flags": {"A-R": 0.6, "N-R": 0.2}, "statuses": {}},
    flags=("bulky", "dear", "undiscounted"),
    ranges={"size_class": SIZE_ORDER} | {k: [n for n, _ in bins] for k, (_, _, bins) in SPANS.items()},
    singles={"price": 200.0, "size": 20.0, "n_lines": 30.0, "quantity_max": 10.0, "discount_max": 0.05, "tax_max": 0.04},
    sets=("months", "years", "suppliers"),
    gates=("form", "size_class", "category"),
)


def part_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Entities with what their lines say: ranges, flags, and the sets of flags, statuses, months, years and suppliers."""
    from ..operators.pairs import with_categories

    sets = {"flags": F.col("l_returnflag"), "statuses": F.col("l_linestatus"), "months": F.month("l_shipdate"), "years": F.year("l_shipdate"), "suppliers": F.col("l_suppkey")}
    ends = [x for n, c in SPANNED.items() for x in (F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"))]
    lines = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(*ends, F.count("*").alias("n_lines"), *[F.sort_array(F.collect_set(c)).alias(k) for k, c in sets.items()])
    e = with_categories(entities(spark, d).join(lines, "entity_id", "left"), SPANS)
    word = lambda k: F.element_at("words", k)
    return e.withColumns({"color": word(1), "thing": word(2), "bulky": F.col("quantity_max") >= 50, "dear": F.col("price") >= 1000, "undiscounted": F.col("discount_min") == 0})


def item_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Labels as annotations: ``id, feature_name, annotation_type, feature_value, confidence``."""
    from ..operators.curate import unpivoted

    return unpivoted(t(spark, d, "labels"), "doc_id", ["quality", "toxic"], "manual").withColumn("confidence", F.lit(1.0))
