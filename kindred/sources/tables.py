"""Reading tables, vocabularies, pair lists and sidecars; writing upserts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import removed, written


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_vocabulary(spark: SparkSession, vocabulary: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(key, value)``, ``(key, alias_lc, canonical)`` and ``(key, pair_key, score)`` of a vocabulary.

    ``vocabulary`` is a mapping (say, of a YAML file) of key to ``canonical``, ``aliases`` and ``similarity``.
    """
    canonical = [(k, str(v)) for k, x in vocabulary.items() for v in x.get("canonical", [])]
    alias = [(k, str(a).lower(), str(c)) for k, x in vocabulary.items() for a, c in (x.get("aliases") or {}).items()]
    similarity = [(k, str(p), float(s)) for k, x in vocabulary.items() for p, s in (x.get("similarity") or {}).items()]
    make = spark.createDataFrame
    return make(canonical, "key string, value string"), make(alias, "key string, alias_lc string, canonical string"), make(similarity, "key string, pair_key string, score double")


def pair_list(entries: DataFrame, name: str, listed: str) -> DataFrame:
    """Undirected pairs ``a < b`` from entries with a list each, without self-pairs and repeats."""
    each = entries.select(F.col(name).alias("x"), F.explode(listed).alias("y")).filter("x <> y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).dropDuplicates(["a", "b"])


def resolve_pairs(pairs: DataFrame, entities: DataFrame, name: str, key: str) -> DataFrame:
    """Pairs of names to pairs of keys: exact name, else lower case; pairs with a missing side go."""
    exact = entities.groupBy(F.col(name).alias("_n")).agg(F.min(key).alias("_exact"))
    lower = entities.groupBy(F.lower(name).alias("_l")).agg(F.min(key).alias("_lower"))
    out = pairs
    for side in ("a", "b"):
        e = exact.select(F.col("_n"), F.col("_exact").alias(f"_e{side}"))
        low = lower.select(F.col("_l"), F.col("_lower").alias(f"_l{side}"))
        out = out.join(e, out[side] == e["_n"], "left").drop("_n").join(low, F.lower(out[side]) == low["_l"], "left").drop("_l")
    keys = [F.coalesce(f"_e{s}", f"_l{s}") for s in ("a", "b")]
    found = out.select(F.least(*keys).alias("a"), F.greatest(*keys).alias("b"), keys[0].isNotNull().alias("_x"), keys[1].isNotNull().alias("_y"))
    return found.filter("_x and _y and a <> b").select("a", "b").distinct()


def pairs_with_notes(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Pairs with the note of their first writer; pairs that exist keep theirs."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy("a", "b").orderBy(order))).filter("_k = 1").drop("_k", order)
    return existing.unionByName(first.join(existing, ["a", "b"], "left_anti"))


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON sidecars with the file's stem as ``id``; unreadable ones keep their text in ``_corrupt_record``."""
    read = spark.read.option("mode", "PERMISSIVE").option("multiLine", True).schema(f"{schema}, error string, _corrupt_record string").json(path)
    return read.withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def usable_sidecars(parsed: DataFrame, value: Column, confidence: Column, levels: dict[str, float]) -> DataFrame:
    """Status of each sidecar (unreadable, error, null, ok) with its value and numeric confidence (unknown level: 0)."""
    table = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    status = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("error").isNotNull(), "error").when(value.isNull(), "null").otherwise("ok")
    return parsed.select("id", status.alias("status"), F.when(status == "ok", value).alias("value"), F.when(status == "ok", F.coalesce(F.try_element_at(table, confidence), F.lit(0.0))).alias("confidence"))


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those new ones whose key is not there yet (of several with one key, the least row)."""
    once = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys]))).filter("_k = 1").drop("_k")
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti"))


def insert_report(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows parsed, and rows inserted by :func:`insert_ignore`."""
    fresh = new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    return new.agg(F.count("*").alias("parsed")).join(F.broadcast(fresh.agg(F.count("*").alias("inserted"))))


def upsert(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows win over existing ones of their key; of several new ones the last by ``order`` does."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_p"), *(order or [])))
    return both.withColumn("_k", place).filter("_k = 1").drop("_k", "_p")


def folder_of(keys: list[str], folders: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


def upsert_folders(new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, folders: int = 64) -> list[int]:
    """Upsert ``new`` into the table at ``path``, which is laid out in ``folders`` by a hash of ``keys``; returns the
    folders written.

    Only folders that hold a key of ``new`` are read and written again, by dynamic partition overwrite; the others keep
    their files.  Without ``order`` new rows win over the table's, and of several of a key the largest by
    its columns stays; with ``order`` the last row by it stays, whichever side it comes from, so that running an upsert
    again changes nothing.  Null keys are keys.  The table is made where there is none.  Files are replaced when the
    job commits, folder by folder: a lost executor costs its tasks alone.
    """
    spark = new.sparkSession
    names = new.columns
    rank = F.struct(*order, "_new", *names) if order else F.struct("_new", *names)
    staged = written(new.withColumn("_new", F.lit(1)).withColumn(FOLDER, folder_of(keys, folders)), "staged")  # computed once
    fresh = staged
    touched = sorted(r[0] for r in fresh.select(FOLDER).distinct().collect())  # as many as folders at most
    if touched and table_exists(spark, path):
        schema = new.select(*names).schema.add(FOLDER, "integer")
        old = spark.read.schema(schema).parquet(path).filter(F.col(FOLDER).isin(touched)).withColumn("_new", F.lit(0))
        fresh = old.select(*names, "_new", FOLDER).unionByName(fresh)
    merged = fresh.groupBy(FOLDER, *[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)]).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*", FOLDER)
    if touched:
        merged.repartition(FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)
    removed(staged)
    return touched


#: The folder column of an upserted table.
FOLDER = "_folder"


def table_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(f.isDirectory() and f.getPath().getName().startswith(f"{FOLDER}=") for f in fs.listStatus(at))


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that :func:`upsert_folders` wrote."""
    return spark.read.parquet(path).drop(FOLDER)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON, CSV (with header) or Parquet."""
    (df.write.mode("overwrite").option("header", True).format(kind)).save(path)


def cache_completeness(ids: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """One row: ids, cached among them, missing, and cached without an id."""
    a, b = ids.select(key).distinct().withColumn("_a", F.lit(1)), cached.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    known, kept = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count_if(known).alias("total"), F.count_if(known & kept).alias("cached"), F.count_if(known & ~kept).alias("missing"), F.count_if(~known & kept).alias("orphaned"))
