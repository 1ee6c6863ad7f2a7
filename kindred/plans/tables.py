"""Queries of sources, scalar expressions, normalisation and reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curate, normalize
from ..sources import tables as T
from ..sources.shared import shared_folder
from .bindings import SIZE_BINS, known_pairs, t
from .registry import ORACLE_SQL, query

KNOWN = """known AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y
  ON x.label = y.label AND y.vec_id > x.vec_id AND y.vec_id - x.vec_id < 15)"""
SIZE_CASE = "CASE WHEN p_size <= 5 THEN 'tiny' WHEN p_size <= 15 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 45 THEN 'large' ELSE 'huge' END"


# --- sources and sinks


@query("SELECT * FROM part")
def read_table(spark: SparkSession, d: str) -> DataFrame:
    return T.read_table(spark, d, "part")


@query(f"WITH {KNOWN} SELECT a, b FROM known")
def pair_list(spark, d):
    both = known_pairs(spark, d).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    entries = both.groupBy("a").agg(F.collect_list("b").alias("listed"))  # at most 28 a row by the binding
    return T.pair_list(entries, "a", "listed")


@query("""WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
p AS (SELECT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)
SELECT DISTINCT least(u.k, v.k) AS a, greatest(u.k, v.k) AS b FROM p JOIN n u ON p.a = u.p_name JOIN n v ON p.b = v.p_name WHERE u.k <> v.k""")
def resolve_pairs(spark, d):
    p = t(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("b"))
    return T.resolve_pairs(p.select("p_partkey", F.col("p_name").alias("a")).join(nxt, "p_partkey").select("a", "b"), p, "p_name", "p_partkey")


@query(f"WITH {KNOWN} SELECT a, b, CASE WHEN a % 2 = 0 THEN 'kept' ELSE 'new ' || a END AS note FROM known")
def load_pairs_with_notes(spark, d):
    p = known_pairs(spark, d)
    new = p.select("a", "b", F.concat(F.lit("new "), "a").alias("note"), F.lit(1).alias("k")).union(p.select("a", "b", F.lit("later"), F.lit(2)))
    return T.pairs_with_notes(new, p.filter("a % 2 = 0").select("a", "b", F.lit("kept").alias("note")), "k")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' WHEN (props->>'k')::INT > 90 THEN 'null' ELSE 'ok' END AS status,
CASE WHEN event_type <> 'error' AND (props->>'k')::INT <= 90 THEN props->>'k' END AS value,
CASE WHEN event_type <> 'error' AND (props->>'k')::INT <= 90 THEN CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE 0.0 END END::DOUBLE AS confidence FROM events""")
def read_sidecars(spark, d):
    parsed = t(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.from_json("props", "k int").alias("j"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.lit(None).cast("string").alias("_corrupt_record"))
    return T.usable_sidecars(parsed, F.when(F.col("j.k") <= 90, F.col("j.k").cast("string")), F.col("event_type"), {"click": 1.0, "view": 0.5})


INSERTS = """e AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value < 5 GROUP BY 1, 2),
n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)"""


@query(f"WITH {INSERTS} SELECT * FROM e UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = n.user_id AND e.event_type = n.event_type)")
def write_insert_ignore(spark, d):
    e = t(spark, d, "events")
    old = e.filter("value < 5").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return T.insert_ignore(e.select("user_id", "event_type", "event_id"), old, ["user_id", "event_type"])


@query(f"WITH {INSERTS} SELECT (SELECT count(*) FROM events) AS parsed, (SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = n.user_id AND e.event_type = n.event_type)) AS inserted")
def insert_report(spark, d):
    e = t(spark, d, "events")
    return T.insert_report(e.select("user_id", "event_type", "event_id"), e.filter("value < 5").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH o AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
n AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""")
def write_upsert(spark, d):
    e = t(spark, d, "events")
    cols = ["user_id", "event_type", "event_id", "value"]
    old = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("s")).select("user_id", "event_type", "s.event_id", "s.value")
    new = e.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("s")).select("user_id", "event_type", "s.event_id", "s.value")
    return T.upsert(new.select(cols), old.select(cols), ["user_id", "event_type"])


@query(ORACLE_SQL["write_upsert"])
def upsert_folders(spark, d):
    """The same upsert into a table laid out by a hash of the key: only folders with a new key are written again."""
    e = t(spark, d, "events")
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}/upserted"
    cols = ["user_id", "event_type", "event_id", "value"]
    T.upsert_folders(e.filter("event_id % 2 = 0").select(*cols[:2], F.struct("event_id", "value").alias("s")).groupBy(*cols[:2]).agg(F.min("s").alias("s")).select(*cols[:2], "s.*"), path, cols[:2])
    new = e.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("s"))
    T.upsert_folders(new.select(*cols[:2], "s.*"), path, cols[:2])
    return T.read_folders(spark, path)


@query("""SELECT (SELECT count(*) FROM documents) AS n_items, (SELECT count(DISTINCT source) FROM documents) AS n_entities,
(SELECT count(*) FROM labels) AS n_annotated, (SELECT count(*) FROM labels WHERE quality = 0) AS n_rejected, (SELECT count(*) FROM labels WHERE toxic = 1) AS n_toxic""")
def pipeline_status(spark, d):
    a = t(spark, d, "documents").agg(F.count("*").alias("n_items"), F.countDistinct("source").alias("n_entities"))
    b = t(spark, d, "labels").agg(F.count("*").alias("n_annotated"), F.count_if(F.col("quality") == 0).alias("n_rejected"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return a.join(F.broadcast(b))


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS total, (SELECT count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)) AS cached,
(SELECT count(*) FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphaned""")
def cache_completeness(spark, d):
    return T.cache_completeness(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query(f"WITH {KNOWN} SELECT (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)) AS embedded, (SELECT count(*) FROM known) AS pairs")
def dataset_stats(spark, d):
    p, e = t(spark, d, "part"), t(spark, d, "embeddings")
    embedded = p.join(e, p.p_partkey == e.vec_id, "left_semi").agg(F.count("*").alias("embedded"))
    return p.agg(F.count("*").alias("total")).join(F.broadcast(embedded)).join(F.broadcast(known_pairs(spark, d).agg(F.count("*").alias("pairs"))))


@query("SELECT p_type, count(*) AS n, max(p_size) AS largest FROM part GROUP BY 1")
def write_report(spark, d):
    """A report written as JSON lines to the shared folder and read back."""
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}/report"
    T.write_report(t(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest")), path)
    return spark.read.schema("p_type string, n long, largest int").json(path)


# --- nested access and scalar expressions


@query("SELECT event_id, (props->>'k') AS k, NULL::VARCHAR AS missing FROM events")
def get_path(spark, d):
    return t(spark, d, "events").select("event_id", S.json_path(F.col("props"), "k").alias("k"), S.json_path(F.col("props"), "k.x").alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS big, array_to_string([p_type, CASE WHEN p_size > 10 THEN p_brand END], ', ') AS listed FROM part")
def get_path_str(spark, d):
    return t(spark, d, "part").select("p_partkey", S.bool_text(F.col("p_size") > 25).alias("big"), S.list_text(F.array("p_type", F.when(F.col("p_size") > 10, F.col("p_brand")))).alias("listed"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[3] AS third FROM part")
def path_index(spark, d):
    w = F.split("p_name", " ")
    return t(spark, d, "part").select("p_partkey", S.element(w, 0).alias("first"), S.element(w, 2).alias("third"))


@query("SELECT p_partkey, 'name: ' || p_name || CASE WHEN p_size > 10 THEN '. size: ' || p_size ELSE '' END || '. item type: ' || p_type || '.' AS text FROM part")
def profile_to_text(spark, d):
    fields = [("part.name", F.col("p_name")), ("part.size", F.when(F.col("p_size") > 10, F.col("p_size"))), ("part.item_type", F.col("p_type"))]
    return t(spark, d, "part").select("p_partkey", S.profile_text(fields).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus <> 'O' END AS flag FROM orders")
def coerce_bool(spark, d):
    text = F.when(F.col("o_orderstatus") == "O", " No ").when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus"))
    return t(spark, d, "orders").select("o_orderkey", S.coerce_bool(text).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN [] ELSE [o_orderpriority, NULL] END AS listed FROM orders")
def null_strings(spark, d):
    text = F.when(F.col("o_orderstatus") == "O", "None").otherwise(F.col("o_orderstatus"))
    listed = F.when(F.col("o_orderstatus") != "P", F.array("o_orderpriority", F.lit("NULL")))
    return t(spark, d, "orders").select("o_orderkey", S.null_words(text).alias("status"), S.null_words_in_list(listed).alias("listed"))


@query("SELECT p_partkey, p_size::DOUBLE AS one, (p_size + p_partkey) / 2.0::DOUBLE AS two, NULL::DOUBLE AS none FROM part")
def parse_number(spark, d):
    return t(spark, d, "part").select(
        "p_partkey", S.parse_number(F.concat(F.lit("about "), "p_size", F.lit(" mm"))).alias("one"), S.parse_number(F.concat("p_size", F.lit("-"), "p_partkey", F.lit(" or 7"))).alias("two"), S.parse_number(F.col("p_type")).alias("none")
    )


@query(f"SELECT p_partkey, {SIZE_CASE} AS size_class, CASE WHEN p_retailprice / 2 + p_size / 2.0 <= 600 THEN 'low' ELSE 'high' END AS price_class FROM part")
def range_to_category(spark, d):
    size = F.col("p_size").cast("double")
    return t(spark, d, "part").select("p_partkey", S.range_to_category(F.lit(None).cast("double"), size, SIZE_BINS).alias("size_class"), S.range_to_category(F.col("p_retailprice"), size, [("low", 600.0), ("high", None)]).alias("price_class"))


@query("SELECT doc_id, sha256(text) AS text_hash, substr(sha256(text), 1, 12) AS content_id FROM documents")
def content_id(spark, d):
    return t(spark, d, "documents").select("doc_id", S.text_hash(F.col("text")).alias("text_hash"), S.content_id(F.col("text")).alias("content_id"))


@query("SELECT doc_id, length(substr(text, 1, 2000)) AS n, md5(substr(text, 1, 2000)) AS kept FROM documents")
def truncate_text(spark, d):
    cut = S.truncate_text(F.col("text"), 2000)
    return t(spark, d, "documents").select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("kept"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 1 THEN 'prima' WHEN r_name = 'ASIA' THEN 'asiatica' WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'condivisa' ELSE n_name END AS translated FROM nation JOIN region ON n_regionkey = r_regionkey")
def translate_values(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = n.filter("r_name = 'ASIA' or n_nationkey = 1").select(F.col("r_name").alias("feature"), F.col("n_name").alias("value"), F.when(F.col("n_nationkey") == 1, "prima").otherwise("asiatica").alias("text"))
    shared = n.filter("n_name in ('NATION_1', 'NATION_2')").select(F.col("n_name").alias("value"), F.lit("condivisa").alias("text"))
    return normalize.translate_values(n, "n_name", F.col("r_name"), own, shared).select("n_nationkey", "n_name", "translated")


@query("SELECT p_partkey, lower(p_type) || '|' || CASE WHEN p_size > 10 THEN lower(p_brand) ELSE '?' END AS sig FROM part")
def signature(spark, d):
    return t(spark, d, "part").select("p_partkey", S.signature(F.concat(F.lit(" "), "p_type"), F.when(F.col("p_size") > 10, F.col("p_brand"))).alias("sig"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'absent' WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 'present' END AS ring FROM lineitem""")
def derive_ring_presence(spark, d):
    li = t(spark, d, "lineitem")
    value = F.when(F.col("l_returnflag") == "N", "Absent")
    kind = F.when(F.col("l_returnflag") == "A", "partial").otherwise("other")
    lasting = F.when(F.col("l_linestatus") == "F", "fugacious")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.ring_presence(value, kind, lasting).alias("ring"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'absent' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'present' END AS volva FROM part")
def derive_volva_presence(spark, d):
    return t(spark, d, "part").select("p_partkey", S.listed_presence(F.col("p_type"), ["small", "medium"], "promo").alias("volva"))


@query("""SELECT event_id AS id, f.feature_name, 'derived' AS annotation_type, CASE WHEN event_type IN ('click', 'view') THEN 'true' ELSE 'false' END AS feature_value
FROM events, (VALUES ('stem_visible'), ('base_visible')) f(feature_name)""")
def derive_visibility(spark, d):
    seen = F.when(F.col("event_type").isin("click", "view"), "true").otherwise("false")
    e = t(spark, d, "events").withColumns({"stem_visible": seen, "base_visible": seen})
    return curate.unpivoted(e, "event_id", ["stem_visible", "base_visible"], "derived")


@query("""SELECT doc_id AS id, f AS feature_name, 'model' AS annotation_type, CASE f WHEN 'quality' THEN quality ELSE toxic END::VARCHAR AS feature_value,
CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 WHEN quality = 1 THEN 0.33 ELSE 0.5 END::DOUBLE AS confidence FROM labels, (VALUES ('quality'), ('toxic')) v(f)""")
def wide_to_annotations(spark, d):
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "high").when(F.col("quality") == 1, "low").otherwise("odd")
    return curate.wide_to_annotations(t(spark, d, "labels"), "doc_id", ["quality", "toxic"], level, "model")


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'unusable' WHEN quality = 0 THEN 'no_subject' WHEN toxic = 1 THEN 'subject_absent' END AS reason FROM labels")
def exclude_reason(spark, d):
    q, x = F.col("quality") == 0, F.col("toxic") == 1
    return t(spark, d, "labels").select("doc_id", curate.exclude_reason(q & x, q, x).alias("reason"))


@query("""SELECT doc_id, quality = 1 AND toxic = 0 AS visible, CASE WHEN quality = 1 AND toxic = 0 THEN 'v' END AS value,
CASE WHEN quality = 1 THEN 'd' END AS description, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' ELSE 'cannot_tell' END AS confidence
FROM (SELECT doc_id, quality, toxic FROM labels) ORDER BY 1""".replace("quality = 1 AND toxic = 0 AS visible", "quality = 1 AS visible"))
def enforce_consistency(spark, d):
    x = t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("visible"), F.lit("v").alias("value"), F.lit("d").alias("description"), F.when(F.col("toxic") == 1, "cannot_tell").otherwise("high").alias("confidence"))
    return curate.enforce_consistency(x)


@query("""SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'leaf' END AS value, CASE WHEN quality = 1 AND toxic = 0 THEN 'low' ELSE 'cannot_tell' END AS confidence,
CASE WHEN toxic = 0 THEN 'second' ELSE 'first' END AS text FROM labels""")
def merge_stages(spark, d):
    x = t(spark, d, "labels")
    first = x.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "form").alias("value"), F.lit("high").alias("confidence"), F.lit("first").alias("text"))
    second = x.filter("toxic = 0").select(F.col("doc_id").alias("id"), F.lit("leaf").alias("value"), F.lit("low").alias("confidence"), F.lit("second").alias("text"))
    return curate.merge_stages(first, second)


# --- normalisation and reconciliation


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'STANDARD' ELSE p_type END AS p_type FROM part")
def apply_aliases(spark, d):
    _, alias, _ = T.read_vocabulary(spark, {"type": {"canonical": ["STANDARD"], "aliases": {"Economy": "STANDARD"}}})
    return normalize.apply_aliases(t(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.lower("p_type")).alias("p_type")), {"p_type": "type"}, alias).select("p_partkey", F.upper(F.trim("p_type")).alias("p_type"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'STANDARD' WHEN p_type IN ('STANDARD', 'SMALL', 'MEDIUM') THEN p_type END AS p_type FROM part")
def enforce_vocabulary(spark, d):
    canonical, alias, _ = T.read_vocabulary(spark, {"type": {"canonical": ["STANDARD", "SMALL", "MEDIUM"], "aliases": {"PROMO": "STANDARD"}}})
    near = alias.select("key", F.upper("alias_lc").alias("term"), F.col("canonical").alias("value"))
    return normalize.enforce_vocabulary(t(spark, d, "part").select("p_partkey", "p_type"), {"p_type": "type"}, canonical, near)


COS = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"


@query(f"""WITH s AS (SELECT x.vec_id AS id, y.vec_id AS ref, round({COS}, 6) AS sim FROM embeddings x, (SELECT * FROM embeddings WHERE vec_id < 10) y),
b AS (SELECT id, ref, sim FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref) = 1) SELECT id, CASE WHEN sim >= 0.2 THEN ref END AS ref, sim FROM b""")
def nearest_canonical(spark, d):
    e = t(spark, d, "embeddings")
    refs = e.filter("vec_id < 10").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vec"))  # a vocabulary of ten
    return normalize.nearest_canonical(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), refs, 0.2)


@query("SELECT l_partkey, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, min(l_tax) AS share_min, max(l_discount) AS share_max FROM lineitem GROUP BY 1")
def merge_ranges(spark, d):
    return normalize.merge_ranges(t(spark, d, "lineitem"), "l_partkey", {"quantity": ("l_quantity", "l_quantity"), "share": ("l_tax", "l_discount")})


@query("""WITH f AS (SELECT l_partkey, l_returnflag, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, list(l_returnflag ORDER BY s, l_returnflag) AS l_returnflag FROM f GROUP BY 1""")
def merge_lists(spark, d):
    return normalize.merge_values(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query("""WITH m AS (SELECT DISTINCT l_partkey, month(l_shipdate) AS n FROM lineitem) SELECT l_partkey, list(['January','February','March','April','May','June','July','August','September','October','November','December'][n] ORDER BY n) AS months FROM m GROUP BY 1""")
def merge_months(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.date_format("l_shipdate", "MMMM").alias("months"))
    merged = normalize.merge_values(li, "l_partkey", "l_suppkey", "months")
    return merged.select("l_partkey", normalize.calendar_order(F.col("months")).alias("months"))


@query("""WITH l AS (SELECT l_partkey, l_suppkey, 'flag' AS f, l_returnflag AS v FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 'status', l_linestatus FROM lineitem),
v AS (SELECT l_partkey, f, v, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, f ORDER BY n DESC, s, v) AS k, sum(n) OVER (PARTITION BY l_partkey, f) AS a, count(*) OVER (PARTITION BY l_partkey, f) AS c FROM v)
SELECT l_partkey, max(v) FILTER (f = 'flag') AS flag, max(v) FILTER (f = 'status') AS status, coalesce(list(f ORDER BY f) FILTER (c > 1), []) AS conflicts,
round(avg(n / a), 6) AS confidence, bool_or(f = 'flag' AND c > 1) AS needs_review FROM r WHERE k = 1 GROUP BY 1""")
def resolve_scalar_conflicts(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return normalize.resolve_scalar_conflicts(li, "l_partkey", "l_suppkey", ["flag", "status"], ["flag"]).withColumn("confidence", F.round("confidence", 6))


@query("SELECT o_custkey, arg_min(o_orderpriority, (CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END)::VARCHAR || o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1".replace("(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END)::VARCHAR || o_orderpriority", "(CASE o_orderpriority WHEN '1-URGENT' THEN '01' WHEN '2-HIGH' THEN '02' ELSE '99' END) || o_orderpriority"))
def safest_value(spark, d):
    return normalize.safest_value(t(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("""WITH f AS (SELECT lang, source, min(md5(text)) AS u FROM documents GROUP BY 1, 2), o AS (SELECT lang, u, min(source) AS source FROM f GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, u) AS k FROM o) SELECT lang, list(u ORDER BY k) AS images FROM k WHERE k <= 3 GROUP BY 1""")
def pick_images(spark, d):
    x = t(spark, d, "documents").select("lang", "source", F.md5("text").alias("u"), F.md5("text").alias("o"))
    return normalize.pick_images(x, "lang", "source", "u", "o")


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN 'fixed' ELSE p_type END AS p_type, p_size FROM part")
def apply_overrides(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_size")
    directives = p.filter("p_size = 7").select(F.col("p_partkey").alias("entity"), F.lit("p_type").alias("field"), F.lit("fixed").alias("resolved_value"))
    return normalize.apply_overrides(p, directives, "p_partkey", ["p_type", "p_size"])


@query("""SELECT k AS key, o.n_orders, c.c_mktsegment FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey AS k, c_mktsegment FROM customer) c USING (k)""")
def merge_sections(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n_orders"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return normalize.merge_sections({"orders": o, "customer": c}, "key").select("key", "orders.n_orders", "customer.c_mktsegment")


@query("""WITH h AS (SELECT user_id, event_id, ('0x' || substr(md5(coalesce(event_type, '~') || '|' || event_id::VARCHAR), 1, 12))::BIGINT % 1000000007 AS h FROM events),
n AS (SELECT user_id, sum(h)::BIGINT AS new_hash, sum(CASE WHEN event_id % 50 <> 0 THEN h END)::BIGINT AS old_hash FROM h GROUP BY 1) SELECT * FROM n WHERE new_hash IS DISTINCT FROM old_hash""")
def stale_entities(spark, d):
    e = t(spark, d, "events")
    built = e.filter("event_id % 50 <> 0").groupBy("user_id").agg(normalize.content_sum(["event_type", "event_id"]).alias("content_hash"))
    return normalize.stale_entities(e, built, "user_id", ["event_type", "event_id"])


@query("SELECT doc_id, source AS old, CASE WHEN lang = 'en' THEN source ELSE lang END AS new FROM documents WHERE lang <> 'en'")
def backfill_column(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source", "lang")
    return normalize.backfill_column(x, x.select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang")).alias("source")), "doc_id", "source")
