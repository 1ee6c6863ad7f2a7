"""Queries of near duplicates, curation, heads, pages and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import similarity as X
from ..operators import curate, dedup, heads, pages
from ..operators import vectors as V
from ..sources.shared import shared_folder
from ..sources.tables import read_folders, read_table
from ..streaming import streams
from .bindings import entities, entity_vectors, item_annotations, t
from .registry import query
from .retrieval import ENT, PART_PAIRS, six

DOT = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"
EDGES = f"edges AS (SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({DOT}, 6) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE sim >= 0.4)"
COMP = f"""{EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(id, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.id),
comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1)"""
KEEP = f"""{COMP}, kp AS (SELECT cluster, id AS keeper FROM comp LEFT JOIN documents ON doc_id = id LEFT JOIN labels USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(quality, -1) DESC, coalesce(n_chars, -1) DESC, id) = 1)"""


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def edges(spark, d):
    return dedup.duplicate_edges(vectors(spark, d), 0.4)


def clusters(spark, d):
    return dedup.connected_components(edges(spark, d))


def kept(spark, d, found):
    ranks = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "quality", "n_chars")
    return dedup.keepers(found, ranks, [F.coalesce("quality", F.lit(-1)).desc(), F.coalesce("n_chars", F.lit(-1)).desc()])


@query(f"WITH {EDGES} SELECT * FROM edges")
def duplicate_edges(spark, d):
    return edges(spark, d)


@query()
def lsh_edges(spark, d):
    return dedup.lsh_edges(vectors(spark, d), 0.4)


@query(f"WITH RECURSIVE {COMP} SELECT id, cluster FROM comp")
def connected_components(spark, d):
    return clusters(spark, d)


@query(f"WITH RECURSIVE {KEEP} SELECT * FROM kp")
def keeper(spark, d):
    return kept(spark, d, clusters(spark, d))


@query(f"WITH RECURSIVE {KEEP} SELECT id, cluster, keeper, CASE WHEN id = keeper THEN 1.0 ELSE round({DOT}, 6) END::DOUBLE AS sim FROM comp JOIN kp USING (cluster) JOIN embeddings x ON x.vec_id = id JOIN embeddings y ON y.vec_id = keeper")
def similarity_to_keeper(spark, d):
    found = clusters(spark, d)
    return dedup.similarity_to_keeper(found, kept(spark, d, found), vectors(spark, d))


@query(f"WITH RECURSIVE {COMP} SELECT size, count(*) AS clusters FROM (SELECT cluster, count(*) AS size FROM comp GROUP BY 1) GROUP BY 1")
def duplicate_sizes(spark, d):
    return dedup.size_distribution(clusters(spark, d))


@query(f"WITH {EDGES} SELECT floor(round((sim - 0.4::DOUBLE) / 0.005::DOUBLE, 6))::BIGINT AS step, count(*) AS edges FROM edges GROUP BY 1")
def duplicate_histogram(spark, d):
    return dedup.edge_histogram(edges(spark, d), 0.4)


GONE = "gone AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1)"


@query(f"""WITH {GONE} SELECT 'registry' AS "table", count(*) AS "before", count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gone)) AS "after" FROM documents
UNION ALL SELECT 'annotations', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gone)) FROM labels""")
def cascade_delete(spark, d):
    x = t(spark, d, "documents")
    gone = x.join(dedup.first_of_content(x, F.col("text"), ["doc_id"]).select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))
    return dedup.cascade_delete({"registry": (x, "doc_id"), "annotations": (t(spark, d, "labels"), "doc_id")}, gone)[1]


@query(f"WITH {GONE} SELECT doc_id || '_' || lang AS stem FROM documents WHERE doc_id IN (SELECT doc_id FROM gone)")
def derived_artifacts(spark, d):
    x = t(spark, d, "documents")
    gone = x.join(dedup.first_of_content(x, F.col("text"), ["doc_id"]).select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))
    return dedup.derived_of(x.select(F.concat_ws("_", "doc_id", "lang").alias("stem")), "stem", gone)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY 2")
def exact_dedup(spark, d):
    return dedup.first_of_content(t(spark, d, "documents"), F.col("text"), ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("hash"))


# --- curation

ANN = "ann AS (SELECT doc_id AS id, 'quality' AS feature_name, 'manual' AS annotation_type, quality::VARCHAR AS feature_value FROM labels UNION ALL SELECT doc_id, 'toxic', 'manual', toxic::VARCHAR FROM labels)"
GATES = {("quality", "manual"): ("deny", ["0"])}
SOURCES = "ent AS (SELECT source, CASE max(lang) WHEN 'en' THEN 'EN' WHEN 'fr' THEN 'fr' ELSE max(lang) END AS language, CASE WHEN count(*) % 2 = 0 THEN 'Even' ELSE 'odd' END AS parity FROM documents GROUP BY 1)"


def items(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")


@query("SELECT doc_id AS id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def full_pool(spark, d):
    return curate.full_pool(items(spark, d), item_annotations(spark, d), GATES)


@query("SELECT doc_id AS id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic <> 0)")
def null_tolerant_gate(spark, d):
    return curate.null_tolerant_gate(items(spark, d), item_annotations(spark, d), GATES | {("toxic", "manual"): ("allow", ["0"])})


@query(f"""WITH {SOURCES}, o AS (SELECT doc_id AS id, 'parity' AS feature_name, 'propagated' AS annotation_type, 'kept' AS feature_value, 0.5::DOUBLE AS confidence FROM documents WHERE n_chars < 500)
SELECT * FROM o UNION ALL SELECT doc_id, 'language', 'propagated', lower(language), 1.0 FROM documents JOIN ent USING (source) WHERE lower(language) IN ('en', 'fr')
UNION ALL SELECT doc_id, 'parity', 'propagated', lower(parity), 1.0 FROM documents JOIN ent USING (source) WHERE n_chars >= 500""")
def propagate_labels(spark, d):
    x = t(spark, d, "documents")
    lang = F.max("lang")
    ent = x.groupBy("source").agg(F.when(lang == "en", "EN").otherwise(lang).alias("language"), F.when(F.count("*") % 2 == 0, "Even").otherwise("odd").alias("parity"))
    old = x.filter("n_chars < 500").select(F.col("doc_id").alias("id"), F.lit("parity").alias("feature_name"), F.lit("propagated").alias("annotation_type"), F.lit("kept").alias("feature_value"), F.lit(0.5).alias("confidence"))
    return curate.propagate_labels(items(spark, d), ent, "source", {"language": ["en", "fr"], "parity": ["even", "odd"]}, old)


@query("SELECT d.doc_id AS id, lang, source, n_chars, toxic::VARCHAR AS label FROM documents d JOIN labels l USING (doc_id) WHERE quality <> 0 AND doc_id IN (SELECT vec_id FROM embeddings)")
def build_manifest(spark, d):
    return curate.build_manifest(items(spark, d), item_annotations(spark, d), "toxic", "manual", GATES, vectors(spark, d))


@query("SELECT u.user_id AS id, min(props->>'k') FILTER (event_type = 'click') AS click, min(props->>'k') FILTER (event_type = 'view') AS view FROM (SELECT DISTINCT user_id FROM events) u JOIN events e USING (user_id) GROUP BY 1")
def pivot_annotations(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("feature_name"), S.json_path(F.col("props"), "k").alias("feature_value"))
    return curate.pivot_annotations(e.select("id").distinct(), e, ["click", "view"])


@query("SELECT p_partkey AS entity, CASE WHEN p_type = 'PROMO' THEN 'absent' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'present' END AS by_rule, string_split(p_name, ' ')[2] AS by_path, p_brand AS by_column FROM part")
def truth_table(spark, d):
    by_rule = S.listed_presence(F.col("p_type"), ["small", "medium"], "promo")
    return t(spark, d, "part").select(F.col("p_partkey").alias("entity"), by_rule.alias("by_rule"), S.element(F.split("p_name", " "), 1).alias("by_path"), F.col("p_brand").alias("by_column"))


@query("""WITH v AS (SELECT p_partkey AS entity, unnest(CASE WHEN p_name = 'small ring' THEN ['ring'] ELSE list_filter(['red', 'small', 'widget', 'bolt'], lambda c: contains(p_name, c)) END) AS value FROM part
UNION ALL SELECT p_partkey, 'checked' FROM part WHERE p_size = 3) SELECT entity, list(DISTINCT value ORDER BY value) AS truths FROM v GROUP BY 1""")
def truth_multilabel(spark, d):
    p = t(spark, d, "part")
    corrections = p.filter("p_size = 3").select(F.col("p_partkey").alias("entity"), F.lit("checked").alias("value"))
    return curate.truth_multilabel(p, "p_partkey", "p_name", ["red", "small", "widget", "bolt"], {"Small Ring": "ring"}, corrections)


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'too_small (' || p_size || 'x' || floor(p_retailprice)::BIGINT || ')' WHEN p_retailprice / p_size > 40 THEN 'bad_aspect (' || floor(p_retailprice / p_size)::BIGINT || ')' END AS reason FROM part")
def size_gate(spark, d):
    return curate.size_gate(t(spark, d, "part"), F.col("p_size"), F.col("p_retailprice"), 10, 40.0).select("p_partkey", "reason")


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 20")
def cap_per_entity(spark, d):
    allowed = t(spark, d, "documents").filter(F.col("lang").isin("en", "fr"))
    return curate.cap_per_entity(allowed, "source", [F.desc("n_chars"), "doc_id"]).select("doc_id", "source")


@query("""WITH f AS (SELECT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '!' END AS k, p_partkey, p_name, upper(max(p_name) OVER (PARTITION BY p_brand)) AS asked FROM part)
SELECT k || ':' || asked AS asked, arg_min(p_partkey, CASE WHEN k NOT LIKE '%!' AND lower(p_name) = lower(asked) THEN 0 ELSE 1000000000 END + p_partkey) AS p_partkey,
bool_or(k NOT LIKE '%!' AND lower(p_name) = lower(asked)) AS exact FROM f GROUP BY 1""")
def exact_name_first(spark, d):
    """Of the parts found for a brand's last name the one that bears it, else the first; names asked with ``!`` fit none."""
    p = t(spark, d, "part")
    last = p.groupBy("p_brand").agg(F.upper(F.max("p_name")).alias("last"))
    odd = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("!")
    key = F.concat("p_brand", odd, F.lit(":"))
    found = p.join(last, "p_brand").select(F.concat(key, "last").alias("asked"), F.concat(key, "p_name").alias("name"), "p_partkey", odd.alias("odd"))
    found = found.withColumn("name", F.when(F.col("odd") == "", F.col("name")))
    return curate.exact_name_first(found, "asked", "name", ["p_partkey"]).select("asked", "p_partkey", "exact")


@query("SELECT doc_id, n_chars % 97 AS c FROM documents WHERE n_chars % 97 IN (SELECT n_chars % 97 FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 8)")
def drop_rare_classes(spark, d):
    return curate.drop_rare_classes(t(spark, d, "documents").withColumn("c", F.col("n_chars") % 97), "c", "source", 8).select("doc_id", "c")


SPLIT = """g AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
f AS (SELECT source, CASE WHEN k <= floor(n * 0.15 + 0.5) THEN 'test' WHEN k <= floor(n * 0.15 + 0.5) + floor((n - floor(n * 0.15 + 0.5)) * 0.15 / 0.85 + 0.5) THEN 'val' ELSE 'train' END AS fold FROM g)"""


@query(f"WITH {SPLIT} SELECT source, fold FROM f")
def group_split(spark, d):
    return curate.group_split(t(spark, d, "documents"), "source")


@query(f"WITH {SPLIT} SELECT fold, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents JOIN f USING (source) GROUP BY 1")
def split_sizes(spark, d):
    x = t(spark, d, "documents")
    return x.join(curate.group_split(x, "source"), "source").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_groups"))


@query("SELECT 2 * quality + toxic AS c, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS class_weight, round(1 / sqrt(count(*)), 6) AS sampling_weight FROM labels GROUP BY 1")
def class_weights(spark, d):
    return six(curate.class_weights(t(spark, d, "labels").withColumn("c", 2 * F.col("quality") + F.col("toxic")), "c"))


def _coverage_sql(votes: str, per_class: int, second: str = "") -> str:
    """A class per source, chosen sources by hash within a class, then the fill in the order of the hash, one by one."""
    return f"""WITH RECURSIVE x AS (SELECT *, floor(log10(n_chars)) AS size FROM documents),
    {votes}, best AS (SELECT source FROM c1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('42|' || source), source) <= {per_class}){second},
    s AS (SELECT x.source, count(*) AS n, x.source IN (FROM chosen) AS for_coverage FROM x WHERE x.source IS NOT NULL GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || source), source) AS pos FROM s WHERE NOT for_coverage),
    f(pos, total, took) AS (SELECT 0, (SELECT coalesce(sum(n), 0)::BIGINT FROM s WHERE for_coverage), false
      UNION ALL SELECT o.pos, CASE WHEN total < 460 AND NOT (total + n > 460 AND total >= 340) THEN total + n ELSE total END, total < 460 AND NOT (total + n > 460 AND total >= 340) FROM f JOIN o ON o.pos = f.pos + 1)
    SELECT source, for_coverage FROM s WHERE for_coverage UNION ALL SELECT source, false FROM o JOIN f USING (pos) WHERE took"""


def _votes_sql(name: str, label: str) -> str:
    return f"{name} AS (SELECT source, {label} AS k FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, {label}) = 1)"


@query(_coverage_sql(_votes_sql("c1", "lang"), 3, ", chosen AS (FROM best)"))
def coverage_select(spark, d):
    return curate.coverage_select(t(spark, d, "documents"), "lang", "source", "doc_id", 400)


@query(_coverage_sql(_votes_sql("c1", "lang") + ", " + _votes_sql("c2", "size"), 2, """, more AS (SELECT source FROM c2 WHERE k NOT IN (SELECT k FROM c2 WHERE source IN (FROM best))
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('42|' || source), source) <= 1), chosen AS (FROM best UNION FROM more)"""))
def coverage_select_dual(spark, d):
    return curate.coverage_select(t(spark, d, "documents").withColumn("size", F.floor(F.log10("n_chars"))), "lang", "source", "doc_id", 400, per_class=2, second="size")


@query("""WITH x AS (SELECT doc_id, lang, source, n_chars, CASE WHEN source IN ('src1', 'src2') THEN 'listed' WHEN lang = 'es' THEN 'rare' WHEN n_chars > 5000 THEN 'heavy' ELSE 'random' END AS stratum FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS k FROM x),
f AS (SELECT *, k <= CASE stratum WHEN 'listed' THEN 60 WHEN 'rare' THEN 60 ELSE 40 END AS own FROM k)
SELECT doc_id, lang, source, n_chars, stratum FROM f ORDER BY own DESC, md5('42|' || doc_id), doc_id LIMIT 200""")
def stratified_sample(spark, d):
    strata = [("listed", F.col("source").isin("src1", "src2"), 0.3), ("rare", F.col("lang") == "es", 0.3), ("heavy", F.col("n_chars") > 5000, 0.2), ("random", F.lit(True), 0.2)]
    return curate.stratified_sample(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), strata, 200, "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def random_sample(spark, d):
    return curate.random_sample(t(spark, d, "documents"), 100, "doc_id").select("doc_id", "lang")


@query("SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS n_entities FROM documents GROUP BY 1")
def class_distribution(spark, d):
    return curate.class_counts(t(spark, d, "documents"), "lang", "source")


@query("""WITH v AS (SELECT lower(p_type) AS a, lower(trim(p_name)) AS b FROM part UNION ALL SELECT NULL, NULL WHERE false),
w AS (SELECT 'name' AS field, CASE WHEN contains(b, string_split(b, ' ')[1]) THEN 'agree' END AS verdict FROM v UNION ALL SELECT 'type', CASE WHEN contains(a, b) OR contains(b, a) THEN 'agree' ELSE 'disagree' END FROM v)
SELECT field, verdict, count(*) AS n FROM w GROUP BY 1, 2""")
def agreement(spark, d):
    return curate.agreement(t(spark, d, "part"), {"name": (F.upper("p_name"), F.element_at(F.split("p_name", " "), 1)), "type": (F.col("p_type"), F.col("p_name"))})


@query("""SELECT doc_id AS id, lang AS value, CASE WHEN quality = 1 THEN lang ELSE 'xx' END AS strict, CASE WHEN toxic = 1 THEN [lang] ELSE ['yy'] END AS truths, quality = 1 AS strict_match, toxic = 1 AS multi_match
FROM documents JOIN labels USING (doc_id) WHERE NOT (quality = 1 OR toxic = 1) AND n_chars >= 500""")
def error_audit(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    predictions = x.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") >= 500, F.col("lang")).alias("value"))
    truth = x.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx").alias("strict"), F.when(F.col("toxic") == 1, F.array("lang")).otherwise(F.array(F.lit("yy"))).alias("truths"))
    return curate.error_audit(predictions, truth)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_ids(spark, d):
    return curate.pending_ids(t(spark, d, "documents"), t(spark, d, "labels"), F.col("quality") == 1, "doc_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def applicability_gate(spark, d):
    rules = spark.createDataFrame([("stem", "click"), ("stem", "view"), ("cap", "error")], "feature string, view string")
    return curate.applicability_gate(t(spark, d, "events"), "event_type", rules, "stem").select("event_id", "event_type")


# --- heads, metrics and calibration

CLASSES = [str(k) for k in range(10)]


def logits(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(X.doubles(F.col("embedding")), 1, 10).alias("logits"), "label")


SOFT = "lg AS (SELECT vec_id AS id, label, list_transform(embedding[1:10]::DOUBLE[], lambda x: exp((x - list_max(embedding[1:10]::DOUBLE[])) / {t})) AS e FROM embeddings), sm AS (SELECT id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM lg)"
SHARP = SOFT.format(t="0.05::DOUBLE")
TOP2 = "tp AS (SELECT id, label, p, list_position(p, list_max(p)) - 1 AS k1, list_max(p) AS p1, list_sort(p, 'DESC')[2] AS p2 FROM sm), tq AS (SELECT *, list_position(p, p2) - 1 AS k2, CASE WHEN p1 >= 0.6 AND p1 - p2 >= 0.2 THEN 'confident' WHEN p1 >= 0.3 THEN 'uncertain' ELSE 'not_determinable' END AS status FROM tp)"


def judged(spark, d):
    """``id, label, value, confidence, second, second_confidence, status`` from softmax at temperature 0.05."""
    p = logits(spark, d).withColumn("p", X.softmax(F.col("logits"), 0.05))
    return p.select("id", "label", X.predict_contract(F.col("p"), CLASSES).alias("c")).select("id", "label", "c.*")


@query(f"WITH {SOFT.format(t='2.0::DOUBLE')} SELECT id, list_transform(p, lambda x: round(x, 6)) AS p FROM sm")
def softmax(spark, d):
    return logits(spark, d).select("id", F.transform(X.softmax(F.col("logits"), 2.0), lambda x: F.round(x, 6)).alias("p"))


@query(f"WITH {SHARP}, {TOP2} SELECT id, CASE WHEN status <> 'not_determinable' THEN k1::VARCHAR END AS value, round(p1, 6) AS confidence, k2::VARCHAR AS second, status FROM tq")
def predict_contract(spark, d):
    return six(judged(spark, d).select("id", "value", "confidence", "second", "status"))


PRED = f"{SHARP}, {TOP2}, pr AS (SELECT id, label::VARCHAR AS truth, CASE WHEN status <> 'not_determinable' THEN k1::VARCHAR END AS said, k1::VARCHAR AS best, p1 FROM tq)"


def predictions(spark, d):
    return judged(spark, d).select("id", F.col("label").cast("string").alias("truth"), F.col("value").alias("said"), "confidence")


REPORT = """cm AS (SELECT a.c AS truth, b.c AS predicted, (SELECT count(*) FROM pr WHERE pr.truth = a.c AND pr.said = b.c) AS n FROM cl a, cl b),
rp AS (SELECT c AS class, (SELECT count(*) FROM pr WHERE truth = c AND said IS NOT NULL) AS support, (SELECT count(*) FROM pr WHERE truth = c AND said = c) AS ok, (SELECT count(*) FROM pr WHERE said = c AND truth IS NOT NULL) AS said FROM cl),
f1 AS (SELECT class, support, CASE WHEN said > 0 THEN ok / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN ok / support ELSE 0 END AS recall, CASE WHEN ok > 0 THEN 2.0::DOUBLE * ok / (said + support) ELSE 0 END AS f1 FROM rp)"""
CL = "cl AS (SELECT truth AS c FROM pr WHERE said IS NOT NULL UNION SELECT said FROM pr WHERE said IS NOT NULL)"


@query(f"WITH {PRED}, {CL}, {REPORT} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f1")
def classification_metrics(spark, d):
    return six(heads.classification_metrics(predictions(spark, d), "truth", "said"))


@query(f"WITH {PRED}, {CL}, {REPORT} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return heads.confusion(predictions(spark, d).filter("said is not null"), "truth", "said")


@query(f"WITH {PRED}, {CL}, {REPORT} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1")
def class_report(spark, d):
    return six(heads.class_report(predictions(spark, d).filter("said is not null"), "truth", "said"))


@query(f"""WITH {SHARP}, m AS (SELECT label, g AS k, avg(p[g + 1]) AS p, count(*) AS n FROM sm, range(10) r(g) GROUP BY 1, 2),
x AS (SELECT label, max(n) AS n, list(p ORDER BY k) AS p FROM m GROUP BY 1), y AS (SELECT label, n, list_max(p) AS p1, list_sort(p, 'DESC')[2] AS p2, list_position(p, list_max(p)) - 1 AS k1 FROM x)
SELECT label, n, CASE WHEN p1 >= 0.3 THEN k1::VARCHAR END AS value, round(p1, 6) AS confidence, CASE WHEN p1 >= 0.6 AND p1 - p2 >= 0.2 THEN 'confident' WHEN p1 >= 0.3 THEN 'uncertain' ELSE 'not_determinable' END AS status FROM y""")
def multi_view(spark, d):
    p = logits(spark, d).withColumn("p", X.softmax(F.col("logits"), 0.05))
    return six(heads.multi_view(p, "label", "p", CLASSES).select("label", "n", "value", "confidence", "status"))


TEMPERATURES = (0.5, 1.0, 2.0, 4.0)


@query("""WITH g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS temperature), l AS (SELECT temperature, label, list_transform(embedding[1:10]::DOUBLE[], lambda x: exp((x - list_max(embedding[1:10]::DOUBLE[])) / temperature)) AS e FROM embeddings, g)
SELECT temperature, round(avg(-ln(greatest(e[label + 1] / list_sum(e), 1e-12))), 6) AS nll FROM l GROUP BY 1""")
def calibrate_temperature(spark, d):
    return six(heads.calibrate_temperature(logits(spark, d), "logits", "label", TEMPERATURES))


RIGHT = f"WITH {PRED}, ok AS (SELECT p1 AS c, (best = truth)::INT AS ok FROM pr)"


def confident(spark, d):
    return logits(spark, d).withColumn("p", X.softmax(F.col("logits"), 0.05)).select(F.array_max("p").alias("c"), (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).alias("ok"))


@query(f"{RIGHT}, b AS (SELECT greatest(1, ceil(c * 10))::INT AS bin, count(*) AS n, avg(ok) AS accuracy, avg(c) AS confidence FROM ok GROUP BY 1) SELECT r.k::INT AS bin, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM range(1, 11) r(k) LEFT JOIN b ON b.bin = r.k")
def reliability(spark, d):
    return six(heads.reliability(confident(spark, d), "c", F.col("ok")))


@query(f"{RIGHT}, b AS (SELECT greatest(1, ceil(c * 10))::INT AS bin, count(*) AS n, avg(ok) AS accuracy, avg(c) AS confidence FROM ok GROUP BY 1) SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, d):
    return six(heads.calibration_error(heads.reliability(confident(spark, d), "c", F.col("ok"))))


@query(f"{RIGHT}, g AS (SELECT round(0.95 - 0.05 * k, 2)::DOUBLE AS threshold FROM range(18) r(k)), a AS (SELECT threshold, count(*) AS n, avg(ok) AS acc FROM g JOIN ok ON c >= threshold GROUP BY 1) SELECT max(threshold) AS threshold FROM a WHERE n >= 10 AND acc >= 0.08")
def confidence_threshold(spark, d):
    return heads.confidence_threshold(confident(spark, d), "c", F.col("ok"), target=0.08)


@query(f"WITH {PRED} SELECT count(*) AS total, count(*) FILTER (said IS NULL) AS abstained, count(*) FILTER (said = truth) AS correct, round(count(*) FILTER (said = truth) / count(said), 6) AS accuracy FROM pr WHERE truth IS NOT NULL")
def per_item_accuracy(spark, d):
    return six(heads.per_item_accuracy(predictions(spark, d), "truth", "said"))


@query("WITH v AS (SELECT source, quality::VARCHAR AS value, count(*) AS votes FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT *, (sum(votes) OVER (PARTITION BY source))::BIGINT AS n FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, value) = 1")
def consensus(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("q", F.col("quality").cast("string"))
    return heads.consensus(x, "source", "q")


SOURCE_TRUTH = "tr AS (SELECT DISTINCT source, CASE ascii(right(source, 1)) % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS truth FROM documents)"
VOTES = "v AS (SELECT source, quality::VARCHAR AS value, count(*) AS votes FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, (sum(votes) OVER (PARTITION BY source))::BIGINT AS n FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, value) = 1)"


def voted(spark, d):
    """Labels of each source as votes, and a truth for two thirds of the sources."""
    docs = t(spark, d, "documents")
    last = F.ascii(F.right("source", F.lit(1))) % 3
    truths = docs.select("source", F.when(last == 0, "1").when(last == 1, "0").alias("truth")).distinct()
    return docs.join(t(spark, d, "labels"), "doc_id").withColumn("q", F.col("quality").cast("string")), truths


@query(f"WITH {VOTES}, {SOURCE_TRUTH} SELECT source, value, votes, n, truth, value = truth AS correct FROM c JOIN tr USING (source) WHERE truth IS NOT NULL")
def consensus_against(spark, d):
    votes, truths = voted(spark, d)
    return heads.consensus_against(votes, "source", "q", truths, "truth")


@query(f"WITH {VOTES}, {SOURCE_TRUTH} SELECT count(*) AS total, count(*) FILTER (value = truth) AS correct, round(coalesce(count(*) FILTER (value = truth) / nullif(count(*), 0), 0), 6) AS accuracy FROM c JOIN tr USING (source) WHERE truth IS NOT NULL")
def consensus_accuracy(spark, d):
    votes, truths = voted(spark, d)
    return six(heads.consensus_accuracy(votes, "source", "q", truths, "truth"))


@query(f"WITH {SHARP}, {TOP2} SELECT l AS level, (SELECT count(*) FROM tq WHERE status = l) AS n FROM (SELECT unnest(['confident', 'uncertain', 'not_determinable', 'never']) AS l)")
def confidence_breakdown(spark, d):
    return heads.level_counts(judged(spark, d), "status", ["confident", "uncertain", "not_determinable", "never"])


def planted(spark, d):
    """Vectors with a class that they do carry: the bucket of the sum of their first two numbers."""
    s = F.element_at("embedding", 1) + F.element_at("embedding", 2)
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(s < -0.08, "low").when(s > 0.08, "high").otherwise("mid").alias("planted"))


@query()
def train_head(spark, d):
    """A perceptron chosen by macro F1 of held-out groups: what the chosen run says of every vector."""
    rows = planted(spark, d).withColumn("specimen", F.floor(F.col("id") / 3))
    model, _ = heads.choose_head(rows, "vec", "planted", "specimen")
    return heads.multi_head(rows, "vec", {"planted": model}).select("id", "feature", "value", F.round("confidence", 6).alias("confidence"), "status")


@query()
def train_head_runs(spark, d):
    """Macro F1 on the validation groups after each run, and which run was chosen."""
    rows = planted(spark, d).withColumn("specimen", F.floor(F.col("id") / 3))
    return heads.choose_head(rows, "vec", "planted", "specimen")[1]


@query()
def multi_head(spark, d):
    rows = planted(spark, d).withColumn("sign", F.when(F.element_at("vec", 3) > 0, "plus").otherwise("minus"))
    models = {n: heads.train_head(rows, "vec", n) for n in ("planted", "sign")}
    return heads.multi_head(rows, "vec", models).select("id", "feature", "value", "status")


# --- pages

CHROME = r"(?is)<(?:nav|header|footer|script|style|aside)\b.*?</(?:nav|header|footer|script|style|aside)\s*>"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(html, '{CHROME}', ' ', 'g') AS bare FROM pages), m AS (SELECT page_id, bare, regexp_extract(bare, '(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)\s*>', 1) AS main FROM b),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(CASE WHEN main <> '' THEN main ELSE bare END, '(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|$)', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM m)
SELECT page_id, md5(nullif(array_to_string(ps, chr(10) || chr(10)), '')) AS text, len(ps) AS n FROM p""")
def page_text(spark, d):
    text = pages.page_text(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.md5(text).alias("text"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n\n"))).alias("n"))


LINK_START = r'<a\b[^>]*\bhref="([^"]*)"[^>]*>'


@query(rf"""WITH a AS (SELECT page_id, url, generate_subscripts(h, 1) AS k, unnest(h) AS src FROM (SELECT page_id, url, regexp_extract_all(html, '(?is){LINK_START}', 1) AS h FROM pages)),
b AS (SELECT page_id, url, k, regexp_replace(regexp_extract(src, '^[^'']*'), '^/([t-z])', '../\1') AS src FROM a WHERE NOT regexp_matches(src, '(?i)[aeiou]$')),
c AS (SELECT page_id, k, src, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS folder FROM b
    WHERE src <> '' AND NOT regexp_matches(lower(src), '^data:|\.svg$')),
e AS (SELECT page_id, min(k) AS k, CASE WHEN regexp_matches(src, '^https?://') THEN src WHEN src LIKE '//%' THEN scheme || src WHEN src LIKE '/%' THEN origin || src
    WHEN src LIKE '../%' THEN regexp_replace(folder, '([^/:])/[^/]+/$', '\1/') || substr(src, 4) WHEN folder <> '' THEN folder || src ELSE origin || '/' || src END AS image FROM c GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(k)) AS place, image FROM e
WHERE NOT regexp_matches(lower(image), '{'|'.join(pages.DECORATION)}') GROUP BY page_id, image QUALIFY place <= 3""")
def page_images(spark, d):
    """The test pages hold no images, so each link becomes one of its address: a small one where that ends in a vowel,
    else one that loads late, from the folder above where its name begins with t to z."""
    small = F.regexp_replace("html", r'(?is)<a\b[^>]*\bhref="([^"]*[aeiou])"[^>]*>', '<img width="64" src="$1">')
    late = F.regexp_replace(small, f"(?is){LINK_START}", '<img height="300" data-src="$1">')
    p = t(spark, d, "pages").withColumn("html", F.regexp_replace(late, 'data-src="/([t-z])', 'data-src="../$1'))
    return pages.page_images(p, "page_id", "html", "url")


LINKS = r"""l AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)(<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>)', 1) AS a FROM pages)),
k AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, regexp_extract(tag, '(?i)\bhref="([^"]*)"', 1) AS href FROM l)"""


@query(f"WITH {LINKS} SELECT lower(text) AS name, arg_max(href, page_id * 100000 + place) AS href FROM k WHERE text <> '' GROUP BY 1")
def link_index(spark, d):
    return pages.link_index(pages.links(t(spark, d, "pages"), "page_id", "html"), ["page_id", "place"])


@query(f"WITH {LINKS} SELECT lower(text) AS name, arg_min(href, page_id * 100000 + place) AS href FROM k WHERE text <> '' GROUP BY 1")
def link_index_first(spark, d):
    """The first address of each link text."""
    return pages.link_index(pages.links(t(spark, d, "pages"), "page_id", "html"), ["page_id", "place"], last=False)


@query(f"""WITH {LINKS}, w AS (SELECT page_id, place, href, text || ' ' || lower(lead(text) OVER (PARTITION BY page_id ORDER BY place)) AS text FROM k WHERE text <> '')
SELECT lower(regexp_extract(text, '^([A-Z][a-z]+ [a-z]+)', 1)) AS name, arg_min(href, page_id * 100000 + place) AS href FROM w WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]+') GROUP BY 1""")
def link_index_binomial(spark, d):
    """Two-word names only, each with its first address; the test pages' links are single words, so each is read with the next."""
    found = pages.links(t(spark, d, "pages"), "page_id", "html")
    after = F.lower(F.lead("text").over(Window.partitionBy("page_id").orderBy("place")))
    return pages.link_index(found.withColumn("text", F.concat("text", F.lit(" "), after)), ["page_id", "place"], last=False, binomial=True)


@query(f"""WITH {LINKS}, i AS (SELECT lower(text) AS name, arg_max(href, page_id * 100000 + place) AS href FROM k WHERE text <> '' GROUP BY 1),
n AS (SELECT doc_id AS id, g AS place, string_split(text, ' ')[g + 1] AS name FROM documents, range(3) r(g)) SELECT id, arg_min(href, place) AS href FROM n JOIN i ON lower(n.name) = i.name GROUP BY 1""")
def resolve_with_aliases(spark, d):
    words = F.split("text", " ")
    names = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"), words.alias("w")).select("id", "place", F.get("w", F.col("place")).alias("name"))
    return pages.resolve_with_aliases(names, link_index(spark, d))


# --- incremental and streaming


@query("SELECT user_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def latest_verdict(spark, d):
    return streams.latest_verdict(t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def stream_latest(spark, d):
    """The streaming form of ``latest_verdict``: keyed state, changed keys upserted by folder."""
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
    stream = streams.event_stream(spark, f"{d}/events*.parquet", read_table(spark, d, "events").schema)
    streams.stream_latest(stream, "user_id", "event_type", ["ts", "event_id"], f"{path}/latest", f"{path}/progress").awaitTermination()
    return read_folders(spark, f"{path}/latest").filter(F.col("event_type") != streams.UNDO).select("user_id", F.col("event_type").alias("verdict"))


STATUS_SQL = "SELECT date_trunc('day', ts) AS window_start, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2"


@query(STATUS_SQL)
def status_by_window(spark, d):
    return streams.status_by_window(t(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(STATUS_SQL + " HAVING date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events)")
def stream_status(spark, d):
    """The streaming form of ``status_by_window``; windows that ended less than an hour before the last row are left out."""
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
    stream = streams.event_stream(spark, f"{d}/events*.parquet", read_table(spark, d, "events").schema)
    streams.stream_counts(stream.select("ts", "event_type"), f"{path}/counts", f"{path}/progress").awaitTermination()
    closed = streams.closed_windows(read_folders(spark, f"{path}/counts"), "1 hour")
    return closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _hits_sql():
    from .retrieval import HITS

    return f"WITH {HITS} SELECT query_id, grp, cand_id, sim, rank FROM hits WHERE rank <= 20"


@query(_hits_sql())
def incremental_topk(spark, d):
    """Hits of an earlier state of the vectors (a third not there yet, a part of the others different), brought up to
    date, equal hits over all."""
    v = entity_vectors(spark, d)
    other = F.col("entity_id") % 15 == 1
    earlier = v.filter("entity_id % 3 <> 0").withColumn("vec", F.when(other, F.reverse("vec")).otherwise(F.col("vec")))
    stored = V.topk_by_group(earlier.filter("entity_id % 20 = 0"), earlier, 20)
    changed = v.filter((F.col("entity_id") % 3 == 0) | other)
    return streams.incremental_topk(stored, v.filter("entity_id % 20 = 0"), v, changed, 20, V.topk_by_group)
