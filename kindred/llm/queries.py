"""The corpus queries with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, kneser_ney, line_dedup, merkle, mixing, ngram_join, packing, repetition, secrets, sharding, spelling, tokens, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id):
    """A fifth of the documents, which no model for toxicity learns from."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir)).drop("repetitive")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = labels(spark, sf_dir).filter("quality = 1")
    scored = kneser_ney.quality_classifier(documents(spark, sf_dir).select("doc_id", "text", "lang"), trusted)
    return scored.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(documents(spark, sf_dir), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_shared_lines(documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5, keep="largest")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # a fifth of the rows is tampered with
    altered = merkle.leaf([*[docs[c] for c in fields[:-1]], merkle.lower_ascii(docs["text"])])
    made = merkle.manifest(docs, fields=tuple(fields), others={"tampered": F.when(held_out(docs["doc_id"]), altered)})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    proven = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), thinned=97)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_ngram_jaccard_join,
        op3_exact_dedup,
        op4_quality_rules,
        op5_packing,
        op6_secret_scan,
        op7_quality_classifier,
        op8_toxicity,
        op9_mixing,
        op10_sharding,
        op11_line_dedup,
        op12_merkle_manifest,
        op13_spelling_variants,
    )
}

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 3 AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3] AS weight FROM sources),
leveled AS (
  SELECT *, cap / weight AS ratio,
         ((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))) AS level
  FROM weighted
  WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio < level THEN cap::DOUBLE
              ELSE weight * (SELECT l.level FROM leveled l WHERE NOT l.ratio < l.level ORDER BY l.ratio, l.source ASC NULLS LAST LIMIT 1) END AS target
  FROM leveled),
rated AS (
  SELECT doc_id, size, sized.source, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         size - size % (1::BIGINT << greatest(0, len(bin(size)) - 3)) AS class,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw,
         ('0x' || substr(md5('mix|' || coalesce('s' || sized.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY draw) AS place,
         count(*) OVER (PARTITION BY source ORDER BY class) AS upto, count(*) OVER (PARTITION BY source, class) AS docs FROM rated),
quotas AS (
  SELECT *, floor(start + (rate - floor(rate)) * upto) - floor(start + (rate - floor(rate)) * (upto - docs)) AS more FROM placed),
limited AS (SELECT *, max(CASE WHEN place = more THEN draw END) OVER (PARTITION BY source, class) AS last FROM quotas)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw <= last THEN 1 ELSE 0 END) AS taken FROM limited
"""


LINE_DEDUP_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT r, keyed.doc_id, pos, line, coalesce(keeper <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

#: CRC-32 of the UTF-8 bytes of {0}: every byte enters with seven empty steps behind it.
CRC32_SQL = """xor(4294967295, list_reduce(flatten(list_transform(range(0, len(hex(encode({0}))), 2), lambda i: [('0x' || substr(hex(encode({0})), i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"""
FIELDS_SQL = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tree_sql(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves(g, i, n, h)`` with the hashes left and right of them in their run."""
    return f"""{name}_nodes(k, g, i, n, h) AS (
  SELECT 0, g, i, n, h FROM {leaves}
  UNION ALL SELECT k + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY k, g, i // 16, n),
{name} AS (
  SELECT a.k, a.g, a.i, a.n, a.h, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b ON a.k = b.k AND a.g = b.g AND a.i // 16 = b.i // 16 GROUP BY ALL)"""


MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256({FIELDS_SQL} || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256({FIELDS_SQL} || coalesce(octet_length(encode(text)) || ':' || {LOWER_SQL.format("text")}, '-')) AS altered,
         {CRC32_SQL.format("doc_id::VARCHAR")} % 5 = 0 AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
leaves AS (SELECT g, pos AS i, n, leaf AS h FROM placed),
{tree_sql("low", "leaves")},
subroots AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
{tree_sql("high", "subroots")},
ways AS (
  SELECT doc_id, placed.g, pos, leaf, CASE WHEN tampered THEN altered ELSE leaf END AS shown,
         list(low.l || '|' || low.r ORDER BY low.k) FILTER (low.n > 1) AS way, list(low.l || low.r ORDER BY low.k) FILTER (low.n > 1) AS sides
  FROM placed JOIN low ON low.g = placed.g AND low.i = pos // (16 ** low.k)::BIGINT GROUP BY ALL),
tops AS (
  SELECT i AS g, h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
         (SELECT list(x.l || '|' || x.r ORDER BY x.k) FROM high x WHERE x.n > 1 AND x.i = subroots.i // (16 ** x.k)::BIGINT) AS way,
         (SELECT list(x.l || x.r ORDER BY x.k) FROM high x WHERE x.n > 1 AND x.i = subroots.i // (16 ** x.k)::BIGINT) AS sides
  FROM subroots),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_concat(ways.sides, tops.sides), ''), '')) AS proof_sha256,
         list_reduce(list_concat([shown], ways.way, tops.way), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM ways JOIN tops USING (g))
SELECT *, folded_root = root AS verified FROM folded
"""

SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {LOWER_SQL.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, {CRC32_SQL.format("(doc_id::VARCHAR || ':' || run)")} AS h FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
thinned AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM counted),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, length(word) AS size, unnest(range(length(word))) AS pos FROM words),
short AS (SELECT word, n, size, pos, left(word, pos) || substr(word, pos + 2) AS rest FROM less),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM short a JOIN short b ON a.size = b.size AND a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways(word, pos) AS (SELECT word, word FROM forms UNION ALL SELECT ways.word, form FROM ways JOIN forms ON pos = forms.word WHERE form IS NOT NULL)
SELECT f.word, f.form, ways.pos AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways ON ways.word = f.word JOIN forms e ON e.word = ways.pos WHERE e.form IS NULL
"""

ORACLE_SQL = {"op3_exact_dedup": EXACT_DEDUP_SQL, "op9_mixing": MIXING_SQL, "op11_line_dedup": LINE_DEDUP_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_spelling_variants": SPELLING_SQL}
