"""The pipeline against a brute-force version, and the queries' columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from kindred.llm import kneser_ney, queries
from kindred.llm.common import written

from .test_corpus import WORD, brute_components, check_packing


def brute_perplexity(texts, trusted):
    """Interpolated modified Kneser-Ney by dictionaries, straight from the definition."""
    order = kneser_ney.ORDER

    def grams(t):
        s = chr(kneser_ney.EDGE) * (order - 1) + t
        return [s[k : k + order] for k in range(len(t))]

    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, gone = {}, {}, {}
    for k, c in counts.items():
        discount[k] = kneser_ney.discounts(Counter(c.values()))
        total[k], gone[k] = Counter(), Counter()
        for g, n in c.items():
            total[k][g[:-1]] += n
            gone[k][g[:-1]] += discount[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, context = len(g), g[:-1]
        if not total[k][context]:
            return p(g[1:])
        n = counts[k][g]
        share = (n - discount[k][min(n, 3) - 1]) / total[k][context] if n else 0.0
        return share + gone[k][context] / total[k][context] * p(g[1:])

    known = {}
    return [math.exp(-sum(math.log(known.get(g) or known.setdefault(g, p(g))) for g in grams(t)) / len(t)) if t else None for t in texts]


def brute_quality(rows, labels):
    trusted_ids = {r.doc_id for r in labels if r.quality == 1}
    back = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    trusted = [r.text for r in rows if r.doc_id in trusted_ids and r.text and not back(r)]
    scores = brute_perplexity([r.text or "" for r in rows], trusted)
    limit = {}
    for lang in {None} | {r.lang for r in rows}:
        steps = sorted(math.ceil(math.log(s) * 1000) for r, s in zip(rows, scores) if r.doc_id in trusted_ids and back(r) and lang in (None, r.lang) and s)
        if steps:
            limit[lang] = math.exp(next(x for k, x in enumerate(steps) if sum(y <= x for y in steps) >= 0.995 * len(steps)) / 1000)
    return [r for r, s in zip(rows, scores) if s is not None and s <= limit.get(r.lang, limit.get(None, math.inf))]


def brute_mix(rows):
    size = {k: len(re.findall(WORD, r.text or "")) for k, r in enumerate(rows)}
    sums = Counter()
    for k, r in enumerate(rows):
        sums[r.source] += size[k]
    order = sorted(s for s in sums if s is not None) + [None] * (None in sums)
    weight, held, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(sums.values())
    while True:
        open_ = [s for s in order if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = {s: 3 * sums[s] for s in open_ if weight[s] * level > 3 * sums[s]}
        if not over:
            break
        held.update(over)
    draw = lambda key: int(hashlib.md5(f"mix|{key}".encode()).hexdigest()[:13], 16) / 2**52
    out = []
    for source in order:
        rate = held.get(source, weight[source] * level) / sums[source] if sums[source] else 0
        groups = defaultdict(list)
        for k, r in enumerate(rows):
            if r.source == source:
                groups[size[k] - size[k] % (1 << max(0, size[k].bit_length() - 3))].append(r)
        upto, start = 0, draw("" if source is None else "s" + source)
        for name in sorted(groups):
            before, upto = upto, upto + len(groups[name])
            more = math.floor(start + (rate - math.floor(rate)) * upto) - math.floor(start + (rate - math.floor(rate)) * before)
            least = sorted(draw(r.doc_id) for r in groups[name])[:more]
            for r in groups[name]:
                out += [r.doc_id] * (math.floor(rate) + (draw(r.doc_id) in least))
    return out


def test_stages_equal_brute_force(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    rows, labels = docs.orderBy("doc_id").collect(), queries.labels(spark, sf_dir).collect()
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = written(stage["quality classifier"](spark, docs, sf_dir), "a")
    want = brute_quality(rows, labels)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want)
    once = written(stage["exact dedup"](spark, kept, sf_dir), "b")
    first = {}
    for r in want:
        first.setdefault(r.text, r)
    want = list(first.values())
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == [r.doc_id for r in want]
    near = written(stage["n-gram Jaccard join"](spark, once, sf_dir), "c")
    roots = brute_components([r.text for r in want], 5, 80)
    want = [r for k, r in enumerate(want) if roots[k][1] == k]
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == [r.doc_id for r in want]
    mixed = written(stage["mixing sources"](spark, near, sf_dir), "d")
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(brute_mix(want))
    packed = stage["packing"](spark, mixed.dropDuplicates(["doc_id"]), sf_dir).collect()
    assert check_packing(packed, {r.doc_id: r.text for r in mixed.collect()}) > 0.9


def test_run_gives_every_token_of_every_copy(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = defaultdict(int)
    for r in pieces.collect():
        whole[r.doc_id, r.doc_tokens] += r.length
    assert whole and all(n % tokens == 0 for (_, tokens), n in whole.items())


CONTRACT = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_spelling_variants": "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns_and_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert set(CONTRACT.get(name, "doc_id").split()) <= set(df.columns)
    n = df.count()
    assert n > 0 if name in ("op5_packing", "op6_secret_scan", "op13_spelling_variants") else n == queries.documents(spark, sf_dir).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    from .. import oracle

    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE_SQL[name], 12) is None


def test_toxicity_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    scored = queries.op8_toxicity(spark, sf).join(queries.labels(spark, sf), "doc_id").filter("held_out")
    got = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("accuracy"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false_alarms")).first()
    assert got.accuracy > 0.9 and got.false_alarms < 0.05
