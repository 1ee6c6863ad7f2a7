"""Columns of the caller whose names the operators use themselves, and tables with nothing in them."""

import re
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from kindred.llm import exact_dedup, kneser_ney, mixing, ngram_join, packing, repetition, secrets, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "de", None, 13), (3, None, None, "t", 0), (None, "", "en", "t", 0), (None, "w " * 3000, None, "s", 6000)]


def internal_names():
    """Every plain name that the modules write in quotes: aliases, keys and columns of their own."""
    found = set()
    for module in (exact_dedup, kneser_ney, mixing, ngram_join):
        found |= set(re.findall(r'"(_?[a-z][a-z0-9_]{0,11})"', Path(module.__file__).read_text()))
    found |= {"_row", "_key", "_dropped", "_repeated", "_hot", "_is", "_bucket", "_n", "_start", "_place", "_sha", "_gone", "_size", "_copies", "_copy", "_kept", "_perplexity", "_threshold", "_trusted", "_lang", "_own", "_all"}
    return sorted(found - {c.split()[0] for c in SCHEMA.split(", ")} - {"left_semi", "left_anti", "inner", "smallest", "largest"})


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    names = internal_names()
    return spark.createDataFrame([(*r, *[f"{n}!" for n in names]) for r in ROWS], SCHEMA + "".join(f", `{n}` string" for n in names))


OPERATORS = {
    "join": lambda d: ngram_join.jaccard_components(d),
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "mix": lambda d: mixing.mix_sources(d),
    "quality": lambda d: kneser_ney.quality_classifier(d, d.select("doc_id"), names=("p1", "p2", "p3")).select("doc_id", "text", "p1", "p2", "p3"),
    "rules": lambda d: repetition.quality_rules(d),
    "tokens": lambda d: tokens.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).drop("sequence_id", "offset"),
    "sharding": lambda d: sharding.shard(d).drop("slot"),
    "secrets": lambda d: secrets.scan(d),
    "toxicity": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_with_clashing_columns_and_empty_tables(plain, clashing, name):
    run = OPERATORS[name]
    want, got = run(plain), run(clashing)
    assert want.columns == got.columns
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))
    empty = run(plain.filter("doc_id < 0"))
    assert empty.columns == want.columns and empty.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns_and_empty_tables(spark, plain, clashing, name, sf_dir):
    stage = dict(corpus_pipeline.STAGES)[name]
    want, got = stage(spark, plain, sf_dir), stage(spark, clashing, sf_dir)
    rows = got.collect()
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.length for r in want.collect())
    else:
        assert got.columns == clashing.columns and want.columns == plain.columns
        assert all(r[n] == f"{n}!" for r in rows for n in internal_names())
        assert sorted(repr(tuple(r)) for r in want.collect()) == sorted(repr(tuple(r)[: len(plain.columns)]) for r in rows)
    assert stage(spark, plain.filter("doc_id < 0"), sf_dir).count() == 0
