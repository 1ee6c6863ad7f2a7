"""Line dedup, manifest and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import line_dedup, merkle, spelling

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n_lines string, key string, _text string, node string, grp string, word string, n string"


def table(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids, sources = ids or range(len(texts)), sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, s, None, 3, "l", "k", "t", "x", "g", "w", "c") for i, t, s in zip(ids, texts, sources)], SCHEMA)


# --- lines


def brute_lines(rows, chars, docs):
    """rows: (id, text) -> (id, lines, dropped, text), no id as the smallest."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def shared_lines(seed, n=120):
    random.seed(seed)
    pool = [" ".join(random.choices(["alpha", "Beta", "gämma", "漢字", "x"], k=random.randint(1, 9))) for _ in range(40)]
    spaced = lambda x: random.choice(["", " ", "\t\r", " \x0b"]) + random.choice([x, x.upper()]) + random.choice(["", " \x0c"])
    texts = [None, "", "\n\n", " \n\t", "y" * 70_000, "\n".join(["the same line of the same text"] * 3000)]
    return texts + ["\n".join(spaced(random.choice(pool)) for _ in range(random.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed,chars,docs,options", [(1, 12, 3, {}), (2, 1, 2, {}), (3, 12, 3, {"most_bits": 0}), (4, 12, 3, {"most_keys": 0}), (5, 20, 5, {"most_bits": 0, "most_keys": 0})])
def test_shared_lines_equal_brute_force(spark, seed, chars, docs, options, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", 3000)
    texts = shared_lines(seed)
    ids = [None if k % 29 == 7 else k // 2 if k % 11 == 3 else k for k in range(len(texts))]  # some ids repeat or are missing
    docs_ = table(spark, texts, ids)
    got = line_dedup.without_shared_lines(docs_, min_chars=chars, min_docs=docs, **options)
    assert got.columns == [*docs_.columns, "n_lines_", "n_dropped"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in rows), key=repr) == brute_lines(list(zip(ids, texts)), chars, docs)
    assert all((r.n_lines, r.key, r._text) == ("l", "k", "t") for r in rows)


def test_small_filters_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", 1 << 7)  # many lines a slice: suspects many, loses none
    monkeypatch.setattr(line_dedup, "BITS_A_LINE", 1)
    texts = shared_lines(9)
    got = line_dedup.without_shared_lines(table(spark, texts), min_chars=12, min_docs=2)
    assert sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute_lines(list(enumerate(texts)), 12, 2)


def test_filter_suspects_repeats_only(spark):
    once = [f"a line of its own that stands in document {k} alone {k * k}" for k in range(3000)]
    texts = spark.createDataFrame([(k, x + ("\nwhat several documents have in common, word for word" if k % 100 == 0 else "")) for k, x in enumerate(once)], "_id long, _text string")
    found = line_dedup.suspected(texts.repartition(7), 40, 1 << 29).collect()
    assert 30 <= len(found) < 60
    assert sum(bytes(r.key) == hashlib.sha256(b"what several documents have in common, word for word").digest() for r in found) == 30


def test_lines_that_are_not_utf8_and_empty_tables(spark):
    odd = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("concat(cast(X'ff41c3' AS string), repeat('z', 50), '\n', 'b')").alias("text"))
    got = line_dedup.without_shared_lines(odd, min_docs=2).select("doc_id", "n_dropped", F.hex("text").alias("h")).collect()
    assert sorted((r.doc_id, r.n_dropped, len(r.h)) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 0, 110)]
    assert line_dedup.without_shared_lines(table(spark, ["a"]).filter("doc_id < 0")).count() == 0


# --- manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its siblings on each level as (left, right)."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            ways[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], ways


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append(((i is not None, i or 0), sha("".join(map(said, (i, s, None, 3, t)))), i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([leaf for _, leaf, _ in sorted(by[s])]) for s in sources}
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, leaf, i), way in zip(sorted(by[s]), trees[s][1]):
            out.append((i, leaf, trees[s][0], root, tuple(way + top)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 1}, {"b": 300, "a": 16, "ä": 2, None: 33, "": 5}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest_equals_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 32)
    rows = [(k, random.Random(k).choice([None, "", "T é\n", "x" * 3000, f"text {k}"]), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [rows[0], (None, "no id", rows[0][2])]  # a repeated row and one without an id
    docs = table(spark, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]).repartition(5)
    got = merkle.manifest(docs, others={"changed": merkle.leaf([F.lit("x")])})
    found = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("wrong", merkle.folded(F.col("changed"), F.col("path"))).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in found), key=repr) == brute_manifest(rows)
    assert all(r.folded == r.root and r.wrong != r.root and r.changed == sha("1:x") for r in found)


def test_manifest_does_not_depend_on_partitions_and_takes_empty_tables(spark):
    docs = table(spark, [f"t{k}" for k in range(500)], sources=["hot" if k % 3 else f"s{k % 7}" for k in range(500)])
    roots = {merkle.manifest(docs.repartition(n)).select("root").distinct().collect()[0][0] for n in (1, 13)}
    assert len(roots) == 1
    assert merkle.manifest(docs.filter("doc_id < 0")).count() == 0


# --- words


def brute_words(rows, least_n, thinned):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if thinned and h % thinned == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = defaultdict(list)
    for a, b in combinations(n, 2):
        if near(a, b):
            found[a].append(b)
            found[b].append(a)
    form = {w: min(found[w], key=lambda x: (-n[x], x)) if found[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,most,chunk", [(1, 50_000, 100_000), (2, 3, 10), (3, 20, 5), (4, 1, 1)])
def test_spelling_variants_equal_brute_force(spark, seed, most, chunk, monkeypatch):
    random.seed(seed)
    if chunk < 100_000:
        plain = spelling.near_words
        monkeypatch.setattr(spelling, "near_words", lambda words, most: plain(words, most, chunk))
    stems = ["aaaaa", "aaaaaa", "banana", "bananas", "étrangère", "naïveté", "aabbaabb", "x" * 300, "ÿÿÿÿÿ"]

    def changed(w):
        k = random.randrange(len(w) + 1)
        return random.choice([w, w.upper(), w[:k] + random.choice("abéÿn") + w[k:], w[:k] + w[k + 1 :], w[:k] + random.choice("abé") + w[k + 1 :]])

    texts = [None, "", "a bb ccc 漢字漢字漢字 12345"] + [random.choice([" ", ", ", "\n"]).join(changed(random.choice(stems)) for _ in range(random.randint(1, 40))) for _ in range(60)]
    ids = [None if k % 17 == 5 else k // 2 for k in range(len(texts))]
    got = spelling.spelling_variants(table(spark, texts, ids), least_n=2, thinned=7, most=most)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_words(list(zip(ids, texts)), 2, 7)


def test_ways_to_roots_are_followed_to_the_end(spark):
    forms = [(f"w{k}", f"w{k + 1}" if k < 20 else None) for k in range(21)] + [("alone", None)]
    got = spelling.with_roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {**{f"w{k}": "w20" for k in range(21)}, "alone": "alone"}
    assert spelling.spelling_variants(table(spark, ["abcde"]).filter("doc_id < 0")).count() == 0


def test_neighbours_share_prefixes():
    import pyarrow as pa

    words = spelling.Sorted(pa.array([b"ab", b"abc", b"abd", b"b"], pa.binary()))
    assert words.lcp.tolist() == [0, 2, 2, 0, 0]
    q, found = spelling.near_rows(words, np.arange(4), np.zeros(4, int), np.full(4, 4), np.zeros(4, int))
    assert sorted(zip(q.tolist(), found.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0)]
