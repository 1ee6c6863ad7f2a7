"""Toxicity by multiple-instance learning: sentences score, noisy-or makes the document's score.

Labels are of documents; which sentence offends is learned.  A document is toxic unless all its sentences are clean:
1 - prod(1 - p(sentence)), with p the logistic of a sentence's word features.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, first_by_draw, pieces_of, worker_cache, written

STRIP = b".,;:!?'\"()[]{}<>|*#$%&-_/"
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def word_features(word: bytes) -> list[str]:
    """The word without marks around it, and its beginnings (4 to 6 letters), lower case."""
    w = word.strip(STRIP).decode("utf-8", "replace").lower()
    return [w, *[f"{w[:k]}~" for k in (4, 5, 6) if len(w) > k]] if w else []


def sentences_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word's sentence (sentences end at . ! ? or a line end, and with the text), and the row of each."""
    marks = np.concatenate([[0], np.cumsum(_ENDS[words.raw])])[words.start]
    fresh = np.ones(len(marks), bool)
    fresh[1:] = (marks[1:] != marks[:-1]) | (words.row[1:] != words.row[:-1])
    return np.cumsum(fresh) - 1, words.row[fresh]


class Model:
    """Weights of features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def of_word(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))


def features_by_word(words: Words, index: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pairs of word code and feature number, sorted by word, and the features' names.

    With ``index`` only its features count, under its numbers.
    """
    names = {} if index is None else index
    word_of, feature_of = [], []
    for k, w in enumerate(words.dictionary.to_pylist()):
        for f in word_features(w):
            n = names.setdefault(f, len(names)) if index is None else names.get(f)
            if n is not None:
                word_of.append(k)
                feature_of.append(n)
    return np.array(word_of, np.int64), np.array(feature_of, np.int64), list(names) if index is None else []


def spread(codes: np.ndarray, word_of: np.ndarray, feature_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a word (by code) its features: places in ``codes`` and feature numbers."""
    first, last = np.searchsorted(word_of, codes), np.searchsorted(word_of, codes, "right")
    size = last - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(np.arange(len(codes)), size), feature_of[at]


def feature_counts(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """``feature, df, df_toxic`` over ``rows(t, y)``; tasks sum up their own documents first."""

    def counted(batches):
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                words, y = Words(piece.column("t")), piece.column("y").to_numpy()
                word_of, feature_of, names = features_by_word(words)
                n = max(len(words.dictionary), 1)
                seen = np.unique(words.row * n + words.codes)
                at, feature = spread(seen % n, word_of, feature_of)
                pairs = np.unique((seen // n)[at] * max(len(names), 1) + feature)
                row, feature = pairs // max(len(names), 1), pairs % max(len(names), 1)
                df = np.bincount(feature, minlength=len(names)).astype(np.int64)
                toxic = np.bincount(feature, weights=y[row], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(df), pa.array(toxic)], ["feature", "df", "df_toxic"])

    return rows.mapInArrow(counted, "feature string, df long, df_toxic long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("df_toxic").alias("df_toxic"))


def evidence(rows: DataFrame, features: list[str], piece_bytes: int) -> DataFrame:
    """``k, y, plain, sentence, feature``: a document's label, its sentences without any of the features, and, for
    each occurrence of a feature, the number of its sentence among those that have one."""
    shared = rows.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(features)})

    def found(batches):
        index = shared.value
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                words = Words(piece.column("t"))
                word_of, feature_of, _ = features_by_word(words, index)
                sentence, sentence_row = sentences_of(words)
                at, feature = spread(words.codes, word_of, feature_of)
                with_any, number = np.unique(sentence[at], return_inverse=True)
                n_rows = piece.num_rows
                row = words.row[at]
                begin = np.searchsorted(row, np.arange(n_rows + 1))
                first = np.searchsorted(sentence_row[with_any], np.arange(n_rows + 1))
                plain = np.bincount(sentence_row, minlength=n_rows) - np.diff(first)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("y"), pa.array(plain, pa.int64()), lists(number - first[row]), lists(feature)], ["k", "y", "plain", "sentence", "feature"])

    return rows.mapInArrow(found, "k long, y int, plain long, sentence array<int>, feature array<int>")


def fit(y: np.ndarray, plain: np.ndarray, row: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam) on the noisy-or likelihood.

    ``row`` is each sentence's document; ``sentence`` and ``feature`` are the occurrences; ``plain`` counts the
    sentences without features, which all score the bias.
    """
    n_sentences, n_rows = len(row), len(y)
    every = max(n_sentences + plain.sum(), 1)
    w, bias = np.zeros(n_features), -np.log(every / max(n_rows, 1)) - 3.0
    m = v = np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights=w[feature], minlength=n_sentences)
        p, base = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        clean = np.exp(np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_rows) + plain * np.log1p(-base))
        # d(-log likelihood)/dz: p in clean documents, -p q / (1 - q) in toxic ones
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g_z = p * pull[row]
        g = np.append(np.bincount(feature, weights=g_z[sentence], minlength=n_features), g_z.sum() + (plain * base * pull).sum()) / max(n_rows, 1)
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, usable, id_col: str, text: str, label: str, most_rows: int, least_df: int = 5, lift: float = 2.0, steps: int = 400, rate: float = 0.1, ridge: float = 2e-5, piece_bytes: int = 4 << 20
) -> Model:
    """A model of different labelled texts, at most ``most_rows`` of them in an order by hash (a documented bound).

    Features in fewer than ``least_df`` of these documents, or not ``lift`` times more frequent in toxic ones than the
    base rate (add-one smoothed), carry no evidence that a sentence offends and are left out.  Texts stay in the
    tasks; the driver sees the features kept and where they occur.
    """
    marked = labels.filter(usable).select(labels[id_col].alias("_id"), labels[label].cast("int").alias("y")).filter("y is not null and _id is not null")
    draw = F.xxhash64("_id").cast("double") / float(1 << 64) + 0.5
    drawn = first_by_draw(marked, draw, [F.xxhash64("_id"), "_id"], most_rows)
    joined = docs.select(docs[id_col].alias("_doc"), F.coalesce(docs[text], F.lit("")).alias("t")).join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    rows = written(joined.groupBy("t").agg(F.max("y").alias("y")).select(F.xxhash64("t").alias("k"), "t", "y"), "training")
    total = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = (total[1] + 1) / (total[0] + 2)
    good = feature_counts(rows, piece_bytes).filter((F.col("df") >= least_df) & ((F.col("df_toxic") + base) / (F.col("df") + 1) >= lift * base))
    features = sorted(r[0] for r in good.select("feature").collect())
    got = evidence(rows, features, piece_bytes).toPandas().sort_values("k", kind="stable")
    size = got["sentence"].map(len).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    flat = lambda c: np.concatenate(got[c].to_list()).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
    number, doc = flat("sentence"), np.repeat(np.arange(len(got)), size)
    key, sentence = np.unique(doc * (number.max(initial=0) + 1) + number, return_inverse=True)
    w, bias = fit(got["y"].to_numpy(float), got["plain"].to_numpy(np.int64), key // (number.max(initial=0) + 1), sentence, flat("feature"), len(features), steps, rate, ridge)
    return Model({f: float(x) for f, x in zip(features, w) if abs(x) > 1e-3}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", piece_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col, score, worst_score, worst_start, worst_end``.

    The worst sentence is given by its place in the text's UTF-8 bytes (-1 where the text has no word).  Null and
    empty texts count as one empty sentence, so that they score the bias alone.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"toxicity:{uuid.uuid4().hex}"

    def scored(batches):
        model, known = shared.value, worker_cache(name)
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                words = Words(piece.column("t"))
                if len(known) > 500_000:
                    known.clear()
                of_word = np.empty(len(words.dictionary))
                for k, w in enumerate(words.dictionary.to_pylist()):
                    z = known.get(w)
                    if z is None:
                        z = known[w] = model.of_word(w)
                    of_word[k] = z
                rows = len(words.at) - 1
                sentence, row = sentences_of(words)
                z = model.bias + np.bincount(sentence, weights=of_word[words.codes], minlength=len(row))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                clean = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows)
                base = 1 / (1 + np.exp(-model.bias))
                clean[words.counts == 0] = np.log1p(-base)
                first = np.searchsorted(sentence, np.arange(len(row) + 1))
                by = np.lexsort((-np.arange(len(row)), p, row))
                last = np.flatnonzero(np.append(row[by][1:] != row[by][:-1], True)) if len(row) else np.zeros(0, np.int64)
                worst, start, end = np.full(rows, base), np.full(rows, -1), np.full(rows, -1)
                k = by[last]
                worst[row[k]] = p[k]
                start[row[k]] = words.start[first[k]] - words.at[row[k]]
                end[row[k]] = words.end[first[k + 1] - 1] - words.at[row[k]]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), pa.array(-np.expm1(clean)), pa.array(worst), pa.array(start), pa.array(end)], ["i", "score", "worst_score", "worst_start", "worst_end"]
                )

    source = docs.select(docs[id_col].alias("i"), docs[text].alias("t"))
    kind = source.schema["i"].dataType.simpleString()
    out = source.mapInArrow(scored, f"i {kind}, score double, worst_score double, worst_start long, worst_end long")
    return out.withColumnRenamed("i", id_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 12_000, **options
) -> DataFrame:
    """Train on labelled rows (``usable``: a condition on labels; at most ``most_rows`` of them) and :func:`score` all.

    Labels without a document, null labels and labels of null texts do no harm; without any label every document
    scores the bias.  Texts of any length are read whole, bytes that are not UTF-8 as U+FFFD; repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, F.lit(True) if usable is None else usable, id_col, text, label, most_rows)
    return score(docs, model, id_col, text, **options)
