"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Grams are runs of ``ORDER`` characters over all code points, kept as strings.  Tasks count their own grams before the
shuffle.  The model is a set of sharded tables (an order each: a gram's discounted share, a context's weight for the
order below).  The different grams of all documents to judge are joined with these tables, order by order, which gives
a sharded table of probabilities; it grows with the corpus.

A document's perplexity needs the probabilities of its own grams.  While the table is small (``broadcast_grams``) it
passes through the driver and is broadcast to the tasks that read the texts; beyond that no part of it does, and texts
and the part of the table that a block of documents needs meet by a shuffle.  Both ways give the same numbers.
"""

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, flat_text, pieces_of, readable, removed, row_sums, tidy, worker_cache, written

ORDER = 5
#: Stands for what lies before a text (a code point that no text should hold).
EDGE = 0x10FFFF
#: An odd multiplier for hashes of grams.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a task's filter of grams that it has met already.
MET = 1 << 21


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with ``ORDER - 1`` edges before it, and where texts begin among them."""
    raw, at = flat_text(readable(texts))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    padded = np.insert(points, np.repeat(begin[:-1], ORDER - 1), np.uint32(EDGE))
    return padded, begin + (ORDER - 1) * np.arange(len(begin))


def mixed(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return code


def hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram that begins at each place."""
    n = max(len(points) - ORDER + 1, 0)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            code *= SPREAD
            code += points[k : k + n]
    return mixed(code)


def coded(grams: pa.Array) -> np.ndarray:
    """The hashes of grams given as strings (see :func:`hashes`)."""
    raw, _ = flat_text(grams)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    code = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            code = code * SPREAD + points[:, k]
    return mixed(code)


def own_places(at: np.ndarray) -> np.ndarray:
    """Which places among all grams begin a gram that lies within one text."""
    n = max(int(at[-1]) - ORDER + 1, 0)
    inside = np.ones(n, bool)
    for back in range(1, ORDER):
        cut = at[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return inside


def spelled(points: np.ndarray, places: np.ndarray) -> pa.Array:
    """The grams at these places as strings."""
    window = points[places[:, None] + np.arange(ORDER)]
    flat = window.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.ones(window.shape, np.int64) + (window >= 0x80) + (window >= 0x800) + (window >= 0x10000)
    offsets = np.zeros(len(places) + 1, np.int32)
    np.cumsum(width.sum(axis=1), out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def gram_counts(docs: DataFrame, text: str, piece_bytes: int) -> DataFrame:
    """``gram, n``: how often each gram occurs in the texts."""

    @tidy
    def counted(batches):
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                points, at = characters(piece.column("t"))
                places = np.flatnonzero(own_places(at))
                _, first, n = np.unique(hashes(points)[places], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([spelled(points, places[first]), pa.array(n, pa.int64())], ["gram", "n"])

    return docs.select(docs[text].alias("t")).mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def new_grams(texts: pa.Array, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the places of grams that this task has not met (``met`` is its filter and learns them)."""
    points, at = characters(texts)
    code = hashes(points)
    slot = code >> np.uint64(64 - 21)
    places = np.flatnonzero((met[slot] != code) & own_places(at))
    _, first = np.unique(code[places], return_index=True)
    places = places[first]
    met[slot[places]] = code[places]
    return points, places


def different_grams(docs: DataFrame, text: str, piece_bytes: int) -> DataFrame:
    """``gram``: the different grams of the texts; tasks send what they have not met before."""

    @tidy
    def listed(batches):
        met = np.zeros(MET, np.uint64)
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                yield pa.RecordBatch.from_arrays([spelled(*new_grams(piece.column("t"), met))], ["gram"])

    return docs.select(docs[text].alias("t")).mapInArrow(listed, "gram string").distinct()


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; half of the count where a class is empty."""
    n = [counts_of_counts.get(k, 0) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), found))


class Model:
    """Sharded tables of each order from 1: ``shares(gram, share)`` and ``weights(context, weight)``; ``base`` is the
    probability of any character below order 1 (one more than the trusted texts have, for all that are unknown)."""

    def __init__(self, orders: list[tuple[DataFrame, DataFrame]], base: float):
        self.orders, self.base = orders, base

    def remove(self) -> None:
        for shares, weights in self.orders:
            removed(shares)
            removed(weights)


def train(docs: DataFrame, text: str = "text", piece_bytes: int = 1 << 20) -> Model:
    """The model of all texts of ``docs``; only the numbers of grams seen one to four times reach the driver."""
    counts = written(gram_counts(docs, text, piece_bytes), "grams")
    orders, base = [], 1.0
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # lower orders count the different characters seen before a gram
            lower = written(counts.select(F.substring("gram", 2, k).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams")
            removed(counts)
            counts = lower
        few = {r[0]: r[1] for r in counts.filter("n <= 4").groupBy("n").count().collect()}
        d = discounts(few)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        # a context has at most a gram for each character of the alphabet
        marked = counts.select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), off.alias("off"))
        totals = written(marked.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("gone")), "totals")
        shares = marked.join(totals, "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("share"))
        orders.insert(0, (written(shares, "shares"), totals.select("context", (F.col("gone") / F.col("total")).alias("weight"))))
        base = 1.0 / (counts.count() + 1)
    removed(counts)
    return Model(orders, base)


def gram_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """``gram, logp`` for ``grams(gram)``, different ones: each order's table joined with the order below by the gram
    without its first character.  An unseen context leaves everything to the order below."""
    wanted = [grams.select("gram")]
    for k in range(ORDER - 1, 0, -1):
        wanted.insert(0, wanted[0].select(F.substring("gram", 2, k).alias("gram")).distinct())
    lower = None
    for k, (need, (shares, weights)) in enumerate(zip(wanted, model.orders), 1):
        rows = need.select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"))
        rows = rows.join(shares, "gram", "left").join(weights, "context", "left")
        below = F.lit(model.base)
        if lower is not None:
            rows, below = rows.join(lower, "rest"), F.col("below")
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * below
        lower = written(rows.select(F.col("gram").alias("rest"), p.alias("below")), "probabilities")
    return lower.select(F.col("rest").alias("gram"), F.log("below").alias("logp"))


class Table:
    """Log probabilities by hash, found by probing slots."""

    def __init__(self, code: np.ndarray, logp: np.ndarray):
        self.bits = max(4, int(1.3 * len(code)).bit_length())
        self.code = np.zeros(1 << self.bits, np.uint64)
        self.logp = np.zeros(1 << self.bits, np.float64)
        left, step = np.arange(len(code)), 0
        while len(left):
            slot = self.slots(code[left], step)
            free = self.code[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.code[slot[mine]], self.logp[slot[mine]] = code[left[mine]], logp[left[mine]]
            left, step = np.delete(left, mine), step + 1

    def slots(self, code: np.ndarray, step: int) -> np.ndarray:
        return ((code >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def of(self, code: np.ndarray) -> np.ndarray:
        slot = self.slots(code, 0)
        found = self.logp[slot]
        left, step = np.flatnonzero(self.code[slot] != code), 1
        while len(left):
            slot = self.slots(code[left], step)
            hit = self.code[slot] == code[left]
            found[left[hit]] = self.logp[slot[hit]]
            left, step = left[~hit], step + 1
        return found


def text_perplexity(texts: pa.Array, table: Table) -> pa.Array:
    """Perplexity per character of each text; null for those without any."""
    points, at = characters(texts)
    inside = own_places(at)
    value = np.zeros(len(points), np.float64)
    value[: len(inside)][inside] = table.of(hashes(points)[inside])
    n = np.diff(at) - (ORDER - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pa.array(np.exp(-row_sums(value, at) / n), mask=n == 0)


def spread_table(probabilities: DataFrame, most: int):
    """The table of probabilities as a broadcast and its name, None beyond ``most`` grams (16 bytes each)."""
    if probabilities.count() > most:
        return None
    rows = probabilities.toArrow()
    code = np.concatenate([coded(c) for c in rows.column("gram").chunks] or [np.zeros(0, np.uint64)])
    return probabilities.sparkSession.sparkContext.broadcast((code, rows.column("logp").to_numpy())), uuid.uuid4().hex


def perplexity(
    docs: DataFrame, probabilities: DataFrame, text: str = "text", out: str = "perplexity", piece_bytes: int = 1 << 20, broadcast_grams: int = 4_000_000, block_bytes: int = 32 << 20, ready=None
) -> DataFrame:
    """``docs`` with the perplexity per character as ``out``; null for null and empty texts.  A column of that name is
    replaced, all others pass through.  ``probabilities(gram, logp)`` has all grams of these texts; ``ready`` is what
    :func:`spread_table` gave for them."""
    docs = docs.drop(out)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    taken = docs.select(*[docs[c].alias(v) for c, v in names.items()])
    t = names[text]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields)
    named = [*[F.col(v).alias(c) for c, v in names.items()], F.col("p").alias(out)]

    def with_values(piece: pa.RecordBatch, table: Table) -> pa.RecordBatch:
        columns = [piece.column(c) for c in names.values()]
        return pa.RecordBatch.from_arrays([*columns, text_perplexity(piece.column(t), table)], [*names.values(), "p"])

    ready = ready or spread_table(probabilities, broadcast_grams)
    if ready:
        shared, key = ready

        @functools.partial(tidy, cache="kneser_ney")
        def scored(batches):
            own = worker_cache("kneser_ney")
            if key not in own:
                own.clear()
                own[key] = Table(*shared.value)
            for batch in batches:
                for piece in pieces_of(batch, t, piece_bytes):
                    yield with_values(piece, own[key])

        # whole rows go through, in batches of bounded bytes: a function of the text alone would need Python workers
        # of another kind, and those of the counts would wait beside them
        return taken.mapInArrow(scored, StructType([*taken.schema.fields, StructField("p", DoubleType())])).select(*named)

    @tidy
    def blocked(batches):
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for piece in pieces_of(batch, t, piece_bytes):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(piece.num_rows, block))], [*piece.schema.names, "block"])
                held += piece.column(t).nbytes
                if held > block_bytes:
                    block, held = block + 1, 0

    @tidy
    def needed(batches):
        last, met = -1, None
        for batch in batches:
            marks = batch.column("block").to_numpy()
            for block in np.unique(marks).tolist():
                if block != last:
                    last, met = block, np.zeros(MET, np.uint64)
                grams = spelled(*new_grams(batch.filter(pa.array(marks == block)).column("t"), met))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), grams], ["block", "gram"])

    def met_table(left: pa.Table, right: pa.Table) -> pa.Table:
        table = Table(np.concatenate([coded(c) for c in right.column("gram").chunks] or [np.zeros(0, np.uint64)]), right.column("logp").to_numpy())
        return pa.Table.from_batches([with_values(b, table) for b in left.combine_chunks().to_batches()])

    blocks = written(taken.mapInArrow(blocked, f"{kinds}, block long"), "blocks")
    need = blocks.select("block", F.col(t).alias("t")).mapInArrow(needed, "block long, gram string").distinct()
    answers = need.join(probabilities, "gram").select("block", "gram", "logp")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(met_table, f"{kinds}, p double").select(*named)


def thresholds(scores: DataFrame, lang: str, quantile: float) -> DataFrame:
    """``lang, threshold``: the quantile of perplexity by language, from counts in steps of a thousandth of its log
    (partial sums before the shuffle, no language in one task), and a row with null for all languages together."""
    steps = scores.filter("perplexity is not null").select(F.col(lang).alias("lang"), F.ceil(F.log("perplexity") * 1000).alias("step"))
    counts = steps.groupBy("lang", "step").agg(F.count("*").alias("n"))
    both = counts.withColumn("any", F.lit(False)).union(counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n", F.lit(True)))
    group = Window.partitionBy("any", "lang")
    below = F.sum("n").over(group.orderBy("step"))
    reached = both.withColumn("below", below).withColumn("all", F.sum("n").over(group)).filter(F.col("below") >= quantile * F.col("all"))
    return reached.groupBy("any", "lang").agg(F.exp(F.min("step") / 1000).alias("threshold"))


def held_back(id_column):
    """A fifth of the trusted documents, which set the limits and which the model does not learn from."""
    return F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 == 0


def quality_classifier(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = 0.995,
    names: tuple[str, str, str] = ("perplexity", "threshold", "kept"),
    broadcast_ids: int = 1_000_000,
    broadcast_grams: int = 4_000_000,
) -> DataFrame:
    """``docs`` with ``perplexity, threshold, kept`` (or other ``names``; columns of these names are replaced).

    ``trusted`` has the ids (in ``id_col``) of texts to learn from: the model is trained on four fifths of them, and a
    document is kept when its perplexity is at most its language's quantile over the other fifth (by a hash of the id).
    A language without any of these, or null, takes the quantile over all; where no text is held back, nothing is
    rejected but texts without characters.  Texts are read whole, bytes that are not UTF-8 as U+FFFD.  Null and empty texts have no perplexity and are not kept.  Repeated rows
    score alike, texts of any length are read whole, an empty table gives no rows, and other columns pass through
    whatever their names.
    """
    bounded_batches(docs.sparkSession)
    value, threshold, verdict = names
    docs = docs.drop(*names)
    columns = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[docs[c].alias(v) for c, v in columns.items()])
    ids = trusted.select(trusted[id_col].alias("own")).filter("own is not null").distinct()
    if trusted.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    own = plain.join(ids, F.col(columns[id_col]) == F.col("own"), "left_semi").filter(F.length(columns[text]) > 0)
    back = held_back(F.col(columns[id_col]))
    model = train(own.filter(~back), columns[text])
    grams = written(different_grams(plain, columns[text], 1 << 20), "wanted")
    table = gram_probabilities(grams, model)
    ready = spread_table(table, broadcast_grams)
    limits = perplexity(own.filter(back).select(F.col(columns[lang]).alias("lang"), F.col(columns[text]).alias("t")), table, "t", broadcast_grams=broadcast_grams, ready=ready)
    limits = written(thresholds(limits, "lang", quantile), "limits")
    model.remove()
    removed(grams)
    by_lang = limits.filter("not any").select(F.col("lang").alias("l"), F.col("threshold").alias("own_limit"))
    if limits.count() <= 100_000:
        by_lang = F.broadcast(by_lang)
    rest = limits.filter("any").select(F.col("threshold").alias("all_limit"))  # at most one row
    scored = perplexity(plain, table, columns[text], "p", broadcast_grams=broadcast_grams, ready=ready)
    scored = scored.join(by_lang, F.col(columns[lang]).eqNullSafe(F.col("l")), "left").join(F.broadcast(rest), F.lit(True), "left")
    limit = F.coalesce("own_limit", "all_limit")
    kept = F.col("p").isNotNull() & F.coalesce(F.col("p") <= limit, F.lit(True))
    return scored.select(*[F.col(v).alias(c) for c, v in columns.items()], F.col("p").alias(value), limit.alias(threshold), kept.alias(verdict))
