"""Lines that many documents share, dropped everywhere but in one document.

Two Bloom filters hold the hashes of lines seen once and seen twice.  Tasks fill both over their own documents and hand
on the places of bits, slice by slice; the tasks that own slices merge them (a bit that two tasks have set once is one
seen twice).  A line whose bits all stand in the second filter is suspected, and only suspected lines are shuffled, as
(document, SHA-256 of the key): their documents are counted exactly and the document that keeps the line is chosen.
Texts are never shuffled while the confirmed lines fit a checked bound; beyond it each document meets its own list.

The filters grow with the lines up to ``most_bits``.  The second filter is broadcast, so that this is a proven bound
(64 MB); where more lines would fill it, it would suspect nearly every line, and all go to the exact count, which is
partial before its shuffle, at 40 bytes a line.  The result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, bounded_batches, flat_text, free_name, partitions, pieces_of, removed, tidy, written

#: Bits of a slice of the filters, which is what one row of them holds.
SLICE = 1 << 22
PIECE = 4 << 20
HASHES = 3
BITS_A_LINE = 16


class Lines:
    """The lines of a column of texts, split at \\n: spans, rows, and which have a key of enough code points.

    Works on bytes, so that text that is not UTF-8 is no error: code points are bytes that do not continue one.
    """

    def __init__(self, column: pa.Array, least: int):
        self.raw, self.at = flat_text(column)
        raw, at = self.raw, self.at
        breaks = np.flatnonzero(raw == 10)
        row = np.searchsorted(at, breaks, side="right") - 1
        # a text begins a line, and so does what follows a break
        self.start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
        self.count = np.bincount(row, minlength=len(at) - 1).astype(np.int64) + 1
        self.row_at = np.zeros(len(at), np.int64)
        np.cumsum(self.count, out=self.row_at[1:])
        self.row = np.repeat(np.arange(len(at) - 1), self.count)
        self.end = np.empty_like(self.start)
        self.end[self.row_at[1:] - 1] = at[1:]
        inner = np.ones(len(self.start), bool)
        inner[self.row_at[1:] - 1] = False
        self.end[inner] = breaks
        filled = np.flatnonzero(~_IS_SPACE[raw])
        i, j = np.searchsorted(filled, self.start), np.searchsorted(filled, self.end)
        some = i < j
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[some], self.key_end[some] = filled[i[some]], filled[j[some] - 1] + 1
        maybe = np.flatnonzero(self.key_end - self.key_start >= least)  # bytes are as many as code points at least
        points = np.zeros(len(raw) + 1, np.int32 if len(raw) < 2**31 else np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        self.long = maybe[points[self.key_end[maybe]] - points[self.key_start[maybe]] >= least]
        capital = (raw >= 65) & (raw <= 90)
        self._lower = memoryview(np.where(capital, raw + 32, raw).astype(np.uint8)) if len(raw) else memoryview(b"")

    def digests(self, lines: np.ndarray) -> np.ndarray:
        """SHA-256 of the keys of these lines, as rows of 32 bytes."""
        sha, low = hashlib.sha256, self._lower
        each = [sha(low[a:b]).digest() for a, b in zip(self.key_start[lines].tolist(), self.key_end[lines].tolist())]
        return np.frombuffer(b"".join(each), np.uint8).reshape(-1, 32)


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each digest in a filter of ``bits`` (a power of two): a row for each digest."""
    return (np.ascontiguousarray(digests).view("<u8")[:, :HASHES] & np.uint64(bits - 1)).astype(np.int64)


def of_documents(rows: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which lines are the first with their key in their row."""
    view = np.ascontiguousarray(digests).view("<u8")
    order = np.lexsort((view[:, 3], view[:, 2], view[:, 1], view[:, 0], rows))
    first = np.ones(len(order), bool)
    first[1:] = (rows[order][1:] != rows[order][:-1]) | (view[order][1:] != view[order][:-1]).any(axis=1)
    return np.sort(order[first])


def sparse_rows(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Bits of both filters as rows ``slice, once, twice`` with the places within a slice."""
    both = [np.unique(once), np.unique(twice)]
    slices = np.unique(np.concatenate([x // SLICE for x in both]))
    columns = []
    for x in both:
        cuts = np.searchsorted(x // SLICE, np.append(slices, slices[-1] + 1 if len(slices) else 0))
        own = (x % SLICE).astype("<u4")
        columns.append(pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), *columns], ["slice", "once", "twice"])


def twice_filter(texts: DataFrame, bits: int, least: int, flush: int = 500_000) -> DataFrame:
    """``slice, bits``: the filter of lines that two documents of ``texts(_id, _text)`` have, merged slice by slice."""

    @tidy
    def own(batches):
        once, twice, held = [], [], 0
        for batch in batches:
            for piece in pieces_of(batch, "_text", PIECE):
                lines = Lines(piece.column("_text"), least)
                found = lines.digests(lines.long)
                place = places(found[of_documents(lines.row[lines.long], found)], bits)
                for column in place.T:  # a bit that two lines set counts as seen twice
                    values, n = np.unique(column, return_counts=True)
                    once.append(values)
                    twice.append(values[n > 1])
                    held += len(values)
            if held > flush:
                yield reduced(once, twice)
                once, twice, held = [], [], 0
        if held:
            yield reduced(once, twice)

    def reduced(once, twice):
        values, n = np.unique(np.concatenate(once), return_counts=True)
        return sparse_rows(values, np.concatenate([values[n > 1], *twice]))

    @tidy
    def merged(batches):
        slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, *bits_set in zip(*(c.to_pylist() for c in batch.columns)):
                first, second = slices.setdefault(s, (np.zeros(SLICE, bool), np.zeros(SLICE, bool)))
                seen, again = (np.frombuffer(b, "<u4") for b in bits_set)
                second[seen[first[seen]]] = True
                first[seen] = True
                second[again] = True
        for s, (_, second) in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(second).tobytes()], pa.binary())], ["slice", "bits"])

    parts = texts.mapInArrow(own, "slice long, once binary, twice binary")
    return parts.repartition(max(1, min(bits // SLICE, partitions(texts.sparkSession))), "slice").mapInArrow(merged, "slice long, bits binary")


def suspected(texts: DataFrame, least: int, most_bits: int) -> DataFrame:
    """``_id, key``: each document's different lines that another document may have too, by SHA-256."""
    spark = texts.sparkSession
    upto = texts.agg(F.sum(F.size(F.split("_text", "\n"))), F.sum(F.floor(F.octet_length("_text") / (least + 1)))).first()
    bits = SLICE
    while bits < BITS_A_LINE * min(upto[0] or 0, (upto[1] or 0)):
        bits *= 2
    filled = None
    if bits <= most_bits:
        table = written(twice_filter(texts, bits, least), "twice")
        whole = np.zeros(bits // 8, np.uint8)
        for s, piece in table.toLocalIterator():  # at most most_bits in all
            whole[s * SLICE // 8 : (s + 1) * SLICE // 8] = np.frombuffer(piece, np.uint8)
        removed(table)
        filled = spark.sparkContext.broadcast(whole)

    @tidy
    def found(batches):
        for batch in batches:
            for piece in pieces_of(batch, "_text", PIECE):
                lines = Lines(piece.column("_text"), least)
                keys, rows = lines.digests(lines.long), lines.row[lines.long]
                if filled is not None:
                    place = places(keys, bits)
                    open_ = np.flatnonzero(((filled.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=1))
                    keys, rows = keys[open_], rows[open_]
                first = of_documents(rows, keys)
                ids = piece.column("_id").take(pa.array(rows[first]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([k.tobytes() for k in keys[first]], pa.binary())], ["_id", "key"])

    return texts.mapInArrow(found, "_id long, key binary")


def confirmed(lines: DataFrame, least_docs: int, keep: str) -> DataFrame:
    """``key, keep_id`` of the lines that at least ``least_docs`` documents have; no id counts as a document of its own."""
    best = (F.max if keep == "largest" else F.min)(F.struct(F.col("_id").isNotNull().alias("some"), "_id"))
    docs = F.count_distinct(F.struct("_id"))
    counted = lines.groupBy("key").agg(docs.alias("docs"), best.alias("best"))
    return counted.filter(F.col("docs") >= least_docs).select("key", F.col("best._id").alias("keep_id"))


def without_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keep: str = "largest",
    names: tuple[str, str] | None = None,
    most_bits: int = 1 << 29,
    most_keys: int = 200_000,
) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and columns for the number of lines before and of those dropped.

    A line's key is the line stripped of ASCII spaces with A-Z lower-cased.  Keys of at least ``min_chars`` code points
    that at least ``min_docs`` documents have lose all their lines except in the document with the largest (or smallest)
    id holding it, which keeps all of its own.  Other lines stay as they are, joined by \\n.

    Null and empty texts are one empty line, and a null text with nothing dropped comes back empty.  Rows that share an
    id are one document, rows without an id are one document too, with the smallest id.  A document whose lines all go
    keeps an empty text.  An empty table gives no rows; other columns pass through, whatever their names; texts of any
    length are read whole, in pieces of some megabytes or one text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    least = max(1, min_chars)
    n_lines, n_dropped = names or (free_name(docs, "n_lines"), free_name(docs, "n_dropped"))
    whose, content = docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text")
    lines = written(suspected(docs.select(whose, content), least, most_bits), "suspected")
    gone = written(confirmed(lines, min_docs, keep), "shared_lines")
    # the text travels once
    own = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != text]).alias("_row"), whose, content)
    few = gone.count() <= most_keys
    if few:
        keeper = spark.sparkContext.broadcast({bytes(key): keep_id for key, keep_id in gone.toLocalIterator()})
        removed(lines)
    else:
        elsewhere = lines.join(gone, "key").filter(~F.col("_id").eqNullSafe(F.col("keep_id")))
        listed = elsewhere.groupBy(F.col("_id").alias("_whose")).agg(F.collect_set("key").alias("_gone"))
        own = own.join(listed, F.col("_id").eqNullSafe(F.col("_whose")), "left").drop("_whose")

    def lost(piece: pa.RecordBatch, lines: Lines) -> np.ndarray:
        """Which lines of a piece go."""
        out, ids = np.zeros(len(lines.start), bool), piece.column("_id").to_pylist()
        lists = None if few else [set(x or ()) for x in piece.column("_gone").to_pylist()]
        for line, row, key in zip(lines.long.tolist(), lines.row[lines.long].tolist(), lines.digests(lines.long)):
            key = key.tobytes()
            out[line] = key in lists[row] if lists else key in keeper.value and keeper.value[key] != ids[row]
        return out

    @tidy
    def kept(batches):
        for batch in batches:
            for piece in pieces_of(batch, "_text", PIECE):
                lines = Lines(piece.column("_text"), least)
                drop = lost(piece, lines)
                dropped = np.bincount(lines.row[drop], minlength=piece.num_rows).astype(np.int64)
                texts = piece.column("_text").cast(pa.binary())
                if dropped.any():
                    rest = []
                    for row in np.flatnonzero(dropped).tolist():
                        stay = np.flatnonzero(~drop[lines.row_at[row] : lines.row_at[row + 1]]) + lines.row_at[row]
                        rest.append(b"\n".join(lines.raw[a:b].tobytes() for a, b in zip(lines.start[stay].tolist(), lines.end[stay].tolist())))
                    texts = pc.replace_with_mask(texts, pa.array(dropped > 0), pa.array(rest, pa.binary()))
                columns = [piece.column("_row"), texts.view(pa.string()), pa.array(lines.count), pa.array(dropped)]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_text", "_lines", "_dropped"])

    schema = own.select("_row").schema.add("_text", "string").add("_lines", "long").add("_dropped", "long")
    done = own.mapInArrow(kept, schema)
    back = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    return done.select(*back, F.col("_lines").alias(n_lines), F.col("_dropped").alias(n_dropped))
