"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand in a row.  The first reads character classes and emits the bounds of pretokens;
its states are few, so each chunk of the text is a map from entry state to exit state, all chunks run side by side,
and a parallel prefix scan composes the maps to give every chunk its true entry state.  The second reads a
pretoken's bytes and carries on each transition the change in the number of emitted tokens.  Its states hold what
the future can depend on: the longest suffix that a vocabulary token starts with, and, for each place from where a
token may still reach on, the last token before that place and its relative count.  States and transitions are made when first reached
(the full automaton is far larger than what texts visit) and forgotten when they outgrow a bound.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, pieces_of, readable, row_sums, worker_cache

# classes of characters for the splitting pattern
STMD, R, V, L, E, LETTER, NUMBER, APOSTROPHE, OTHER, SPACE, WHITE, END = range(12)
# states: what has been read of the current pretoken
START, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, WHOLE, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(13)
STATES, CLASSES = 13, 12


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions (bit 0: a pretoken begins here; bit 1: one began at the character before).

    The pattern: contractions ('s 't 're 've 'm 'll 'd), an optional space with a run of letters, of numbers or of
    other characters, white space that leaves its last character to the word that follows, or any white space.
    """
    letters = (STMD, R, V, L, E, LETTER)
    step, emit = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    fresh = {**{c: LETTERS for c in letters}, NUMBER: NUMBERS, APOSTROPHE: QUOTE, OTHER: OTHERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, END: START}
    for state in range(STATES):
        for c in range(CLASSES):
            step[state, c], emit[state, c] = fresh[c], c != END
    for state, classes in ((LETTERS, letters), (NUMBERS, (NUMBER,)), (OTHERS, (OTHER, APOSTROPHE))):
        for c in classes:
            step[state, c], emit[state, c] = state, 0
    for c, to in ((STMD, WHOLE), (R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L), (OTHER, OTHERS), (APOSTROPHE, OTHERS)):
        step[QUOTE, c], emit[QUOTE, c] = to, 0
    for state, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        emit[state] |= 2  # the letter after the quote began a word after all ...
        for c in letters:
            step[state, c], emit[state, c] = LETTERS, 2
        step[state, last], emit[state, last] = WHOLE, 0  # ... unless this ends a contraction
    for c in letters:
        step[ONE_SPACE, c], emit[ONE_SPACE, c] = LETTERS, 0
    for c, to in ((NUMBER, NUMBERS), (OTHER, OTHERS), (APOSTROPHE, OTHERS)):
        step[ONE_SPACE, c], emit[ONE_SPACE, c] = to, 0
    for state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        step[state, SPACE], step[state, WHITE], emit[state, SPACE], emit[state, WHITE] = MORE_SPACE, MORE_WHITE, 0, 0
    for c in range(WHITE - 1):
        step[MORE_SPACE, c], emit[MORE_SPACE, c] = step[ONE_SPACE, c], 2
        emit[MORE_WHITE, c] = 3
    return step, emit


STEP, EMIT = splitter()


def pretoken_starts(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Places where pretokens begin, from the classes of a text's characters (END after each text)."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.int64)
    width = -(-n // chunk)
    padded = np.full(width * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(width, chunk).T).astype(np.intp) * STATES
    by_class, emitted = np.ascontiguousarray(STEP.T).ravel(), np.ascontiguousarray(EMIT.T).ravel()
    # each chunk's state map: where it ends from each state it may be entered in
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (width, 1))
    for c in columns:
        maps = by_class[c[:, None] + maps]
    # parallel prefix scan: after k rounds a map spans 2**k chunks
    gap = 1
    while gap < width:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)
        gap *= 2
    state = np.empty(width, np.uint8)
    state[0] = START
    state[1:] = maps[:-1, START]
    bits = np.empty((chunk, width), np.uint8)
    for k, c in enumerate(columns):
        at = c + state
        bits[k] = emitted[at]
        state = by_class[at]
    flat = np.ascontiguousarray(bits.T).ravel()
    begins = np.zeros(n + 1, bool)
    begins[:n] = flat[:n] & 1
    begins[: n - 1] |= (flat[1:n] & 2) > 0
    return np.flatnonzero(begins[:n] & (classes != END))


class Counter(dict):
    """The byte transducer: ``self[state << 8 | byte]`` is (next state << 8, change in the number of tokens)."""

    MOST = 400_000

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        super().__init__()
        self.vocabulary, self.merges = vocabulary, merges
        self.bytes_of = {i: t for t, i in vocabulary.items()}
        self.starts = {t[:k] for t in vocabulary for k in range(1, len(t) + 1)}
        self.fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.numbered((b"", (self.place(-1, 0, 0),)))

    @staticmethod
    def place(last: int, size: int, relative: int) -> int:
        """A place ``size`` bytes back, the token that ends there (-1 at the start), its count against the newest."""
        return (last + 1) << 28 | size << 14 | relative + 8192

    def numbered(self, state: tuple) -> int:
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
        return self.known[state]

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Merge by rank, the leftmost of equals first."""
        while len(parts) > 1:
            ranked = [self.merges.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            k = min(range(len(ranked)), key=ranked.__getitem__)
            if ranked[k] == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the tokenizer leaves these two tokens apart when they meet (at the start: ``right`` whole)."""
        got = self.fits.get(left << 20 | right)
        if got is None:
            want = [self.bytes_of[right]] if left < 0 else [self.bytes_of[left], self.bytes_of[right]]
            whole = b"".join(want)
            got = self.fits[left << 20 | right] = self.merged([whole[i : i + 1] for i in range(len(whole))]) == want
        return got

    def __missing__(self, key: int) -> tuple[int, int]:
        suffix, places = self.states[key >> 8]
        text = suffix + bytes((key & 255,))
        token, delta, still_open = None, 0, []
        for place in places:
            part = text[-(place >> 14 & 16383) - 1 :]
            if part in self.starts:
                still_open.append(place)
                if token is None and part in self.vocabulary and self.follows((place >> 28) - 1, self.vocabulary[part]):
                    token, delta = self.vocabulary[part], (place & 16383) - 8191
        if token is None:
            raise ValueError("no token ends here")
        # a byte further back, counted against the new token
        state = [place + (1 << 14) - delta for place in still_open]
        depth = state[0] >> 14 & 16383 if state else 0
        state.append(self.place(token, 0, 0))
        found = self[key] = (self.numbered((text[len(text) - depth :], tuple(state))) << 8, delta)
        return found

    def count(self, pretoken: bytes) -> int:
        if len(self) > self.MOST:
            self.forget()
        if len(self.fits) > self.MOST:
            self.fits.clear()
        state = total = 0
        for byte in pretoken:
            state, delta = self[state | byte]
            total += delta
        return total


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary_of(path: str) -> dict:
    """What the transducers need of a byte-level BPE file: tokens, merges, and special strings, as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    raw = lambda s: bytes(letter[c] for c in s)
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("only plain byte-level tokenizers compile")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {
        "tokens": {raw(t): i for t, i in spec["model"]["vocab"].items()},
        "merges": {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)},
        "special": [t["content"] for t in spec["added_tokens"]],
    }


class CharacterClasses:
    """Classes of code points, found by asking the tokenizer library's own splitter about each when first met."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = np.full(0x110000, 255, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == 255).any():
            for p in np.unique(points[found == 255]).tolist():
                self.table[p] = self.learn(chr(p))
            found = self.table[points]
        return found

    def learn(self, c: str) -> int:
        special = {"'": APOSTROPHE, " ": SPACE, "s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": R, "v": V, "l": L, "e": E}
        if c in special:
            return special[c]
        for probe, kind in (("a", LETTER), ("0", NUMBER), ("!", OTHER)):
            if len(self.split(probe + c)) == 1:
                return kind
        return WHITE


def counts_of(texts: pa.Array, vocabulary: dict, words: dict[bytes, int], counter: Counter, classes: CharacterClasses, most_words: int = 400_000) -> np.ndarray:
    """Number of tokens of each text."""
    raw, at = flat_text(readable(texts))
    whole = raw.tobytes()
    extra = np.zeros(len(at) - 1, np.int64)
    # special strings count as one token each and part the text around them
    cuts: list[tuple[int, int]] = []
    for special in vocabulary["special"]:
        mark = special.encode()
        k = whole.find(mark)
        while k >= 0:
            row = int(np.searchsorted(at, k, "right")) - 1
            if k + len(mark) <= at[row + 1]:
                cuts.append((k, k + len(mark)))
                extra[row] += 1
                k = whole.find(mark, k + len(mark))
            else:
                k = whole.find(mark, k + 1)
    points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte place of each code point
    kinds = classes.of(points)
    if cuts:
        part = np.zeros(len(raw) + 1, np.int8)
        for a, b in cuts:
            part[a] += 1
            part[b] -= 1
        kinds = np.where(np.cumsum(part[:-1])[lead] > 0, END, kinds).astype(np.uint8)
    # one END after each text
    ends = np.searchsorted(lead, at[1:])
    starts = pretoken_starts(np.insert(kinds, ends, END))
    if not len(starts):
        return extra
    starts = starts - np.searchsorted(ends + np.arange(len(ends)), starts)  # places without the inserted ENDs
    first = lead[starts]
    last = np.append(first[1:], len(raw))
    if cuts:
        special_starts = np.array([a for a, _ in sorted(cuts)])
        k = np.searchsorted(special_starts, first)
        near = np.append(special_starts, len(raw))[k]
        last = np.minimum(last, np.maximum(near, first))
    row = np.searchsorted(at, first, "right") - 1
    last = np.minimum(last, at[row + 1])
    if cuts:
        keep = np.zeros(len(raw) + 1, np.int64)
        np.add.at(keep, first, 1)
        np.add.at(keep, last, -1)
        data = raw[np.cumsum(keep[:-1]) > 0]
    else:
        data = raw
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    if len(words) > most_words:
        words.clear()
    numbers = np.empty(len(coded.dictionary), np.int64)
    for k, w in enumerate(coded.dictionary.to_pylist()):
        n = words.get(w)
        if n is None:
            n = counter.count(w)
            if len(w) <= 64:
                words[w] = n
        numbers[k] = n
    return extra + row_sums(numbers[coded.indices.to_numpy()], np.searchsorted(first, at))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", piece_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, n_tokens``; a null text counts as empty (0 tokens).

    ``tokenizer`` is the path of a byte-level BPE file; its tables (a bounded size, read on the driver) travel to the
    tasks, so that executors need no such file.  Special strings inside a text count as one token, as by the
    library's default.  Texts of any length are read whole; bytes that are not UTF-8 count as
    U+FFFD in ``n_tokens`` and as they are in ``n_bytes``.  Repeated rows and ids give repeated results; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(tokenizer))

    def counted(batches):
        own = worker_cache(f"tokens:{tokenizer}")
        if not own:
            own.update(words={}, counter=Counter(shared.value["tokens"], shared.value["merges"]), classes=CharacterClasses(), special=shared.value["special"])
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                n = counts_of(piece.column("t"), own, own["words"], own["counter"], own["classes"])
                yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array(n, pa.int64())], ["i", "n_tokens"])

    source = docs.select(docs[id_col].alias("i"), docs[text].alias("t"))
    kind = source.schema["i"].dataType.simpleString()
    # the text is measured in the same pass, so that no join brings it back
    lengths = source.select("i", "t")
    out = lengths.mapInArrow(lambda b: with_bytes(b, counted), f"i {kind}, n_tokens long, n_bytes long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens")


def with_bytes(batches, counted):
    """Add the UTF-8 length of each text to what ``counted`` gives for it."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column("t")), 0), pa.int64())
        done = pa.Table.from_batches(list(counted([batch])), schema=pa.schema([("i", batch.schema.field("i").type), ("n_tokens", pa.int64())]))
        yield from done.append_column("n_bytes", sizes).combine_chunks().to_batches()
