"""N-gram Jaccard self-join, exact, by size-aware heavy and light sets.

A document's set holds the hashes of its word n-grams.  Two sets with a Jaccard similarity of at least t share t of
the larger, so the rarest ``n - ceil(t n) + k`` elements of both share at least k.  Rarity counts only within a low
range of the hash space (``region``), where a set has about that share of its elements; the elements beyond follow by
hash.  Any order that all sets obey is sound, so this loses nothing, while counts need only a part of the elements.
The range is wider than a prefix, so that a passage that many texts share stays out of the prefixes.

Heavy sets scan inverted lists (k = 1: an element is a key).  Light sets enumerate subsets of two elements (k = 2),
which are more selective keys but grow with the square of a prefix; the size up to which sets are light is the one
with the least estimated cost.  Sets near the boundary do both, and so do sets that may share one element only, so
that no pair falls between.

Sets that share keys form families.  A family is cut into blocks, each block is compared in one task by scanning
inverted lists over whole sets, and only the links of a spanning forest come out, so neither a large group of copies
nor a common passage turns into all its pairs.  The sets that most keys point to (hubs) visit all blocks of their
family, so blocks of one group of copies are linked at once; afterwards two blocks meet only with the sets that hold
a key which another component in another block holds too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bounded_batches, components, first_of_keys, given_back, joined_hot, mix, ordinals, pieces_of, removed, tidy, written

#: Hubs of each family and size.
HUBS = 4
#: A share of sets from which an element counts as common, and the least number of sets in a batch to tell.
COMMON_SHARE, COMMON_LEAST = 0.005, 16


def region(percent: int) -> float:
    """The share of the hash space in which elements are counted: 1.6 times a prefix."""
    return min(1.0, max(0.2, 1.6 * (1 - percent / 100)))


def row_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text, row after row, and where rows begin.

    Words are hashed by their bytes (A-Z in lower case), so hashes agree between batches.  A text with fewer than n
    words has its whole sequence as one element; one without words has none.
    """
    words = Words(texts, lower=True)
    with np.errstate(over="ignore"):
        key = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
        word = key[words.codes]
        whole = np.minimum(words.counts, n)[words.row]  # words in each gram of the row
        starts = np.flatnonzero(np.arange(len(word)) + whole <= words.row_at[1:][words.row])
        gram = np.zeros(len(starts), np.uint64)
        for k in range(n):
            inside = k < whole[starts]
            gram = np.where(inside, mix(gram * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(starts + k, len(word) - 1)] + np.uint64(k)), gram)
    row = words.row[starts]
    by = np.lexsort((gram, row))
    row, gram = row[by], gram[by]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[keep], gram[keep]
    return gram, np.searchsorted(row, np.arange(len(words.at)))


def least_shared(size, percent: int):
    """The least overlap of a set of this size with any partner: ceil(t n)."""
    return -((-percent * size) // 100)


def signatures(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of mixed elements for each set; together they tell sets apart."""
    out = []
    for salt in (1, 0x5851F42D4C957F2D):
        total = np.zeros(len(gram) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(gram + np.uint64(salt)), out=total[1:])
            out.append((total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return tuple(out)


def row_key(docs: DataFrame, id_col: str, text: str) -> Column:
    """A 128-bit key of a row's id and text, null ids among them."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(docs[text], F.lit("")))))


def set_rows(docs: DataFrame, id_col: str, text: str, n: int, percent: int, piece_bytes: int) -> DataFrame:
    """``id, key, row, n, sid, sid2, regional, low``: the row's key, a number for it, size, signatures of the whole set
    (sets are known by both), the number of elements in the region, and the first elements by hash (those in the
    region, and as many as the longest prefix needs)."""
    share = region(percent)
    top = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    @tidy
    def made(batches):
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                gram, at = row_sets(piece.column("t"), n)
                size = np.diff(at)
                rows = np.arange(next_row, next_row + len(size))
                next_row += len(size)
                sid, sid2 = signatures(gram, at)
                owner = np.repeat(np.arange(len(size)), size)
                rank = np.arange(len(gram)) - np.repeat(at[:-1], size)
                prefix = np.where(size > 0, size - least_shared(size, percent) + 2, 0)
                inside = gram < top
                take = inside | (rank < np.repeat(prefix, size))
                count = np.zeros(len(size) + 1, np.int64)
                np.cumsum(np.bincount(owner[take], minlength=len(size)), out=count[1:])
                low = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(gram[take].view(np.int64)))
                regional = np.bincount(owner[inside], minlength=len(size))
                columns = [piece.column("i"), piece.column("key"), *[pa.array(x, pa.int64()) for x in (rows, size, sid, sid2, regional)], low]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "row", "n", "sid", "sid2", "regional", "low"])

    source = docs.select(docs[id_col].cast("long").alias("i"), row_key(docs, id_col, text).alias("key"), docs[text].alias("t"))
    return source.mapInArrow(made, "id long, key binary, row long, n long, sid long, sid2 long, regional long, low array<long>")


def common_elements(sets: DataFrame, rows: int) -> DataFrame:
    """``element, often``: elements that a share of all sets has (at most ``2 / COMMON_SHARE`` times the elements of an
    average set).  An element with that share of all has it in some batch; which elements come out only moves their
    place in the order."""

    @tidy
    def counted(batches):
        for batch in batches:
            seen, n = np.unique(batch.column("low").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            often = n >= max(COMMON_LEAST, COMMON_SHARE * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(seen[often], pa.int64()), pa.array(n[often], pa.int64())], ["element", "n"])

    found = sets.select("low").mapInArrow(counted, "element long, n long").groupBy("element").agg(F.sum("n").alias("often"))
    return found.filter(F.col("often") >= max(COMMON_LEAST, COMMON_SHARE * rows / 2))


def prefix_elements(sets: DataFrame, sizes: DataFrame, percent: int, rows: int) -> DataFrame:
    """``row, n, longest, prefix`` for ``sets(row, low)`` of ``sizes(row, n, regional)``: the elements that others have
    too within the (k = 2) prefix of each set, rarest first, with their place in the prefix and the number of sets that
    have them.  Common elements come last and are not counted in one task."""
    share = region(percent)
    element = F.col("element")
    # unsigned comparison of signed hashes: flip the sign bit
    inside = element.bitwiseXOR(F.lit(-(2**63))) < F.lit(int(share * 2**64) - 2**63) if share < 1 else F.lit(True)
    hot = F.broadcast(written(common_elements(sets, rows), "common"))
    spread = sets.select("row", F.posexplode("low").alias("place", "element")).join(hot, "element", "left")
    rare = spread.filter("often is null").select("row", "place", "element", F.count("*").over(Window.partitionBy("element")).alias("df")).filter("df > 1")
    counted = rare.union(spread.filter("often is not null").select("row", "place", "element", (F.col("often") + (1 << 40)).alias("df")))
    back = counted.select("row", inside.alias("inside"), F.struct("df", "element", "place").alias("e"))
    beyond = F.when(~F.col("inside"), F.struct(F.col("e.place").alias("place"), F.col("e.element").alias("element"), F.col("e.df").alias("df")))
    mine = back.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("inside"), F.col("e")))).alias("rare"), F.sort_array(F.collect_list(beyond)).alias("beyond"))
    # elements that no other set has come first and fill their places
    longest = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 2).cast("int")
    sized = sizes.select("row", "n", "regional", longest.alias("longest")).join(mine, "row")
    alone = F.col("regional") - F.size("rare")
    first = F.transform("rare", lambda e, k: F.struct((k + alone).cast("int").alias("place"), e["element"].alias("element"), e["df"].alias("df")))
    rest = F.transform("beyond", lambda e: F.struct(e["place"].cast("int").alias("place"), e["element"].alias("element"), e["df"].alias("df")))
    prefix = F.filter(F.concat(first, rest), lambda e: e["place"] < F.col("longest"))
    return sized.select("row", "n", F.col("longest").alias("longest"), prefix.alias("prefix")).filter(F.size("prefix") > 0)


#: Pairs of prefix elements are enumerated while they are at most so many times the elements.
MOST_PAIRS = 2


def light_bound(prefixes: DataFrame, candidates: tuple[int, ...] = (0, 8, 16, 24, 32, 48, 64, 96, 128)) -> int:
    """The size up to which enumerating pairs of prefix elements costs less than scanning the elements' lists.

    Sets of a large group of near copies share all of their prefixes, so their pairs grow with the square of a prefix;
    a bound with more than ``MOST_PAIRS`` times as many pairs as elements does not count.
    """
    p = F.size("prefix")
    pairs = p * (p - 1) / 2
    lists = F.aggregate("prefix", F.lit(0.0), lambda s, e: s + F.least(e["df"], F.lit(1000)).cast("double"))
    light = lambda b, c: F.when(F.col("n") <= b, c).otherwise(0)
    costs = [F.sum(F.when(F.col("n") <= b, 4 * pairs).otherwise(lists)).alias(f"b{b}") for b in candidates]
    costs += [F.sum(light(b, pairs - MOST_PAIRS * p)).alias(f"x{b}") for b in candidates]
    row = prefixes.agg(*costs).first()
    known = [(row[f"b{b}"] or 0.0, b) for b in candidates if (row[f"x{b}"] or 0.0) <= 0]
    return min(known)[1]


def keys_of(prefixes: DataFrame, percent: int, light: int) -> DataFrame:
    """``key, row``: inverted-list keys of heavy sets, of those near the boundary and of those that may share a single
    element with a partner; pair keys of light sets."""
    # a heavy partner has more than ``light`` elements, so a light set must have t of that
    heavy = (F.col("n") >= -(-percent * (light + 1) // 100)) | (F.col("n") * percent <= 100)
    one = prefixes.filter(heavy).select("row", F.explode(F.filter("prefix", lambda e: e["place"] < F.col("longest") - 1)).alias("e")).select(F.col("e.element").alias("key"), "row")
    elements = F.array_sort(F.transform("prefix", lambda e: e["element"]))
    two = F.flatten(F.transform(elements, lambda x, i: F.transform(F.slice(elements, i + 2, F.greatest(F.size(elements) - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    return one.union(prefixes.filter(F.col("n") <= light).select(F.explode(two).alias("key"), "row"))


def linked_within(members: list[np.ndarray], names: np.ndarray, group: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among sets, by scanning inverted lists.

    ``group`` numbers sets that are linked already; ``part`` is the block, and where two blocks meet only pairs
    between them count.  A pair counts when 100 |a & b| >= percent |a | b|.
    """
    size = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members), dtype=np.int32), size)
    element = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    del flat
    by = np.argsort(element, kind="stable")
    holder, begin = owner[by], np.concatenate([[0], np.cumsum(np.bincount(element))])
    at = np.concatenate([[0], np.cumsum(size)])
    both, out, root = len(np.unique(part)) > 1, [], group.copy()
    for a in range(len(members)):
        if both and part[a] != part[0]:
            continue  # scan from the first block only
        if (root == root[a]).all():
            continue
        mine = element[at[a] : at[a + 1]]
        lists = begin[mine + 1] - begin[mine]
        hits = holder[np.repeat(begin[mine] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())]
        shared = np.bincount(hits, minlength=len(members))
        near = (100 + percent) * shared >= percent * (size[a] + size)
        near &= root != root[a]
        if both:
            near &= part != part[a]
        for b in np.flatnonzero(near).tolist():
            if root[b] != root[a]:
                out.append((int(names[a]), int(names[b])))
                root[root == root[b]] = root[a]
    return out


def block_links(placed: DataFrame, percent: int) -> DataFrame:
    """Links within tasks: ``placed(task, part, row, known, elements)`` to ``a, b``."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")]).combine_chunks()
        names = table.column("row").to_numpy()
        once = np.ones(len(names), bool)  # copies of a row that came from several tasks
        once[1:] = names[1:] != names[:-1]
        if not once.all():
            table = table.filter(pa.array(once)).combine_chunks()
            names = names[once]
        part = table.column("part").to_numpy()
        _, known = np.unique(table.column("known").to_numpy(), return_inverse=True)
        links = []
        if len(names) > 1 and known.max() > 0:
            sets = table.column("elements").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            at = sets.offsets.to_numpy()
            flat = sets.values.to_numpy(zero_copy_only=False)
            links = linked_within([flat[x:y] for x, y in zip(at[:-1], at[1:])], names, known, part, percent)
        given_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return placed.groupBy("task").applyInArrow(compare, "a long, b long")


#: Rows with their places, about 200 bytes each in the driver, are broadcast up to so many.
MOST_WIDE = 20_000


def wanted_texts(mine: DataFrame, wanted: DataFrame, broadcast_ids: int) -> DataFrame:
    """``mine(t, key)`` with the columns of ``wanted(key, ...)``.

    What the driver holds for a broadcast is small: beyond ``MOST_WIDE`` rows only a hash of each key is broadcast, up to
    ``broadcast_ids``, so that of the texts those that are wanted are shuffled to their rows, and beyond that nothing is.
    """
    rows = wanted.count()
    if rows <= min(MOST_WIDE, broadcast_ids):
        return mine.join(F.broadcast(wanted), "key")
    if rows <= broadcast_ids:
        hashes = wanted.select(F.xxhash64("key").alias("_hash")).distinct()
        mine = mine.join(F.broadcast(hashes), F.xxhash64("key") == F.col("_hash"), "left_semi")
    return mine.join(wanted.hint("shuffle_hash"), "key")


def placed_sets(docs: DataFrame, id_col: str, text: str, n: int, piece_bytes: int, wanted: DataFrame, broadcast_ids: int) -> DataFrame:
    """``task, part, row, known, elements``: the whole sets of ``wanted(key, row, sid, sid2, known, places)``, a row for
    each of their places (task, part).  Up to ``MOST_WIDE`` texts do not move: sets are made where the texts are read."""
    wanted = written(wanted, "wanted")
    mine = docs.select(docs[text].alias("t"), row_key(docs, id_col, text).alias("key"))
    mine = wanted_texts(mine, wanted, broadcast_ids).select("row", "known", "sid", "sid2", "places", "t")

    @tidy
    def made(batches):
        seen = set()  # repeated rows: one of them for each task
        for batch in batches:
            for piece in pieces_of(batch, "t", piece_bytes):
                gram, at = row_sets(piece.column("t"), n)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gram.view(np.int64)))
                sid, sid2 = signatures(gram, at)
                own = (sid == piece.column("sid").to_numpy()) & (sid2 == piece.column("sid2").to_numpy())
                for k, row in enumerate(piece.column("row").to_pylist()):
                    own[k] &= row not in seen
                    seen.add(row)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("row", "known", "places")], sets], ["row", "known", "places", "elements"]).filter(pa.array(own))

    out = mine.mapInArrow(made, "row long, known long, places array<struct<task: long, part: long>>, elements array<long>")
    return out.select(F.explode("places").alias("p"), "row", "known", "elements").select("p.task", "p.part", "row", "known", "elements")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    n: int = 5,
    percent: int = 80,
    block: int = 4000,
    block_elements: int = 2_500_000,
    piece_bytes: int = 4 << 20,
    broadcast_ids: int = 500_000,
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``.

    Documents link when ``100 |A & B| >= percent |A | B|`` for their sets of word n-grams; ``component_id`` is the
    smallest id reachable by links.  Null texts and texts without words have empty sets and link with nothing.
    Rows without an id link like any other and get the least id among the rest, null if there is none.  Repeated rows
    are rows of their own, and rows that share an id but not a text have each its own set.  Equal sets are collapsed
    first (two 64-bit signatures).  Elements are 64-bit hashes: two different n-grams agree with a chance of about
    2**-64 a pair.  Very long texts are whole; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    return set_components(docs, id_col, text, n, percent, block, block_elements, piece_bytes, broadcast_ids).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def set_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    n: int = 5,
    percent: int = 80,
    block: int = 4000,
    block_elements: int = 2_500_000,
    piece_bytes: int = 4 << 20,
    broadcast_ids: int = 500_000,
) -> DataFrame:
    """:func:`jaccard_components` with what tells rows of one id apart: ``id, key, sid, root, n_shingles, component_id``,
    where ``key`` is of :func:`row_key`, ``sid`` knows the set, and rows of one component have one ``root`` (of a row
    without words: null)."""
    bounded_batches(docs.sparkSession)
    sets = written(set_rows(docs, id_col, text, n, percent, piece_bytes), "sets")
    small = written(sets.drop("low"), "small")
    total = small.count()
    hot_rows = max(1000, total // 2000)
    # of equal sets one goes on: the one of the smallest id
    ranked = F.struct(F.col("id").isNull().alias("z"), "id", "row", "key")
    first = small.filter("n > 0").groupBy("sid", "sid2").agg(F.min(ranked).alias("f"), F.max("n").alias("n"), F.max("regional").alias("regional"), F.count("*").alias("rows"))
    first = written(first.select("sid", "sid2", F.col("f.id").alias("first"), F.col("f.row").alias("row"), F.col("f.key").alias("key"), "n", "regional", "rows"), "first")
    if total - first.count() <= broadcast_ids:  # what goes is few: no set moves
        gone = small.select("row").join(first.select("row"), "row", "left_anti")
        heads = sets.join(F.broadcast(gone), "row", "left_anti")
    else:
        heads = sets.join(first.select("row"), "row", "left_semi")
    prefixes = written(prefix_elements(heads.select("row", "low"), first.select("row", "n", "regional"), percent, total), "prefixes")
    removed(sets)
    keys = written(keys_of(prefixes, percent, light_bound(prefixes)), "keys")
    removed(prefixes)
    star = keys.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.count("*").alias("rows")).filter("least < most").select("key", "least", "rows")
    stars = joined_hot(keys, star, ["key"], "rows", max(1000, keys.count() // 2000)).filter("row <> least")
    edges = written(stars.groupBy("row", "least").agg(F.count("*").alias("keys")), "stars")
    families = components(edges.select(F.col("row").alias("a"), F.col("least").alias("b")))
    sized = families.select(F.col("id").alias("row"), "component").join(first.select("row", "key", "sid", "sid2", "n"), "row")
    sized = written(sized.withColumn("scale", F.floor(F.log2("n")).cast("int")), "sized")
    totals = sized.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = sized.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    # at most rows / block + elements / block_elements families are larger than a block
    large = written(sums.filter((F.col("sets") > block) | (F.col("all") > block_elements)).select("component"), "large")
    # smaller families share a task with others
    tasks = max(1, totals[0] // (block // 2 or 1), totals[1] // (block_elements // 2 or 1))
    zero = F.lit(0).cast("long")
    place = lambda task: F.array(F.struct(task.alias("task"), zero.alias("part")))
    alone = sized.join(F.broadcast(large), "component", "left_anti").withColumn("places", place(F.pmod(F.xxhash64("component"), F.lit(tasks))))
    several = large.limit(1).count() > 0
    if several:
        # members by size, so that a block holds alike sizes: as many sets as its elements allow
        numbered = ordinals(sized.join(F.broadcast(large), "component", "left_semi"), ["component"], ["n", "row"], "_k", totals[0])
        fit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(block_elements) / F.pow(F.lit(2.0), F.col("scale") + 1)))).cast("long")
        parts = written(numbered.withColumn("part", F.shiftleft(F.col("scale").cast("long"), 40) + F.floor(F.col("_k") / fit)).drop("_k"), "parts")
        task = F.xxhash64("component", "part")
        # the sets that most keys point to visit all blocks of their size
        degree = edges.groupBy("least").agg(F.sum("keys").alias("degree")).withColumnRenamed("least", "row")
        hub = parts.join(degree, "row").groupBy("component", "scale", F.pmod(F.xxhash64("row"), F.lit(HUBS)).alias("turn")).agg(F.max_by("row", F.struct("degree", "row")).alias("row"))
        blocks = parts.select("component", "scale", "part").distinct()
        visits = hub.join(blocks, ["component", "scale"]).select("row", task.alias("task"))
        own = parts.select("row", task.alias("task"))
        visits = own.union(visits).distinct().groupBy("row").agg(F.collect_list(F.struct("task", zero.alias("part"))).alias("places"))
        alone = alone.select("key", "row", "sid", "sid2", "places").union(parts.join(visits, "row").select("key", "row", "sid", "sid2", "places"))
    wanted = alone.select("key", "row", "sid", "sid2", F.col("row").alias("known"), "places")
    links = written(block_links(placed_sets(docs, id_col, text, n, piece_bytes, wanted, broadcast_ids), percent), "links")
    if several:
        known = components(links).select(F.col("id").alias("row"), F.col("component").alias("known"))
        state = written(parts.join(known, "row", "left").withColumn("known", F.coalesce("known", "row")), "state")
        # sets that link share a key: only keys that different components in different blocks hold can link more
        held = written(keys.join(state.select("row", "component", "part", "known"), "row"), "held")
        live = held.groupBy("key").agg(F.min("known").alias("k0"), F.max("known").alias("k1"), F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("rows"))
        live = live.filter("k0 < k1 and p0 < p1").select("key", "rows")
        alive = written(joined_hot(held, live.withColumn("live", F.lit(True)), ["key"], "rows", max(1000, total // 2000)), "alive")
        at = alive.select("key", "component", "part").distinct()
        met = at.withColumnRenamed("part", "p").join(at.select("key", F.col("part").alias("q")), "key").filter("p < q").select("component", "p", "q").distinct()
        # blocks whose sizes are too far apart to link do not meet
        span = state.groupBy("component", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        x = span.select("component", F.col("part").alias("p"), F.col("least").alias("x0"), F.col("most").alias("x1"))
        y = span.select("component", F.col("part").alias("q"), F.col("least").alias("y0"), F.col("most").alias("y1"))
        pairs = met.join(x, ["component", "p"]).join(y, ["component", "q"]).filter(f"100 * x1 >= {percent} * y0 and 100 * y1 >= {percent} * x0")
        meet = pairs.select("component", F.xxhash64("component", "p", "q").alias("task"), F.explode(F.array("p", "q")).alias("part"))
        tasks_of = meet.groupBy("component", "part").agg(F.collect_list(F.struct("task", "part")).alias("places"))
        again = state.join(alive.select("row").distinct(), "row").join(F.broadcast(tasks_of) if tasks_of.count() <= 10_000 else tasks_of, ["component", "part"])
        across = placed_sets(docs, id_col, text, n, piece_bytes, again.select("key", "row", "sid", "sid2", "known", "places"), broadcast_ids)
        links = written(links.union(block_links(across, percent)), "across")
        for table in (state, held, alive, parts):
            removed(table)
    for table in (keys, edges, sized, large):
        removed(table)
    found = components(links).select(F.col("id").alias("row"), F.col("component").alias("root")).join(first.select("row", "first"), "row")
    least = written(found.groupBy("root").agg(F.min("first").alias("smallest"), F.count("*").alias("rows")), "smallest")
    roots = joined_hot(found.select("row", "root"), least, ["root"], "rows", hot_rows)
    named = first.join(roots, "row", "left").select("sid", "sid2", F.coalesce("root", "row").alias("root"), F.coalesce("smallest", "first").alias("component"), "rows")
    named = written(named, "named")
    removed(links)
    out = joined_hot(small.select("id", "key", "n", "sid", "sid2"), named, ["sid", "sid2"], "rows", hot_rows, "left")
    return out.select("id", "key", "sid", "root", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """One row of each component: that with the smallest (id, set, row), null ids last.  Of repeated rows of id and text
    one stays.  Null and empty texts link with nothing and stay (repeated rows once); an empty table gives no rows; all
    columns pass through, whatever their names."""
    joined = set_components(docs, id_col, text, **options)
    # a row without words is a component of its own; rows that repeat it share its key
    group = F.struct(F.coalesce("root", F.xxhash64("key")).alias("root"), F.when(F.col("root").isNull(), F.col("key")).alias("own")).alias("group")
    counted = joined.select(group, F.struct(F.col("id").isNull().alias("z"), "id", "sid", "key").alias("r"), F.col("n_shingles").alias("n"))
    counted = written(counted.groupBy("group", "n", "r").agg(F.count("*").alias("copies")), "rows")
    best = counted.groupBy("group").agg(F.min("r").alias("best"), F.sum("copies").alias("all"), F.count("*").alias("rows")).filter("all > 1").drop("all")
    # only components of several rows lose any
    several = written(joined_hot(counted, best, ["group"], "rows", 10_000), "several")
    dropped = several.filter("r <> best").select(F.col("r.key").alias("_dropped")).distinct()
    repeated = several.filter("r = best and copies > 1").select(F.col("r.key").alias("_repeated")).distinct()
    removed(counted)
    return first_of_keys(docs, row_key(docs, id_col, text), dropped, repeated, broadcast_ids)
