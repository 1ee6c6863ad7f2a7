"""Secret scans whose false positives a random forest removes (DataFrame and MLlib operations only).

Candidates are runs of key characters that have a digit or are assigned to a name.  A forest over their length,
character transitions (counted in the corpus), coverage by the corpus's frequent words, path marks and neighbouring
words, trained on labelled findings, tells secrets from numbers, addresses, paths and identifiers.

Labelled findings come from the caller, or from planting: values whose kind is known (keys, tokens and passwords;
checksums, addresses, numbers, names) are written between words of a bounded sample of documents, found again like any
other candidate, and labelled by their kind, never by what the forest sees.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_draw, written

#: Words that announce a secret, and words that announce something else.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "bearer", "credential", "credentials")
OTHER_WORDS = ("example", "sample", "test", "dummy", "commit", "checksum", "sha1", "sha256", "md5", "uuid", "isbn", "order", "phone", "card", "iban", "id", "number")
SPACES = r"[\x20\x09-\x0D]+"
KEY = r"[A-Za-z0-9+/_\-]"
#: A name with = or : behind it at the end of what stands before a run in its word, with quotes around either.
NAME = r"([A-Za-z][A-Za-z0-9_.\-]*)[\"'`]?(?:=|:)+>?[\"'`]?$"
#: What follows a name: the run is not a value.
NAMED = "^[\"'`]?(?:=|:(?!/))"
ASSIGNED = "[:=]>?[\"'`]?$"
#: How much of a word around a run is kept; words can be whole files.
LEAD, TAIL = 200, 50


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 8) -> DataFrame:
    """One row per candidate: ``id_col, word_index, place, candidate, lead, tail, before_1, before_2, after_1``.

    Candidates are all runs of at least ``least`` key characters that have a digit, or that are assigned to a name
    which announces a secret; ``place`` numbers the runs of a word from 0 (other runs count).  ``lead`` and ``tail``
    stand before and after the run in its word, bounded.  A name before = or : in the word is the neighbour
    ``before_1``.  Null and empty texts have none; whole texts are read.
    """
    words = F.split(F.coalesce(docs[text], F.lit("")), SPACES)
    run = f"{KEY}{{{least},}}"
    split = docs.select(docs[id_col].alias("_id"), words.alias("_words")).filter(F.exists("_words", lambda w: F.length(w) >= least))
    # a word meets the one before it side by side: looked up by place, the whole text would be split again for every word
    wanted = lambda w, last: (F.length(w) >= least) & (w.rlike("[0-9:=]") | last.rlike(ASSIGNED)) & w.rlike(run)
    flags = F.zip_with("_words", F.concat(F.array(F.lit("")), "_words"), wanted)
    at = F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    found = split.select("_id", "_words", F.explode(at).alias("word_index"))
    near = lambda k: F.coalesce(F.get("_words", F.col("word_index") + k), F.lit(""))
    rows = found.select(F.col("_id").alias(id_col), "word_index", near(0).alias("_word"), near(-1).alias("_1"), near(-2).alias("_2"), near(1).alias("after_1"))
    cut = rows.select(id_col, "word_index", "_1", "_2", "after_1", F.regexp_extract_all("_word", F.lit(f"({run})"), F.lit(1)).alias("_runs"), F.split("_word", run).alias("_parts"))
    runs_ = F.zip_with("_runs", F.concat(F.array(F.lit("")), "_runs"), lambda r, last: F.struct(r.alias("r"), last.alias("last")))
    sides = F.zip_with("_parts", F.slice("_parts", 2, F.size("_parts")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    each = F.zip_with(runs_, sides, lambda x, y: F.struct(x["r"].alias("candidate"), F.right(F.concat(x["last"], y["p"]), F.lit(LEAD)).alias("lead"), F.left(y["q"], F.lit(TAIL)).alias("tail")))
    kept = [id_col, "word_index", "_1", "_2", "after_1"]
    runs = cut.select(*kept, F.posexplode(each).alias("place", "_e")).select(*kept, "place", "_e.*").filter("candidate is not null")
    # the slashes of an address follow no name
    name = F.when(F.col("candidate").startswith("//"), "").otherwise(F.regexp_extract("lead", NAME, 1))
    own = F.col("_name") != ""
    before_1, before_2 = F.when(own, F.concat("_name", F.lit("="))).otherwise(F.col("_1")), F.when(own, F.col("_1")).otherwise(F.col("_2"))
    named = runs.withColumn("_name", name).select(id_col, "word_index", "place", "candidate", "lead", "tail", before_1.alias("before_1"), before_2.alias("before_2"), "after_1")
    given = F.col("before_1").rlike(ASSIGNED) & F.col("lead").rlike("(?:^|[:=>\"'`(\\[{])$") & (announces(F.col("before_1")) | announces(F.col("before_2")))
    # a run without a digit that is a name itself is no value
    return named.filter(F.col("candidate").rlike("[0-9]") | (given & ~F.col("tail").rlike(NAMED)))


def plain(c: Column) -> Column:
    """A word in lower case without marks around it."""
    return F.lower(F.regexp_replace(c, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def announces(c: Column) -> Column:
    """Whether a name is or holds a key word between marks or changes of case (AWS_SECRET_ACCESS_KEY, accessToken)."""
    parts = F.lower(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    return plain(c).isin(*KEY_WORDS) | parts.rlike("(?:^|[^a-z0-9])(?:" + "|".join(KEY_WORDS) + ")(?:$|[^a-z0-9])")


def letter_parts(c: Column) -> Column:
    """Runs of letters of a candidate in lower case, parted at changes of case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", "_")), F.lit(r"(\p{L}+)"), F.lit(1))


def pairs_of(word: Column) -> Column:
    """Neighbouring letters of a word."""
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))))


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each word of three letters or more occurs in the corpus, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(docs[text], F.lit(""))), F.lit(r"(\p{L}{3,})"), F.lit(1))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(words: DataFrame, most: int = 20_000) -> DataFrame:
    """The ``most`` most frequent words: ``part``."""
    return words.orderBy(F.desc("n"), "word").limit(most).select(F.col("word").alias("part"))


def transitions(words: DataFrame, most: int = 20_000) -> DataFrame:
    """``pair, cost``: bits of the second letter after the first, by the corpus's words (its ``most`` frequent pairs)."""
    pairs = words.select("n", F.explode(pairs_of(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    cost = -F.log2((F.col("n") + 1) / (F.col("all") + 32))
    return pairs.join(F.broadcast(first.orderBy(F.desc("all")).limit(most)), F.substring("pair", 1, 1) == F.col("first")).orderBy(F.desc("n"), "pair").limit(most).select("pair", cost.alias("cost"))


def features(found: DataFrame, known_words: DataFrame, letter_pairs: DataFrame) -> DataFrame:
    """``found`` (with a number ``row`` for each) and what the forest sees, one column each."""
    c, n = F.col("candidate"), F.length("candidate")
    chars = F.split(c, "")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda x: (n - F.length(F.replace(c, x))).cast("double") / n), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    before = [plain(F.col("before_1")), plain(F.col("before_2"))]
    # in quotes, brackets or alone behind an assignment, or assigned within the word
    assigned = F.col("before_1").rlike("[:=]$") | F.col("lead").rlike("^[\"'`]?[:=]")
    key_word = announces(F.col("before_1")) | announces(F.col("before_2"))
    key = announces(F.col("before_1")) & assigned
    segment = F.concat("lead", "candidate", "tail")
    # a value assigned to a key word is judged by itself: base64 holds slashes between letters, and its address is not it
    value = F.concat("candidate", F.regexp_extract("tail", "^[^&,;\"'`]*", 0))
    path = F.when(key, value.rlike(r"(://|@|\.[a-z]{2,4}\b|^/)")).otherwise(segment.rlike(r"(://|@|\.[a-z]{2,4}\b|^/|[A-Za-z]/[A-Za-z])"))
    out = {
        "f_length": n.cast("double"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_marks": share("[+/_\\-]"),
        "f_hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "f_grouped": flag(c.rlike("^[0-9A-Fa-f]{2,}(?:-[0-9A-Fa-f]{2,})+$")),
        "f_turns": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "f_case_turns": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "f_entropy": entropy,
        "f_path": flag(path),
        "f_key_word": flag(key_word),
        "f_other_word": flag(before[0].isin(*OTHER_WORDS) | before[1].isin(*OTHER_WORDS) | plain(F.col("after_1")).isin(*OTHER_WORDS)),
        "f_assigned": flag(assigned),
        "f_quoted": flag(F.col("lead").rlike("[\"'`][^\"'`=:,;&]*$")),
    }
    parts = found.select("row", F.explode(letter_parts(c)).alias("part"))
    covered = parts.join(F.broadcast(known_words), "part", "left_semi").groupBy("row").agg(F.sum(F.length("part")).alias("letters"))
    pairs = parts.select("row", F.explode(pairs_of(F.col("part"))).alias("pair")).join(F.broadcast(letter_pairs), "pair", "left")
    costs = pairs.groupBy("row").agg(F.avg(F.coalesce("cost", F.lit(14.0))).alias("cost"))
    more = {"f_dictionary": F.coalesce(F.col("letters"), F.lit(0)) / n, "f_transitions": F.coalesce(F.col("cost"), F.lit(0.0))}
    return found.withColumns(out).join(covered, "row", "left").join(costs, "row", "left").withColumns(more).drop("letters", "cost")


FEATURES = ["f_length", "f_digits", "f_upper", "f_marks", "f_hex", "f_grouped", "f_turns", "f_case_turns", "f_entropy", "f_dictionary", "f_transitions", "f_path", "f_key_word", "f_other_word", "f_assigned", "f_quoted"]


def numbered(found: DataFrame) -> DataFrame:
    """``found`` written once, with a number for each row."""
    return written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")


def planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 1_500) -> DataFrame:
    """``number, kind, value, label, text``: values of known kinds between words of at most ``most`` documents (drawn by
    a hash), ``label`` 1 for secrets.  Values and the words around them follow the document's hash."""
    content = F.coalesce(docs[text], F.lit(""))
    hashed = docs.select(F.sha2(F.concat_ws("|", F.coalesce(docs[id_col].cast("string"), F.lit("")), content), 256).alias("h"), content.alias("t"))
    drawn = first_by_draw(hashed, F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32), ["h"], most)
    words = F.filter(F.split("t", SPACES), lambda w: w.rlike("^[A-Za-z]{3,12}$"))
    base = drawn.select(F.monotonically_increasing_id().alias("number"), "h", words.alias("w"))
    number = lambda a: F.conv(F.substring("h", a, 6), 16, 10).cast("long")
    word = lambda a: F.coalesce(F.get("w", (number(a) % F.greatest(F.size("w"), F.lit(1))).cast("int")), F.lit("words"))
    pick = lambda values, a: F.element_at(F.array(*[F.lit(v) for v in values]), (number(a) % len(values) + 1).cast("int"))
    salted = lambda s: F.sha2(F.concat("h", F.lit(s)), 256)
    base64 = lambda s: F.regexp_replace(F.base64(F.unhex(F.concat(salted(s), salted(s + "+")))), r"[\r\n=]", "")
    letters = lambda s, n: F.substring(F.translate(base64(s), "+/", "xY"), 1, n)
    digits = lambda s, n: F.substring(F.translate(salted(s), "abcdef", "135790"), 1, n)
    dashed = lambda s: F.concat_ws("-", *[F.substring(salted(s), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    def given(names: tuple[str, ...], value: Column, a: int) -> Column:
        name, form = pick(names, a), number(a + 7) % 4
        return (
            F.when(form == 0, F.concat(name, F.lit(' = "'), value, F.lit('"')))
            .when(form == 1, F.concat(name, F.lit(": "), value))
            .when(form == 2, F.concat(F.lit('{"'), name, F.lit('":"'), value, F.lit('"}')))
            .otherwise(F.concat(name, F.lit("="), value))
        )

    secret = ("token", "secret", "password", "api_key", "access_key", "AWS_SECRET_ACCESS_KEY", "client_secret", "authToken", "key", "passwd")
    other = ("commit", "checksum", "sha256", "uuid", "order", "id", "version", "isbn", "md5", "build")
    names = F.concat_ws("_", word(3), word(9), word(15))
    site = F.concat(F.lit("https://"), F.lower(word(4)), F.lit(".example.com/"), word(10), F.lit("/"), digits("u", 8), F.lit("/"), word(16))
    values = {
        "hex key": (1.0, F.substring(salted("a"), 1, 40), lambda v: given(secret, v, 5)),
        "hex token": (1.0, F.substring(salted("b"), 1, 32), lambda v: given(secret, v, 6)),
        "base64 key": (1.0, F.substring(base64("c"), 1, 40), lambda v: given(secret, v, 7)),
        "mixed key": (1.0, letters("d", 24), lambda v: given(secret, v, 8)),
        "short password": (1.0, letters("e", 12), lambda v: given(("password", "passwd", "pwd", "secret"), v, 9)),
        "letters only": (1.0, F.translate(letters("f", 20), "0123456789", "gKtRwZpLmX"), lambda v: given(secret, v, 10)),
        "token in an address": (1.0, F.substring(salted("g"), 1, 40), lambda v: F.concat(site, F.lit("?access_token="), v)),
        "dashed key": (1.0, dashed("h"), lambda v: given(("api_key", "client_secret", "token"), v, 11)),
        "access id": (1.0, F.concat(F.lit("AKIA"), F.upper(letters("i", 16))), lambda v: F.concat(word(5), F.lit(" "), v)),
        "prefixed token": (1.0, F.concat(F.lit("ghp_"), letters("j", 36)), lambda v: F.concat(word(6), F.lit(" "), v)),
        "checksum": (0.0, salted("k"), lambda v: given(other, v, 12)),
        "commit": (0.0, F.substring(salted("l"), 1, 40), lambda v: F.concat(F.lit("commit "), v)),
        "dashed id": (0.0, dashed("m"), lambda v: given(("uuid", "id", "order", "request"), v, 13)),
        "card": (0.0, digits("n", 16), lambda v: F.concat(F.lit("card "), v)),
        "number": (0.0, digits("o", 12), lambda v: given(other, v, 14)),
        "address": (0.0, F.concat(F.lit("com/"), word(10), F.lit("/"), digits("u", 8), F.lit("/"), word(16)), lambda v: site),
        "name": (0.0, names, lambda v: given(secret, v, 15)),
        "numbered name": (0.0, F.concat(names, F.lit("_"), digits("p", 3)), lambda v: F.concat(word(7), F.lit(" "), v)),
        "date": (0.0, F.concat(F.lit("20"), digits("q", 2), F.lit("-0"), digits("r", 1), F.lit("-1"), digits("s", 1)), lambda v: v),
        "file": (0.0, F.concat(names, F.lit("/"), word(20), digits("t", 4)), lambda v: F.concat(v, F.lit(".html"))),
    }
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(label).alias("label"), F.concat_ws(" ", word(1), word(2), write(v), word(8)).alias("text")) for kind, (label, v, write) in values.items()])
    return base.select("number", F.explode(rows).alias("r")).select("number", "r.*")


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 1_500) -> DataFrame:
    """Candidates of :func:`planted` texts with ``label, kind, number``: a planted value has its kind's label, anything
    else found there is no secret."""
    texts = written(planted(docs, id_col, text, most).withColumn("key", F.concat_ws("|", F.col("number").cast("string"), "kind")), "planted")
    found = candidates(texts, "key", "text").join(texts.select("key", "value", "kind", "number", F.col("label").alias("own")), "key")
    return found.withColumn("label", F.when(F.col("candidate") == F.col("value"), F.col("own")).otherwise(0.0)).drop("own", "value")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", least: int = 8, most_training: int = 20_000, trees: int = 40, depth: int = 9, seed: int = 7) -> DataFrame:
    """One row per candidate: ``id_col, word_index, place, candidate, probability, is_secret``.

    ``labelled`` has columns of :func:`candidates` and ``label`` (0 or 1); without it :func:`labelled_findings` plants
    values of known kinds.  The forest is fitted on at most ``most_training`` labelled findings of each class, drawn by
    hash (a documented bound); the dictionary and the transitions count all documents.  If a class is missing, no
    candidate is judged a secret.  Repeated rows give repeated findings, an empty table and texts that are null, empty
    or without candidates give no rows, texts of any length are read whole, and other columns are ignored.
    """
    words = written(corpus_words(docs, text), "words")
    known_words, letter_pairs = written(dictionary(words), "dictionary"), written(transitions(words), "transitions")
    found = features(numbered(candidates(docs, id_col, text, least)), known_words, letter_pairs)
    known = labelled_findings(docs, id_col, text) if labelled is None else labelled
    known = features(numbered(known), known_words, letter_pairs).filter("label is not null").select("label", *FEATURES)
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(most_training) for k in (0.0, 1.0)]
    training = written(drawn[0].union(drawn[1]), "training")
    if training.select("label").distinct().count() < 2:
        judged = found.withColumn("probability", F.lit(0.0))
    else:
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(training)
        judged = model.transform(found).withColumn("probability", vector_to_array("probability")[1])
    return judged.select(id_col, F.col("word_index").cast("long").alias("word_index"), "place", "candidate", "probability", (F.col("probability") >= 0.5).alias("is_secret"))
