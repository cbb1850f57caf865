"""Line deduplication: an exact set-similarity join of lines, with DataFrame functions only.

A line matches an earlier one (by document id, then place) if the Jaccard similarity
of their sets of words is at least 0.8; later matches are removed. Lines without a
word stay.

1. Words are ordered by rarity. Rarity is estimated by a sketch of fixed size (a row
   of ``BUCKETS`` counters); any order gives the same result, a good one is fast.
2. Lines with equal sets are one class, held by its first line.
3. Near copies first: a class is held against the first and the one before of those that
   have two of its rarest words too, in parts of bounded size, so a large group of them
   makes about as many pairs as it has lines. A class that matches one is settled and
   takes no further part as the later one of a pair. Which keys are dealt into parts is
   found in a sample; that changes the time taken, not the result.
4. The prefix filter: two sets of similarity t share one of their first
   ``n - ceil(t n) + 1`` words, which for the shorter one is among its first
   ``n - ceil(2 t n / (1 + t)) + 1``. A join on these words finds candidates; the length
   filter, the positional filter and a filter on bitmaps of the sets are conditions of
   that join.
5. Words that very many classes have in their prefix are joined apart: where such a
   word is the first that two lines share, the second is in their prefixes too if these
   are a word longer, so both words are the key. Where very many classes of one length
   share even these (alike lines), they are dealt into parts of bounded size and held
   against the first of their part and the one before; those that this doesn't settle
   are joined with all earlier ones within the same band of lengths. So a large group of
   alike lines makes about as many pairs as it has lines. Which keys go these ways is
   found in a sample of the classes; that changes the time taken, not the result.
6. Candidates are verified on the words themselves. A line stays if it is the first
   of its class and no earlier class matches.

Defined results: a null text stays null and has no lines; a row with a null id is left
as it is and removes nothing; repeated rows of a document count as one document, of
which the lines are judged once, and each row is rewritten alike; different texts of
one id are documents one after another, in an order of their own; a line repeated
within a document is a later match; an empty table gives an empty table; a text is
handled whole in one task, however long; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, release, small, table

#: The similarity as a fraction.
NUM, DEN = 4, 5
BUCKETS = 1 << 15
#: Classes with a word in their prefix, and those of one length with it in one place, from which the word is joined
#: with the next one; the share of classes in which such words are looked for; classes that a part of alike ones aims at.
MANY, ALIKE, SAMPLE, PART = 1024, 256, 8, 1 << 16
#: Classes that a part of those with two rare words in common aims at.
NEAR = 512
#: Words from which a line has bitmaps of odd and even words.
LONG = 64
_BLANK = " \t\n\x0b\x0c\r"
#: A word is a number: the rank of its counter above the high bits of its hash.
_HASH_BITS = 48
#: The place of a line is below a hash of its text, which tells texts of one id apart.
_PLACE_BITS = 32


def _split(line: Column) -> Column:
    """Words and, where blanks follow each other, empty strings. A split at one character is the fast one."""
    odd = F.lit(False)
    for blank in _BLANK.replace(" ", "").replace("\n", ""):
        odd = odd | line.contains(blank)
    return F.split(F.when(odd, F.translate(line, _BLANK, " " * len(_BLANK))).otherwise(line), " ")


def _rarity(docs: DataFrame) -> Column:
    """The rank of each counter, the least count first, above the bits of a hash, as a constant array. What comes to the
    driver is of fixed size."""
    words = docs.select(F.explode(_split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("w")).select(_counter(F.xxhash64("w")).alias("b"))
    counts = {r["b"]: r["n"] for r in words.groupBy("b").agg(F.count("*").alias("n")).collect()}
    ranks = [0] * BUCKETS
    for rank, b in enumerate(sorted(range(BUCKETS), key=lambda b: counts.get(b, 0))):
        ranks[b] = rank << _HASH_BITS
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _text_hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 33)


def _prefix_length(n: Column) -> Column:
    """``n - ceil(t n) + 1`` in whole numbers."""
    return F.floor(n * (DEN - NUM) / F.lit(DEN)).cast("int") + 1


def _bitmap(odd: bool = False) -> Column:
    """64 bits, of which each word of ``s``, or each odd one, turns one."""
    at = lambda w: w.bitwiseAND(F.lit(63)).cast("int")
    one = lambda w: F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(1)) if odd else F.lit(1).cast("long")
    return F.aggregate("s", F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one(w), at(w))))


def _classes(docs: DataFrame, ranks: Column) -> DataFrame:
    """Per distinct word set: ``doc``, ``line`` of its first line, ``n`` words, its bitmaps, and its prefix with one word more."""
    split = docs.select("doc", _text_hash().alias("of"), F.split("text", "\n", -1).alias("xs"))
    lines = split.select("doc", "of", F.posexplode("xs").alias("place", "x")).filter(F.btrim("x", F.lit(_BLANK)) != "")
    none = F.xxhash64(F.lit(""))
    line = F.shiftleft("of", _PLACE_BITS).bitwiseOR(F.col("place").cast("long")).alias("line")
    hashes = lines.select("doc", line, F.array_remove(F.array_distinct(F.transform(_split(F.col("x")), lambda w: F.xxhash64(w))), none).alias("s"))
    # never null, so that Spark sorts plain numbers
    rank = lambda h: F.coalesce(F.get(ranks, _counter(h)), F.lit(0).cast("long"))
    number = lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))
    sets = hashes.select("doc", "line", F.sort_array(F.transform("s", number)).alias("s"))
    n = F.size("s")
    keyed = sets.select(F.xxhash64("s").alias("k1"), F.hash("s").alias("k2"), "doc", "line", n.alias("n"), _bitmap().alias("m"), F.when(n > LONG, _bitmap(odd=True)).alias("m1"), F.slice("s", F.lit(1), _prefix_length(n) + 1).alias("prefix"))
    return keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line", "n", "m", "m1", "prefix")).alias("f")).select("f.*")


_FIELDS = ("doc", "line", "n", "m", "m1", "open", "at")


def _rows(classes: DataFrame, *more: str, early: bool | None = None) -> DataFrame:
    """A row for each class and word of its prefix, or of the early or the late part of it. The shorter set of a pair has
    all but a ninth (of similarity 0.8) of its words in the other, so the first that they share is early in it."""
    whole, part = _prefix_length(F.col("n")), F.floor(F.col("n") * (DEN - NUM) / F.lit(NUM + DEN)).cast("int") + 1
    start, n = (part, whole - part) if early is False else (F.lit(0), part if early else whole)
    rows = classes.select(*_FIELDS[:-1], *more, start.alias("start"), F.posexplode(F.slice("prefix", start + 1, n)).alias("at", "word"))
    return rows.withColumn("at", F.col("at") + F.col("start")).drop("start")


def _sampled(rows: DataFrame) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("doc", "line"), F.lit(SAMPLE)) == 0)


def _two_words(classes: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each class, word of its prefix that is one of ``words``, and later word: ``word`` is the key of both."""
    rows = _rows(classes, "prefix").join(words, "word")
    later = F.slice("prefix", F.col("at") + 2, F.size("prefix"))
    return rows.select(*_FIELDS, F.col("word").alias("w"), F.explode(later).alias("next")).select(*_FIELDS, F.xxhash64("w", "next").alias("word"))


def _may_match(a, b) -> Column:
    """The filters on two rows of one prefix word; ``a`` and ``b`` give their columns."""
    n = a("n") + b("n")
    length = (a("n") * DEN >= b("n") * NUM) & (b("n") * DEN >= a("n") * NUM)
    # before this word, as many may be shared as the shorter part has, from it on as many as the shorter rest
    shared = F.least(a("n") - a("at"), b("n") - b("at")) + F.least(a("at"), b("at"))
    return length & (shared * (NUM + DEN) >= n * NUM) & (_apart(a, b) * (NUM + DEN) <= n * (DEN - NUM))


def _apart(a, b) -> Column:
    """Bits that differ: each is a word that only one of the sets has. Long lines have bits for odd words and for even ones."""
    turned, odd = a("m").bitwiseXOR(b("m")), F.coalesce(a("m1").bitwiseXOR(b("m1")), F.lit(0).cast("long"))
    return F.bit_count(odd) + F.bit_count(turned.bitwiseXOR(odd))


_PAIR = ("doc_a", "line_a", "doc_b", "line_b")


def _pairs(left: DataFrame, right: DataFrame, on: list[str], longer: bool = False) -> DataFrame:
    """Pairs of classes, the later one first and ``open``, that the filters let pass, where the word is the first that they
    share. That of ``left`` is the later one or, with ``longer``, that with more words."""
    a, b = (x.select("doc", "line", "open", "m", "m1", *on, _quota().alias("q"), _room().alias("r")).alias(y) for x, y in ((left, "a"), (right, "b")))
    of = lambda x: lambda f: F.col(f"{x}.{f}")
    later = (F.col("a.doc") > F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.line") > F.col("b.line")))
    same = (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on)
    # a condition on both sides, so that these stay the same table, shuffled once
    asked = F.when(later, F.col("a.open")).otherwise(F.col("b.open"))
    # from this word on, as many words may be shared as the shorter rest has; lengths that fit follow from it
    fits = (F.col("a.r") >= F.col("b.q")) & (F.col("b.r") >= F.col("a.q"))
    apart = _apart(of("a"), of("b"))
    near = apart * (NUM + DEN) * NUM <= (F.col("a.q") + F.col("b.q")) * (DEN - NUM)
    joined = a.join(b, [*same, fits, F.col("a.q") > F.col("b.q") if longer else later, near, asked])
    pair = [F.col(f"{c[-1]}.{c[:-2]}") for c in _PAIR]
    if longer:
        pair = [F.when(later, x).otherwise(y) for x, y in zip(pair, pair[2:] + pair[:2], strict=True)]
    return joined.select(*(x.alias(c) for x, c in zip(pair, _PAIR, strict=True)), apart.alias("apart"))


def _quota() -> Column:
    """``NUM`` for each word: what the other set's ``_room`` has to reach."""
    return F.col("n") * NUM


def _room() -> Column:
    """``NUM + DEN`` for each word from ``at`` on, without the ``NUM`` for each word of the set itself."""
    return F.col("n") * DEN - F.col("at") * (NUM + DEN)


def _pairs_by_place(early: DataFrame, late: DataFrame) -> DataFrame:
    """The pairs by ``word``; late words of a prefix need no join among themselves."""
    return _pairs(early, early, ["word"]).unionByName(_pairs(late, early, ["word"], longer=True))


def _common_words(classes: DataFrame) -> DataFrame:
    """Words that many classes, or many alike ones, have in their prefix."""
    cells = _sampled(_rows(classes)).groupBy("word", "n", "at").agg(F.count("*").alias("c"))
    words = cells.groupBy("word").agg(F.sum("c").alias("c"), F.max("c").alias("alike"))
    return materialise(words.filter((F.col("c") * SAMPLE >= MANY) | (F.col("alike") * SAMPLE >= ALIKE)).select("word"), "common-words")


def _alike_keys(rows: DataFrame) -> DataFrame:
    """Keys that many classes of one length have, and the ``parts`` into which those are dealt."""
    cells = _sampled(rows).groupBy("word", "n").agg(F.count("*").alias("c"))
    keys = cells.groupBy("word").agg(F.max("c").alias("c")).filter(F.col("c") * SAMPLE >= ALIKE)
    return materialise(keys.select("word", F.ceil(F.col("c") * SAMPLE / F.lit(PART)).cast("int").alias("parts")), "alike-keys")


def _near(classes: DataFrame) -> DataFrame:
    """A row for each class and two of its rarest words (``word``), and the ``parts`` into which a key's are dealt. Up to
    two words that are only in this line may come ahead of those that it has in common with others."""
    w = [F.get("prefix", F.lit(i)) for i in range(4)]
    keys = F.array_compact(F.array(*(F.when(w[j].isNotNull(), F.xxhash64(w[i], w[j])) for i, j in ((0, 1), (0, 2), (1, 2), (2, 3)))))
    rows = classes.filter(F.col("n") >= NUM).select(*_FIELDS[:-1], F.lit(0).alias("at"), F.explode(keys).alias("word"))
    counts = _sampled(rows).groupBy("word").agg(F.count("*").alias("c")).filter(F.col("c") * SAMPLE >= NEAR)
    many = materialise(counts.select("word", F.ceil(F.col("c") * SAMPLE / F.lit(NEAR)).cast("int").alias("parts")), "near-keys")
    return rows.join(small(many), "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _stars(hot: DataFrame, *within: str) -> DataFrame:
    """Pairs of an ``open`` class with the first of its part of a key's classes (of equal ``within``) and with the one just before."""
    w = Window.partitionBy("word", *within, F.pmod(F.xxhash64("doc", "line"), F.col("parts"))).orderBy("doc", "line")
    row = F.struct(*_FIELDS)
    seen = hot.select(*_FIELDS, F.first(row).over(w).alias("c"), F.lag(row).over(w).alias("p")).filter("open and p is not null")
    hits = []
    for x in "cp":
        of = lambda f, x=x: F.col(f"{x}.{f}")
        hits.append(F.when(_may_match(F.col, of), F.struct(of("doc").alias("doc_b"), of("line").alias("line_b"), _apart(F.col, of).alias("apart"))))
    met = seen.select("doc", "line", F.explode(F.array_distinct(F.array(*hits))).alias("b")).filter("b is not null")
    return met.select(F.col("doc").alias("doc_a"), F.col("line").alias("line_a"), "b.*")


def _banded(rows: DataFrame, reach: int) -> DataFrame:
    """Each row with its band of lengths, and those up to ``reach`` from it: lengths that may match are a band apart at most."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("int")
    return rows.select(*_FIELDS, "word", F.explode(F.array(*(band + d for d in range(-reach, reach + 1)))).alias("band"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The later classes (``doc``, ``line``) of pairs whose similarity holds on the words themselves."""
    of, place = F.shiftrightunsigned("line", _PLACE_BITS), F.col("line").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(f"doc_{x}").alias("doc"), F.col(f"line_{x}").alias("line")) for x in "ab"))).alias("e")).select("e.*")
    asked = small(materialise(ends.groupBy("doc", of.alias("of")).agg(F.collect_set(place).alias("asked")), "asked-lines"), 500_000)
    split = docs.withColumn("of", _text_hash()).join(asked, ["doc", "of"]).select("doc", "of", "asked", F.split("text", "\n", -1).alias("lines"))
    lines = split.select("doc", "of", F.explode(F.transform("asked", lambda i: F.struct(i.alias("place"), F.get("lines", i).alias("x")))).alias("y"))
    line = F.shiftleft("of", _PLACE_BITS).bitwiseOR(F.col("y.place").cast("long"))
    texts = materialise(lines.select("doc", line.alias("line"), F.col("y.x").alias("x")), "line-texts")
    a, b = (texts.select(F.col("doc").alias(f"doc_{x}"), F.col("line").alias(f"line_{x}"), F.col("x").alias(f"x_{x}")) for x in "ab")
    words = lambda x: F.array_remove(F.array_distinct(_split(F.col(x))), "")

    def alike(pairs):
        both = pairs.join(a, ["doc_a", "line_a"]).join(b, ["doc_b", "line_b"])
        sets = F.array(F.struct(words("x_a").alias("a"), words("x_b").alias("b")))
        # each line is split once, not again for each use
        found = both.filter(F.exists(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) * (NUM + DEN) >= (F.size(s["a"]) + F.size(s["b"])) * NUM))
        return materialise(found.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).distinct(), "later-lines")

    # each later class with the likeliest first, then those that this doesn't settle with all others
    likeliest = pairs.groupBy("doc_a", "line_a").agg(F.min(F.struct("apart", "doc_b", "line_b")).alias("b")).select("doc_a", "line_a", "b.doc_b", "b.line_b")
    first = alike(likeliest)
    gone = small(first).withColumnsRenamed({"doc": "doc_a", "line": "line_a"})
    rest = pairs.join(gone, ["doc_a", "line_a"], "left_anti").join(likeliest, list(_PAIR), "left_anti")
    return first.unionByName(alike(rest))


def kept_lines(docs: DataFrame) -> DataFrame:
    """``docs``: ``doc``, ``text``. Per text (``doc``, ``of``, the hash of the text): ``kept``, the places (from 0) of
    the lines with words that stay."""
    spark = docs.sparkSession
    classes = materialise(_classes(docs, _rarity(docs)), "line-classes")
    release(spark)
    # near copies are settled by few pairs each; only the others are then held against all that are before them
    gone = _verified(docs, materialise(_stars(_near(classes.withColumn("open", F.lit(True)))).distinct(), "near-pairs"))
    release(spark)
    settled = small(gone).withColumn("settled", F.lit(True))
    classes = classes.join(settled, ["doc", "line"], "left").withColumn("open", F.col("settled").isNull()).drop("settled")
    common = _common_words(classes)
    few = small(common)
    pairs, alike = _pairs_by_place(*(_rows(classes, early=x).join(few, "word", "left_anti") for x in (True, False))), None
    if not common.isEmpty():
        two = materialise(_two_words(classes, few), "two-words")
        keys = _alike_keys(two)
        single = two.join(small(keys), "word", "left_anti")
        pairs = pairs.unionByName(_pairs(single, single, ["word"]))
        if not keys.isEmpty():
            alike = materialise(two.join(small(keys), "word"), "alike-rows")
            pairs = pairs.unionByName(_stars(alike, "n"))
    # written before they are made distinct, so that the joins stay small enough for Java's compiler
    gone = gone.unionByName(_verified(docs, materialise(materialise(pairs, "found").distinct(), "line-pairs")))
    release(spark)
    if alike is not None:
        # those that are not settled yet, with all earlier ones that have one of these keys
        rest = alike.join(small(gone), ["doc", "line"], "left_anti")
        more = materialise(_pairs(_banded(rest, 1), _banded(alike, 0), ["word", "band"]).distinct(), "line-pairs")
        if not more.isEmpty():
            gone = gone.unionByName(_verified(docs, more)).distinct()
        release(spark)
    stay = classes.select("doc", "line").join(gone, ["doc", "line"], "left_anti")
    of, place = F.shiftrightunsigned("line", _PLACE_BITS), F.col("line").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    return materialise(stay.groupBy("doc", of.alias("of")).agg(F.collect_list(place).alias("kept")), "kept-lines")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with later matches removed from the text; with ``counts``, also ``n_lines`` and ``n_removed``."""
    once = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and text is not null")
    kept = small(kept_lines(once), 500_000)
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    whole = docs.select(row.alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("of", _text_hash())
    rows = whole.join(kept, ["doc", "of"], "left")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # where all lines stay, the text does; else a line stays that is kept or has no words
    whole_text = F.col("doc").isNull() | F.col("text").isNull() | F.coalesce(F.size("kept") == n, F.lit(False))
    kept_places = F.coalesce("kept", F.expr("cast(array() as array<int>)"))

    def staying(lines):
        """Lines by their places, which are put in order, so the time is about in proportion to their number."""
        blank = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(_BLANK)) == "", i)), lambda i: i.isNotNull())
        return F.transform(F.array_sort(F.array_union(kept_places, blank)), lambda i: F.get(lines, i))

    # the lines are split once for a text, and looked up by place
    stay = F.get(F.transform(F.array(F.struct(F.split("text", "\n", -1).alias("lines"))), lambda x: staying(x["lines"])), F.lit(0))
    rows = rows.select("row", "text", n.alias("n"), F.when(~whole_text, stay).alias("stay"))
    changed = F.size("stay") < F.col("n")
    text = F.when(changed, F.array_join("stay", "\n")).otherwise(F.col("text"))
    out = [(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        out += [F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.when(changed, F.col("n") - F.size("stay")).otherwise(0).cast("long").alias("n_removed")]
    return rows.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
