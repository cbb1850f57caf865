"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to lower-case words with one space before and after each, so that
a window of words occurs in a text exactly where its string occurs in the normalised
one. The windows of all items (:data:`WINDOW` words; a shorter item is one window) make
one automaton, and each text is read by it once. Where it stops, spaces tell the words,
and the words' places in the untouched bytes tell the characters of the original.

The automaton is built from windows that are broadcast, at most about
:data:`BLOCK_CHARS` characters of them. Items with more windows are dealt into blocks of
that size, each with an automaton and a pass of its own; what a pass finds is joined by
row, and only rows with hits are moved.

Defined results: a null or empty text, and one without word characters, has no words and
is clean; a null or empty item has no windows; items of one id are one item; an item
with a null id hits like any other and counts as one item, but is not in the list of
ids; an item of fewer words than a window is one window; repeated rows each give a row; an
empty table gives an empty table and an empty benchmark leaves all clean; extra columns
are ignored, whatever their names. A text is handled whole in one task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, row_key, small_batches, table

WINDOW = 10
#: Characters of windows in one automaton; a character costs a worker about 50 bytes.
BLOCK_CHARS = 2_000_000

_RANGES = "array<struct<first:int,last:int,start:int,end:int>>"


def _letters() -> bytes:
    """Bytes of words in lower case, all others as spaces. Bytes from 0x80 on belong to words."""
    out = bytearray(b" " * 128) + bytes(range(128, 256))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = c + 32
    return bytes(out)


_LETTERS = _letters()


def _normalised(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The normalised text, and where in ``text`` each of its bytes is (the space after a word: the word's end)."""
    spaced = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", dtype=np.uint8)
    letter = spaced != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return spaced[keep], keep


def _windows(text: bytes, window: int) -> list[bytes]:
    words = text.translate(_LETTERS).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


class Automaton:
    """Windows with the items that have them."""

    def __init__(self, windows: list[tuple[bytes, str | None]]):
        import ahocorasick

        at: dict[bytes, list] = {}
        for w, item in windows:
            at.setdefault(w, []).append(item)
        self.found, self.empty = ahocorasick.Automaton(), not at
        for w, items in at.items():
            self.found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, items))
        if at:
            self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[dict], set]:
        """Number of words; maximal ranges of hit words, with their characters; items found."""
        norm, keep = _normalised(text)
        spaces = np.flatnonzero(norm == 32)
        n = len(spaces) - 1
        if self.empty or n == 0:
            return n, [], set()
        ends, lengths, items = [], [], set()
        for end, (length, of) in self.found.iter(norm.tobytes().decode("latin-1")):
            ends.append(end)
            lengths.append(length)
            items.update(of)
        if not ends:
            return n, [], items
        after = np.searchsorted(spaces, np.array(ends))  # the first word that is not in the window
        change = np.zeros(n + 2, dtype=np.int64)
        np.add.at(change, after - np.array(lengths) + 1, 1)
        np.add.at(change, after + 1, -1)
        hit = np.concatenate(([False], np.cumsum(change[1 : n + 1]) > 0, [False]))
        first, past = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
        place = np.flatnonzero(keep) - 1  # of normalised bytes in the text
        # characters begin at bytes that don't go on with another one
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
        starts, stops = chars[place[spaces[first] + 1]], chars[place[spaces[past]]]
        ranges = zip(first.tolist(), past.tolist(), starts.tolist(), stops.tolist(), strict=True)
        return n, [dict(zip(("first", "last", "start", "end"), r, strict=True)) for r in ranges], items


#: The last automaton of this worker, by the name of its broadcast.
_built: dict[str, Automaton] = {}


def _automaton(name: str, windows) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(windows.value)
    return _built[name]


def item_windows(items: DataFrame, *, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct pairs of ``w``, a window as normalised bytes, and ``item``, the id as a string."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            out = [(w, item) for item, t in zip(b.column("item").to_pylist(), b.column("t").to_pylist(), strict=True) for w in _windows(t, window)]
            yield pa.record_batch([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["w", "item"])

    return rows.mapInArrow(run, "w binary, item string").distinct()


def _pass(docs: DataFrame, windows, *, hits_only: bool) -> DataFrame:
    """``docs``: ``id``, ``text``, perhaps ``key``. Adds ``n_words``, ``ranges`` and ``items`` by the automaton of a broadcast."""
    name, keyed = uuid.uuid4().hex, "key" in docs.columns
    lead = (f"id {dict(docs.dtypes)['id']}, " if not hits_only else "") + ("key binary, " if keyed else "")
    schema = lead + f"n_words long, ranges {_RANGES}, items array<string>, found int"
    kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")])), pa.list_(pa.string()), pa.int32()]

    def run(batches):
        automaton = _automaton(name, windows)
        for b in batches:
            found = [automaton.scan(t) for t in b.column("text").to_pylist()]
            at = [i for i, f in enumerate(found) if f[1] or not hits_only]
            b, found = b.take(pa.array(at, pa.int64())), [found[i] for i in at]
            columns = [[f[0] for f in found], [f[1] for f in found], [[i for i in f[2] if i is not None] for f in found], [len(f[2]) for f in found]]
            first = ([] if hits_only else ["id"]) + (["key"] if keyed else [])
            yield pa.record_batch([*(b.column(c) for c in first), *map(pa.array, columns, kinds)], [*first, "n_words", "ranges", "items", "found"])

    return docs.mapInArrow(run, schema)


def _union_of_ranges(ranges):
    """Ranges of several passes as maximal ones."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["last"]),
        F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(ranges), F.expr(f"cast(array() as {_RANGES})"), step)


def scan(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids), ``spans`` (characters of the
    text, end exclusive: maximal stretches of hit words) and ``contaminated``."""
    spark = docs.sparkSession
    size = block_chars or BLOCK_CHARS
    windows = materialise(item_windows(items, window=window, item_col=item_col, text_col=item_text_col), "windows")
    chars = windows.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    blocks = -(-chars // size)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def block(k: int):
        """At most about ``size`` characters come to the driver and go out again."""
        mine = windows if blocks <= 1 else windows.filter(F.pmod(F.xxhash64("w", "item"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast([(bytes(r["w"]), r["item"]) for r in mine.collect()])

    if blocks <= 1:
        out = _pass(rows, block(0), hits_only=False)
    else:
        rows = rows.withColumn("key", row_key("id", "text"))
        base, passes = _pass(rows, block(0), hits_only=False), None
        for k in range(1, blocks):
            found = _pass(rows, block(k), hits_only=True).select("key", "ranges", "items", "found")
            passes = found if passes is None else passes.unionByName(found)
        # a row and its equals find the same; of the items without an id there is one
        more = passes.distinct().groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("r"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"), F.max(F.col("found") - F.size("items")).alias("u"))
        both = base.withColumn("u", F.col("found") - F.size("items")).join(more.withColumnRenamed("u", "u2"), "key", "left")
        named = F.array_union("items", F.coalesce("i", F.expr("cast(array() as array<string>)")))
        unnamed = F.greatest("u", F.coalesce("u2", F.lit(0)))
        all_ranges = F.when(F.col("r").isNull(), F.col("ranges")).otherwise(_union_of_ranges(F.concat("ranges", F.coalesce("r", F.expr(f"cast(array() as {_RANGES})")))))
        out = both.select("id", "n_words", all_ranges.alias("ranges"), named.alias("items"), (F.size(named) + unnamed).alias("found"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + (x["last"] - x["first"]))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.col("found").cast("long").alias("n_items"), F.array_sort("items").alias("items"),
        F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"), (n_hit > 0).alias("contaminated"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_WORDS_OF = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS_OF} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_OF} AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[j:j + least(len(w), {WINDOW}) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) u(j) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM d, k, unnest(range(1, len(w) - k + 2)) u(j)),
f AS MATERIALIZED (SELECT doc_id, j, p.k, item_id FROM p JOIN g ON p.s = g.s AND p.k = g.k),
h AS (SELECT doc_id, count(DISTINCT z) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS z FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
