"""SimHash near-duplicates, with pigeonring filtering of candidates.

A fingerprint has four segments of 16 bits in a ring. If two fingerprints differ in
at most 3 bits, then from some segment on, each chain of 1, 2, 3, 4 segments differs
in at most 0, 1, 2, 3 bits (the budget in proportion, rounded down). The first two
demands are met by a join: keys are a segment's place, its bits and the next one's
bits, and one side also asks for each of the next one's 16 neighbours. The longer
chains are checked in the join, then the whole distance.

Equal fingerprints are one node, so copies make no pairs. Groups are connected
components, by grouped minima; nothing is gathered by group or on the driver.

Defined results: a null or empty text, or one without words, has fingerprint zero
and links like any other; repeated rows each give a row; a row with a null id links
like any other and comes after all ids; an empty table gives an empty table; extra
columns are ignored, whatever their names. A text is handled whole in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, row_key, small_batches
from ._components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
SEGMENTS, BITS = 4, 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Hashes whose bits are counted at once.
_BLOCK = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = _WORDS.findall(text.encode().translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fp``, the fingerprint as a signed number. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def links(nodes: DataFrame) -> DataFrame:
    """``nodes``: distinct ``fp`` with ``node``. Pairs ``a``, ``b`` of nodes whose fingerprints differ in at most 3 bits."""
    full = (1 << BITS) - 1

    def segment(i: int):
        return F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND(F.lit(full))

    def key(i, first, second):
        return F.shiftleft(i, 2 * BITS).bitwiseOR(F.shiftleft(first, BITS)).bitwiseOR(second)

    ring = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), segment(i).alias("s"), segment(i + 1).alias("t")) for i in range(SEGMENTS))))
    rows = nodes.select("node", "fp", ring.alias("x"))
    near = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(BITS))))
    index = rows.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("x.i").alias("i"), key(F.col("x.i"), F.col("x.s"), F.col("x.t")).alias("key"))
    asked = rows.select("node", "fp", "x", near.alias("d"))
    asked = asked.select(F.col("node").alias("b"), F.col("fp").alias("fb"), key(F.col("x.i"), F.col("x.s"), F.col("x.t").bitwiseXOR(F.col("d"))).alias("key"))

    differ = F.col("fa").bitwiseXOR(F.col("fb"))

    def chain(n: int):
        """Bits that differ in ``n`` segments of the ring from segment ``i`` on."""
        mask = (1 << BITS * n) - 1
        turned = F.expr(f"shiftrightunsigned(fa ^ fb, int({BITS} * i)) | shiftleft(fa ^ fb, int(64 - {BITS} * i))")
        return F.bit_count(turned.bitwiseAND(F.lit(mask)))

    # the first chain that fits may start at more than one segment; distinct() drops what is found again
    fits = (F.col("fa") < F.col("fb")) & (chain(3) <= 3 * DISTANCE // SEGMENTS) & (F.bit_count(differ) <= DISTANCE)
    # each node is many rows here, which Spark's estimate of sizes doesn't know: neither side may be broadcast
    return index.hint("merge").join(asked.hint("merge"), "key").filter(fits).select("a", "b").distinct()


def _firsts(prints: DataFrame, first: str) -> DataFrame:
    """``prints``: ``fp`` and the column ``first``. Per ``fp`` its ``first``: the least one that links lead to."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(first).alias("own")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    named = materialise(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("own").alias("first"))
    return named.join(least, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id that links lead to (null if all are null)."""
    prints = materialise(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "node"), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_firsts(prints, "node"), "fp").select(F.col("node").alias(id_col), hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the least id, null after all others; of equal ids one."""
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    prints = materialise(fingerprints(keyed.select(order.alias("order"), "text"), id_col="order", text_col="text"), "fingerprints")
    least = _firsts(prints, "order").select(F.col("first.key").alias("key")).distinct()
    return keyed.join(least, "key", "left_semi").dropDuplicates(["key"]).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(documents(spark, sf_dir))
