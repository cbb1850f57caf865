"""Best-fit packing by minimum bin slack.

Documents become token ids with an end id; only longer ones are cut. How pieces
fit depends on their lengths alone, and there are at most ``capacity`` lengths. So
the plan is made from a histogram: each bin takes the largest length left and the
combination of others that fills it best (subset sums in a bitset), and is repeated
as often as its lengths allow, so that each bin kind at least halves what is left
of some length: at most ``capacity * log2(rows)`` kinds. Pieces then take their
places by their rank among those of their length.

Defined results: a null text is the empty text, one piece of the end id alone;
repeated rows are packed each for itself; a null id is kept; an empty table gives an
empty table; extra columns are ignored, whatever their names; a text is handled whole
in one task, however long. Which of several pieces of a length takes which place
is not defined.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, materialise, small, small_batches
from ._words import vocabulary

CAPACITY = 4096
END_ID = 1

PLAN = "length long, from_rank long, to_rank long, first_bin long, copies long, base long"


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids into pieces; ``part`` and ``nth`` number the pieces of a length within a task."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        vocab, end, part = vocabulary(vocabulary_path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = vocab.packed_ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, x in zip(out, (doc, k, at // 4, n, zlib.crc32(own), part, seen[n], own if with_ids else None), strict=True):
                        column.append(x)
                    seen[n] += 1
            kinds = [b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.record_batch(arrays, ["id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary")
    return out.withColumnRenamed("id", id_col) if with_ids else out.withColumnRenamed("id", id_col).drop("ids")


def _fullest(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """Copies of each length (of ``lengths``, ascending) whose sum comes closest to ``room`` from below."""
    reach, steps, goal = 1, [], 1 << room
    keep = (goal << 1) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        copies, k = min(left[n], room // n), 1
        while copies:
            k = min(k, copies)
            steps.append((reach, n, k))
            reach |= reach << n * k & keep
            copies -= k
            k *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {}
    for before, n, k in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bin kinds ``(times, {length: copies})`` that use up all of ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    lengths, kinds = sorted(left), []
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        kind = _fullest(capacity - top, lengths if left[top] else lengths[:-1], left)
        left[top] += 1
        kind[top] = kind.get(top, 0) + 1
        times = min(left[n] // k for n, k in kind.items())
        kinds.append((times, kind))
        for n, k in kind.items():
            left[n] -= times * k
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
    return kinds


def place_rows(kinds: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """The plan as rows: ranks ``from_rank..to_rank`` of a length go to the bins from ``first_bin`` on."""
    rows, used, first = [], {}, 0
    for times, kind in kinds:
        base = 0
        for n in sorted(kind, reverse=True):
            k, at = kind[n], used.get(n, 0)
            rows.append((n, at, at + times * k, first, k, base))
            used[n] = at + times * k
            base += n * k
        first += times
    return rows


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``)."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity=capacity, end_id=end_id, vocabulary_path=vocabulary_path, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most `capacity` rows come to the driver
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(place_rows(minimum_bin_slack(histogram, capacity)), PLAN)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    p, q = ranked.alias("p"), small(plan).alias("q")
    placed = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("p.rank") >= F.col("q.from_rank")) & (F.col("p.rank") < F.col("q.to_rank")))
    nth = F.col("p.rank") - F.col("q.from_rank")
    within = F.expr("(p.rank - q.from_rank) % q.copies")
    return placed.select(
        F.col(f"p.{id_col}"), F.col("p.piece"), F.col("p.start"), F.col("p.length"), F.col("p.ids_crc32"),
        (F.col("q.first_bin") + F.floor(nth / F.col("q.copies"))).cast("long").alias("sequence_id"),
        (F.col("q.base") + within * F.col("p.length")).cast("long").alias("offset"),
        *([F.col("p.ids")] if with_ids else []),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(documents(spark, sf_dir))
