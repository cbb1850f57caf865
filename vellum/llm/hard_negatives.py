"""Hard-negative mining by distributed radix selection.

An anchor's positives are the rows of its label that score highest with it. Each pair of
an anchor and a positive is a window of scores, and the ``k`` best rows of other labels
in it are wanted. Scores are integers, so the k-th best is found by its digits: each task
counts its rows of a window by the highest digit of their distance from the window's
upper end, the counts are added up, and the bucket that holds the k-th best is known;
only rows in that bucket count for the next digit, until the score is exact. Then rows
above that score are gathered, and of those that equal it as many as are missing, by id.

A task needs to tell no bucket below that of its own k-th best, since the k-th best of all
isn't there: so a window costs a task ``k`` counts at most, however many rows, ties or
copies there are, and no more than ``k`` rows of equal score.

Anchors are a set of queries, held against all rows in blocks of bounded size
(:data:`BLOCK_BYTES`); a block is what is broadcast and what the driver holds, with its
windows. Vectors are written once, as integers.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows of one id are one row, the first by label and vector; a
vector that is shorter than the longest ends in zeros; an anchor without positives, and a
window without rows, give no rows; equal scores go by id; an empty table gives an empty
table; extra columns are ignored, whatever their names. Scores are exact: they are summed
as doubles where no sum can pass 2**53, else as longs, and where not even these suffice the
job ends with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a window, in percent of the positive's score.
LOWEST, HIGHEST = 30, 90
#: Bits of a digit.
DIGIT = 8
#: Anchors of a block, and bytes of their vectors.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Scores that a task works out at once.
_CELLS = 1 << 21


def integers(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label=None, scale: int = SCALE) -> DataFrame:
    """Rows that take part: ``id``, ``label`` and ``v``, whole multiples of 1/``scale``, one row an id."""
    x = F.col("v")
    scaled = F.transform("v", lambda c: F.floor(scale * c.cast("double")))
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    fit = rows.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("v"))
    fit = fit.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    one = fit.select("id", F.struct("label", scaled.alias("v")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return one.select("id", "r.label", "r.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of one matrix, short ones with zeros behind."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(column) and (ends == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _kind(largest: int, width: int):
    """The number type that holds every sum of ``width`` products exactly."""
    most = largest * largest * max(width, 1)
    if most < 1 << 53:
        return np.float64
    if most < 1 << 63:
        return np.int64
    raise ArithmeticError("scores of these vectors don't fit 64 bits")


def _scores(batches, anchors: dict):
    """Pieces of a task's rows: ids, labels and the scores with each anchor of the block (anchors x rows)."""
    kind, width = anchors["kind"], anchors["vectors"].shape[1]
    step = max(1, _CELLS // max(1, len(anchors["ids"])))
    for b in batches:
        ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
        vectors = _matrix(b.column("v"), width).astype(kind)
        for i in range(0, len(ids), step):
            yield ids[i : i + step], labels[i : i + step], (anchors["vectors"] @ vectors[i : i + step].T).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, in order."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _positives(vectors: DataFrame, anchors, k: int) -> DataFrame:
    """Per anchor its ``k`` best other rows of the same label: each task's best, then the best of these."""

    def run(batches):
        block = anchors.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block["ids"]]
        for ids, labels, scores in _scores(batches, block):
            for a, (anchor, label) in enumerate(zip(block["ids"], block["labels"], strict=True)):
                at = np.flatnonzero((labels == label) & (ids != anchor))
                if len(at):
                    s, i = np.concatenate((best[a][0], scores[a, at])), np.concatenate((best[a][1], ids[at]))
                    top = _first(s, i, k)
                    best[a] = s[top], i[top]
        out = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ([np.full(len(s), a) for (s, _), a in zip(best, block["ids"], strict=True)], [i for _, i in best], [s for s, _ in best])]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "positive_score"])

    found = vectors.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


class Windows:
    """Windows of a block of anchors, and how far the search for their k-th best has come.

    ``depth`` is a score's distance from the window's upper end; ``prefix`` are the digits of
    the k-th best's depth that are known, ``need`` how many rows are still to come from that
    bucket. A window with too few rows is ``whole``.
    """

    def __init__(self, pairs: list[tuple[int, int, int]], place: dict[int, int], k: int, lowest: int, highest: int):
        self.anchor, self.positive, self.score = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(3))
        self.at = np.array([place[a] for a in self.anchor.tolist()], dtype=np.int64)
        self.low = np.array([-(-lowest * p[2] // 100) for p in pairs], dtype=np.int64)
        self.high = np.array([highest * p[2] // 100 for p in pairs], dtype=np.int64)
        self.prefix, self.need = np.zeros(len(pairs), np.int64), np.full(len(pairs), k, np.int64)
        self.whole = np.zeros(len(pairs), bool)
        deepest = int((self.high - self.low).max()) if len(pairs) else 0
        self.digits = max(1, -(-max(deepest, 1).bit_length() // DIGIT))

    def open(self) -> np.ndarray:
        return np.flatnonzero(~self.whole & (self.low <= self.high))

    def narrow(self, counts: dict[int, list[tuple[int, int]]]) -> None:
        """Take the next digit; ``counts``: per window, buckets with the number of rows in them."""
        for w in self.open().tolist():
            left = int(self.need[w])
            for bucket, n in sorted(counts.get(w, ())):
                if n >= left:
                    self.prefix[w], self.need[w] = self.prefix[w] << DIGIT | bucket, left
                    break
                left -= n
            else:
                self.whole[w] = True


def _by_anchor(windows: Windows, which: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for w in which.tolist():
        out.setdefault(int(windows.at[w]), []).append(w)
    return out


def _rows_of_windows(batches, block: dict, windows: Windows, which: np.ndarray):
    """Per piece of rows and window: the window, ids, scores and depths of the rows of other labels in it."""
    groups = _by_anchor(windows, which)
    for ids, labels, scores in _scores(batches, block):
        for a, mine in groups.items():
            other = labels != block["labels"][a]
            for w in mine:
                at = np.flatnonzero(other & (scores[a] >= windows.low[w]) & (scores[a] <= windows.high[w]))
                if len(at):
                    yield w, ids[at], scores[a, at], windows.high[w] - scores[a, at]


def _counts(vectors: DataFrame, anchors, windows, shift: int, k: int) -> DataFrame:
    """Rows by window and digit: ``w``, ``bucket``, ``n``."""

    def run(batches):
        found = windows.value
        counts: dict[int, np.ndarray] = {}
        for w, _, _, depth in _rows_of_windows(batches, anchors.value, found, found.open()):
            depth = depth[depth >> (shift + DIGIT) == found.prefix[w]]
            if len(depth):
                n = np.bincount(depth >> shift & ((1 << DIGIT) - 1), minlength=1 << DIGIT)
                counts[w] = counts[w] + n if w in counts else n
        out = []
        for w, n in counts.items():
            # below its own k-th best no bucket of a task matters
            before = np.cumsum(n) - n
            out += [(w, b, int(n[b])) for b in np.flatnonzero((n > 0) & (before < found.need[w])).tolist()]
        yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["w", "bucket", "n"])

    sums = vectors.mapInArrow(run, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
    # no bucket counts that comes after `k` rows, so the driver gets `k` of a window at most
    before = F.sum("n").over(Window.partitionBy("w").orderBy("bucket")) - F.col("n")
    return sums.withColumn("before", before).filter(F.col("before") < k).select("w", "bucket", "n")


def _gather(vectors: DataFrame, anchors, windows) -> DataFrame:
    """The rows at or above the k-th best of each window; of equal ones, each task's first by id."""

    def run(batches):
        found = windows.value
        ties: dict[int, np.ndarray] = {}
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

        def batch(w, ids, scores):
            same = [np.full(len(ids), x[w]) for x in (found.anchor, found.positive, found.score)]
            return pa.record_batch([pa.array(x, pa.int64()) for x in (same[0], same[1], ids, same[2], scores)], names)

        for w, ids, scores, depth in _rows_of_windows(batches, anchors.value, found, np.flatnonzero(found.low <= found.high)):
            above = np.ones(len(ids), bool) if found.whole[w] else depth < found.prefix[w]
            if above.any():
                yield batch(w, ids[above], scores[above])
            equal = ids[~above & (depth == found.prefix[w])]
            if len(equal):
                ties[w] = np.sort(np.concatenate((ties[w], equal) if w in ties else (equal,)))[: found.need[w]]
        for w, ids in ties.items():
            yield batch(w, ids, np.full(len(ids), found.high[w] - found.prefix[w]))

    return vectors.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")


def mine(rows: DataFrame, *, anchors=None, label=None, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE, block: int | None = None) -> DataFrame:
    """Per anchor and positive the ``negatives`` best rows of other labels whose score is from ``lowest`` to ``highest``
    percent of the positive's: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``anchors`` is a condition on ``id`` (every hundredth where none is given), ``label`` a column of ``rows`` or an
    expression over them.
    """
    spark = rows.sparkSession
    vectors = materialise(integers(rows, id_col=id_col, vector_col=vector_col, label=label, scale=scale), "vectors")
    size = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    width, kind = size[0] or 0, _kind(size[1] or 0, size[0] or 0)
    chosen = vectors.filter(F.col("id") % 100 == 0 if anchors is None else anchors)
    many = block or max(1, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1))))
    blocks = -(-chosen.count() // many)
    # blocks by hash are about as large as each other; a block is read when it is its turn
    dealt = materialise(chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))), "anchors")
    found = []
    for n in range(blocks):
        held = dealt.filter(F.col("block") == n).toArrow()
        if not held.num_rows:
            continue
        ids = held.column("id").to_numpy()
        them = spark.sparkContext.broadcast({"ids": ids, "labels": held.column("label").to_numpy(), "vectors": _matrix(held.column("v").combine_chunks(), width).astype(kind), "kind": kind})
        pairs = [tuple(r) for r in _positives(vectors, them, positives).collect()]
        windows = Windows(pairs, {int(a): i for i, a in enumerate(ids)}, negatives, lowest, highest)
        for digit in reversed(range(windows.digits)):
            counts: dict[int, list[tuple[int, int]]] = {}
            for w, bucket, rows_in in _counts(vectors, them, spark.sparkContext.broadcast(windows), digit * DIGIT, negatives).collect():
                counts.setdefault(w, []).append((bucket, rows_in))
            windows.narrow(counts)
        found.append(materialise(_gather(vectors, them, spark.sparkContext.broadcast(windows)), "negatives"))
    if not found:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    else:
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10"""
