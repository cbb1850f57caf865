"""Exact top-k search by BM25: an inverted index in shards, with block-max WAND in each.

1. Documents are split into words once. A shard is a run of rows of a partition, of
   bounded size; its postings by term are written to the shared folder, with the
   number of its documents that have each term. A shard is a row group of its own, so
   no reader or writer holds many at once, however large the partitions are.
2. Sums of these numbers over all shards, joined with the queries' terms, give each
   term its weight in all documents. Queries are packed into blocks of bounded size and
   written too. Neither texts nor terms of queries go through Python on the driver.
3. Blocks of queries, of which some are broadcast at a time, come once to each task,
   ahead of its shards, and each shard comes once. A shard is held against many queries
   at once. The postings of terms that few documents have are added up, a bounded
   number at a time. The others have an impact for each document and, for each run of
   documents, a maximum. A query whose k-th best score so far no bound in a group of
   runs reaches (the maxima of a query's terms and the best partial score in a run)
   passes the group over (the pivot test of WAND, for runs of documents and many
   queries at once). The best scores go on from shard to shard of a task, and with
   them the threshold; a task has many shards, so that thresholds are high and the
   tasks' results few.
4. Scores use statistics of all documents, so merging the tasks' k best gives the exact
   k best.

A query's terms count once each. Words are lower-cased runs of characters other than
white space. Scores are compared to 9 decimals, and bounds are held against the
threshold with more than that to spare, so ties are whole.

Defined results: a null text has no words; a query without words, or whose words occur
nowhere else, has no results; equal scores are ordered by id; rows with a null id are
left out, as queries and as documents; queries of one id are one query of all their
words; rows of the query's own id are left out with ``exclude_self``; repeated rows are
found each; an empty table gives an empty table; extra columns are ignored, whatever
their names; a text is handled whole in one task, and a very long one is a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, materialise, release, small_batches

K = 10
K1, B = 1.2, 0.75
#: Bounds of a shard; a document's number in it takes two bytes.
SHARD_DOCS, SHARD_WORDS = 16_384, 1_000_000
#: Queries of a block, and bytes of blocks that are broadcast at once.
BLOCK_QUERIES, BROADCAST_BYTES = 2048, 32 << 20
#: Index partitions of a task at most; fewer where that leaves each core as many tasks as TASKS.
PARTITIONS, TASKS = 16, 4
#: Documents of a run, and the share of a shard's documents from which a term has maxima.
RUN, COMMON = 64, 1 / 10
#: Queries, their scores, postings of theirs and runs that are held against each other at once.
QUERIES_AT_ONCE, SCORES_AT_ONCE, POSTINGS_AT_ONCE, RUNS_AT_ONCE = 512, 1 << 18, 1 << 20, 16
#: What bounds have to spare; scores are compared to 1e-9.
SLACK = 4e-9
#: For tables of large rows: each is a row group.
BY_ROW = {"parquet.block.row.count.limit": "1"}

INDEX = "shard long, rows long, words long, ids binary, lengths binary, terms array<string>, dfs array<int>, doc binary, tf binary"
BLOCKS = "block long, size long, ids binary, counts binary, own binary, vocabulary array<string>, weights binary"
RESULT = "query_id long, doc_id long, score double"


def words_of(text: str) -> list[bytes]:
    """In UTF-8, where splitting at white space is at U+0020 and U+0009..U+000D alone."""
    return text.lower().encode().split()


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all, as by :func:`words_of`."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts.to_pylist()], pa.string()))
    words, count = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    of = np.repeat(np.arange(len(count)), count)[real.to_numpy(zero_copy_only=False)]
    return np.bincount(of, minlength=len(count)), words.filter(real)


def _here(n: int) -> int:
    return (TaskContext.get().partitionId() << 32) + n


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + count[i] - 1``, for each i."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def build_index(docs: DataFrame) -> DataFrame:
    """``docs``: ``id``, ``text``. A row for each shard; terms have their postings one after another, by document."""

    def build(batches):
        shards, held, docs, size = 0, [], 0, 0

        def row():
            ids, lengths = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            words = pa.concat_arrays([x[2] for x in held]).dictionary_encode()
            n = len(ids)
            pairs, tf = np.unique(words.indices.to_numpy() * np.int64(n) + np.repeat(np.arange(n), lengths), return_counts=True)
            term, doc = np.divmod(pairs, n)
            df = np.bincount(term, minlength=len(words.dictionary))
            blobs = [ids.astype("<i8"), lengths.astype("<i8"), doc.astype("<u2"), tf.astype(np.min_scalar_type(tf.max(initial=0)))]
            ids, lengths, doc, tf = (pa.array([x.tobytes()], pa.binary()) for x in blobs)
            terms, dfs = (pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), x) for x in (words.dictionary, pa.array(df, pa.int32())))
            numbers = (pa.array([x], pa.int64()) for x in (_here(shards), n, size))
            return pa.record_batch([*numbers, ids, lengths, terms, dfs, doc, tf], [c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            ids, (lengths, words) = b.column("id").to_numpy(zero_copy_only=False), split(b.column("text"))
            ends = np.cumsum(lengths)
            a = start = 0
            while a < len(ids):
                e = min(a + SHARD_DOCS - docs, int(np.searchsorted(ends, start + SHARD_WORDS - size)) + 1, len(ids))
                end = int(ends[e - 1])
                held.append((ids[a:e], lengths[a:e], words.slice(start, end - start)))
                docs, size, a, start = docs + e - a, size + end - start, e, end
                if docs >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield row()
                    shards, held, docs, size = shards + 1, [], 0, 0
        if held:
            yield row()

    return docs.mapInArrow(build, INDEX)


def _weighed(queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Per query: ``id`` and ``terms``, an array of its terms that any document has and their weights."""

    def pairs(batches):
        for b in batches:
            count, words = split(b.column("text"))
            yield pa.record_batch([b.column("id").take(pa.array(np.repeat(np.arange(len(b)), count))), words], ["id", "term"])

    asked = queries.mapInArrow(pairs, "id long, term string").distinct()
    known = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    # written, so that a word of very many queries can be split in the join
    both = asked.join(materialise(known, "term-counts"), "term")
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms"))


def _packed(weighed: DataFrame) -> DataFrame:
    """Blocks of queries: terms are numbers in the block's vocabulary."""

    def pack(batches):
        n, held, size = 0, [], 0

        def row():
            ids, counts = (np.concatenate([x[k].to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1))
            terms = pa.concat_arrays([x[2] for x in held]).dictionary_encode()
            own, weights = terms.indices.to_numpy(), np.zeros(len(terms.dictionary))
            weights[own] = np.concatenate([x[3].to_numpy(zero_copy_only=False) for x in held])
            blobs = [ids.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), own.astype("<i4").tobytes(), weights.tobytes()]
            names = ["block", "size", "ids", "counts", "own", "weights", "vocabulary"]
            values = [pa.array([x], pa.int64()) for x in (_here(n), sum(map(len, blobs)) + terms.dictionary.nbytes)] + [pa.array([x], pa.binary()) for x in blobs]
            vocabulary = pa.ListArray.from_arrays(pa.array([0, len(weights)], pa.int32()), terms.dictionary)
            return pa.record_batch([*values, vocabulary], names).select([c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            while len(b):
                part, b = b.slice(0, BLOCK_QUERIES - size), b.slice(BLOCK_QUERIES - size)
                terms, weights = part.column("terms"), part.column("weights")
                held.append((part.column("id"), pc.list_value_length(terms), terms.flatten(), weights.flatten()))
                size += len(part)
                if size >= BLOCK_QUERIES:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    return weighed.select("id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights")).mapInArrow(pack, BLOCKS)


class _Asked:
    """The queries of some blocks, with one vocabulary."""

    def __init__(self, rows: list[dict], k: int):
        at = np.cumsum([0] + [len(r["vocabulary"]) for r in rows])
        terms = pa.concat_arrays([r["vocabulary"] for r in rows]).dictionary_encode()
        number = terms.indices.to_numpy()
        self.vocabulary, self.weights = terms.dictionary, np.zeros(len(terms.dictionary))
        self.weights[number] = np.concatenate([np.frombuffer(r["weights"], "<f8") for r in rows])
        # by block: ids, where the terms of each query start, terms, best scores so far (highest first) and the ids found
        self.blocks = []
        for r, a in zip(rows, at.tolist(), strict=False):
            ids = np.frombuffer(r["q_ids"], "<i8")
            starts = np.append(0, np.cumsum(np.frombuffer(r["counts"], "<i4"), dtype=np.int64))
            self.blocks.append((ids, starts, number[a + np.frombuffer(r["own"], "<i4")], np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)))


class _Shard:
    """The postings of a shard by term, with what each adds to the score of a query that asks for the term."""

    def __init__(self, row: dict, asked: _Asked, mean: float, run: int = RUN, common: float = COMMON):
        self.size, self.asked = run, asked
        self.ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        self.doc, n = np.frombuffer(row["doc"], "<u2"), len(self.ids)
        tf = np.frombuffer(row["tf"], f"<u{len(row['tf']) // max(len(self.doc), 1) or 1}")
        self.df = np.asarray(row["dfs"], np.int64)
        self.at = np.append(0, np.cumsum(self.df))
        self.here = pc.index_in(asked.vocabulary, value_set=row["terms"]).fill_null(-1).to_numpy()
        weights, known = np.zeros(len(self.df)), self.here >= 0
        weights[self.here[known]] = asked.weights[known]
        length = (K1 * (1 - B) + K1 * B / mean * lengths)[self.doc]
        length += tf
        self.impact = np.repeat(weights * (K1 + 1), self.df)
        self.impact *= tf
        self.impact /= length
        often = np.flatnonzero((self.df > max(1, n * common)) & (weights > 0))
        self.row = np.full(len(self.df), -1)
        self.row[often] = np.arange(len(often))
        self.runs = -(-n // run)
        self.dense = np.zeros((len(often), self.runs * run))
        place = _ranges(self.at[often], self.df[often])
        self.dense[np.repeat(np.arange(len(often)), self.df[often]), self.doc[place]] = self.impact[place]
        self.highest = self.dense.reshape(len(often), self.runs, run).max(axis=2)

    def search(self, exclude_self: bool) -> None:
        """Brings the best scores and the ids found up to date."""
        width = self.runs * self.size
        docs = np.append(self.ids, np.zeros(width - len(self.ids), np.int64))
        for ids, starts, own, best, found in self.asked.blocks:
            term = self.here[own]
            known = term >= 0
            of, term = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))[known], term[known]
            row, first = self.row[term], np.searchsorted(of, np.arange(len(ids) + 1))
            postings = np.append(0, np.cumsum(np.where(row < 0, self.df[term], 0)))[first]
            a = 0
            while a < len(ids):
                b = min(a + min(QUERIES_AT_ONCE, SCORES_AT_ONCE // width), int(np.searchsorted(postings, postings[a] + POSTINGS_AT_ONCE, "right")) - 1, len(ids))
                b, here = max(a + 1, b), slice(first[a], first[max(a + 1, b)])
                self._some(ids[a:b], of[here] - a, term[here], row[here], docs, best[a:b], found[a:b], exclude_self)
                a = b

    def _some(self, ids: np.ndarray, of: np.ndarray, term: np.ndarray, row: np.ndarray, docs: np.ndarray, best: np.ndarray, found: np.ndarray, exclude_self: bool) -> None:
        """For queries ``ids``: the pairs of a query's number and a term it has, with the term's row of ``dense``."""
        often = row >= 0
        has = np.zeros((len(ids), len(self.dense)))
        has[of[often], row[often]] = 1.0
        rare, df = term[~often], self.df[term[~often]]
        place = _ranges(self.at[rare], df)
        cell = np.repeat(of[~often] * np.int64(len(docs)), df)
        cell += self.doc[place]
        score = np.bincount(cell, self.impact[place], len(ids) * len(docs)).reshape(len(ids), -1).astype(np.float64, copy=False)  # without rare terms it counts in integers
        score[:, len(self.ids) :] = -np.inf
        if exclude_self:
            score[ids[:, None] == docs[None, :]] = -np.inf
        bound = score.reshape(len(ids), self.runs, self.size).max(axis=2) + has @ self.highest
        groups = range(0, self.runs, RUNS_AT_ONCE)
        # groups of high bounds first: they set the thresholds that the others don't reach
        for g in sorted(groups, key=lambda g: -bound[:, g : g + RUNS_AT_ONCE].max(axis=1).mean()):
            reach = bound[:, g : g + RUNS_AT_ONCE].max(axis=1)
            live = np.flatnonzero((reach >= best[:, -1] - SLACK) & (reach > 0))
            if len(live):
                here = slice(g * self.size, (g + RUNS_AT_ONCE) * self.size)
                total = has[live] @ self.dense[:, here]
                total += score[live, here]
                _take(best, found, live, total, docs[here])


def _take(best: np.ndarray, found: np.ndarray, live: np.ndarray, total: np.ndarray, docs: np.ndarray) -> None:
    """Brings ``best`` and ``found`` up to date with the scores of the queries ``live``, a row each."""
    k = best.shape[1]
    near = (total >= (best[live, -1] - SLACK)[:, None]) & (total > 0)
    many = np.flatnonzero(near.sum(axis=1) > 2 * k)
    if len(many):
        some = total[many]
        near[many] &= some >= np.partition(some, -k, axis=1)[:, -k, None] - SLACK
    query, doc = np.nonzero(near)
    if not len(query):
        return
    changed, at = np.unique(query, return_inverse=True)
    which = live[changed]
    of = np.append(np.repeat(np.arange(len(changed)), k), at)
    scores, ids = np.append(best[which].ravel(), total[query, doc]), np.append(found[which].ravel(), docs[doc])
    order = np.lexsort((ids, -np.round(scores, 9), of))
    count = np.bincount(of)
    top = order[((np.cumsum(count) - count)[:, None] + np.arange(k)).ravel()]
    best[which], found[which] = scores[top].reshape(-1, k), ids[top].reshape(-1, k)


def _searched(index: DataFrame, blocks: DataFrame, first: int, mean: float, k: int, exclude_self: bool) -> DataFrame:
    """The k best of each query of the ``blocks``, of which ``first`` is one, in each task."""

    def run(batches):
        blocks, asked, held = {}, None, None

        def add(row):
            nonlocal asked
            asked = asked or _Asked(list(blocks.values()), k)
            blocks.clear()
            _Shard(row, asked, mean, RUN, COMMON).search(exclude_self)

        for b in batches:
            for i in range(len(b)):
                row = {c: x.values if isinstance(x, pa.ListScalar) else x.as_py() for c, x in ((c, b.column(c)[i]) for c in b.schema.names)}
                if asked is None and row["block"] is not None:
                    blocks[row["block"]] = row
                # the task's first shard comes with a block each time, but only once itself
                if row["ids"] is not None:
                    if held:
                        add(held)
                    held = row
        if held:
            add(held)
            for ids, _, _, best, found in asked.blocks:
                hit = best.ravel() > 0
                yield pa.record_batch([pa.array(np.repeat(ids, k)[hit]), pa.array(found.ravel()[hit]), pa.array(best.ravel()[hit])], ["query_id", "doc_id", "score"])

    shards = index.drop("shard", "rows", "words")
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of a task
    pairs = shards.withColumn("opens", opens).join(F.broadcast(blocks), F.col("opens"), "left")
    own = F.col("block").isNull() | (F.col("block") == first)
    return pairs.select(*blocks.columns, *(F.when(own, F.col(c)).alias(c) for c in shards.columns)).mapInArrow(run, RESULT)


def search(queries: DataFrame, docs: DataFrame, *, k: int = K, exclude_self: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per query and result: ``query_id``, ``doc_id``, ``rank`` (from 1), ``score`` (to 6 decimals)."""
    spark = docs.sparkSession
    rows, asked = (df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null") for df in (docs, queries))
    index = materialise(build_index(rows), "index", **BY_ROW)
    n, total = index.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    weighed = materialise(_weighed(asked, index, n), "queries")
    blocks = materialise(_packed(weighed.repartition(-(-weighed.count() // BLOCK_QUERIES) or 1)), "query-blocks", **BY_ROW)
    release(spark)
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, -(-index.rdd.getNumPartitions() // PARTITIONS))
    found = spark.createDataFrame([], RESULT)
    # a number and a size for each 2,048 queries or so
    sizes, some, held = blocks.select("block", "size").orderBy("block").collect(), [], 0
    for row in [*sizes, None]:
        if some and (row is None or held + row["size"] > BROADCAST_BYTES):
            here = blocks.filter(F.col("block").isin(some)).withColumnRenamed("ids", "q_ids").drop("size")
            found = found.unionByName(materialise(_searched(index.coalesce(tasks), here, some[0], max(total / max(n, 1), 1.0), k, exclude_self), "found"))
            some, held = [], 0
        if row is not None:
            some.append(row["block"])
            held += row["size"]
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, rows=500, size=8 << 20)
    docs = documents(spark, sf_dir)
    return search(docs.filter("doc_id % 100 = 0"), docs, exclude_self=True)
