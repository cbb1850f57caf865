"""Token counts: exact counts at every prefix of a text, by dynamic programming over prefixes.

Defined results: a null text counts as the empty text (0 tokens); repeated rows
each give a row; a null id is kept; an empty table gives an empty table; extra columns are
ignored, whatever their names. A text's count is that of its last prefix: the sum of its
words' last prefix counts, since no token crosses from word to word. A text is handled
in one task and never cut; workers hold a bounded memo of words.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, small_batches
from ._words import vocabulary

LIMIT = 2048
#: Prefixes that a task holds before it hands them on.
PREFIXES_AT_ONCE = 1 << 19


def token_counts(docs: DataFrame, *, limit: int = LIMIT, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens). No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        vocab = vocabulary(vocabulary_path)
        for b in batches:
            text = b.column("text")
            n = pa.array([vocab.count(t) for t in text.to_pylist()], pa.int64())
            yield pa.record_batch([b.column("id"), pc.cast(pc.binary_length(text), pa.int64()), n], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_counts(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ends`` (lengths of all prefixes in characters, ascending) and ``counts`` (their exact token counts).

    Store it once; :func:`tokens_of_prefix` and :func:`longest_prefix` then answer
    budget and truncation questions with no encoding.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        vocab = vocabulary(vocabulary_path)
        for b in batches:
            first, held, size = 0, [], 0
            for i in range(b.num_rows):
                held.append(vocab.prefix_counts(b.column("text")[i].as_py()))
                size += len(held[-1][0])
                if size >= PREFIXES_AT_ONCE or i + 1 == b.num_rows:
                    columns = (pa.array([x[k] for x in held], pa.list_(pa.int32())) for k in (0, 1))
                    yield pa.record_batch([b.column("id").slice(first, len(held)), *columns], ["id", "ends", "counts"])
                    first, held, size = i + 1, [], 0

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, ends array<int>, counts array<int>").withColumnRenamed("id", id_col)


def longest_prefix(budget: int | Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    within = F.filter(F.arrays_zip(F.col(ends).alias("e"), F.col(counts).alias("c")), lambda x: x["c"] <= budget)
    return F.array_max(F.transform(within, lambda x: x["e"]))


def tokens_of_prefix(chars: int | Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Tokens of the first ``chars`` characters; null where the text is shorter."""
    at = F.array_position(F.col(ends), chars)
    return F.when(at > 0, F.get(F.col(counts), (at - 1).cast("int")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts(documents(spark, sf_dir))
