"""Substring search by postings of short character groups, with the texts themselves as the last word.

A word is contained in a text only if all its groups of three characters are (a shorter word:
the word itself). So the texts that have a search's rarest groups are few, and only they are
looked at. Nothing is ever compared with all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_all_words

#: Characters of a group, folders of a written index, and parts of a group's texts where many searches meet them.
GRAM, BUCKETS, PARTS = 3, 64, 16


def _groups(text: Column, n: Column | int) -> Column:
    """All groups of ``n`` characters of a text, once each."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.expr("cast(array() as array<string>)"))


def postings(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """``gram`` and ``id``: which texts have which groups of one, two and three characters; blanks are in none."""
    words = F.array_distinct(F.filter(F.split(F.col(key), r"\s+"), lambda w: w != ""))
    every = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(*(_groups(w, n) for n in range(1, GRAM + 1))))))
    return rows.select(F.explode(every).alias("gram"), F.col(id_col).alias("id"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def write_postings(rows: DataFrame, id_col: str, key: str, path: str) -> None:
    """The postings as a table, in folders by group: a search reads the folders of its groups."""
    postings(rows, id_col, key).withColumn("b", _bucket(F.col("gram"))).repartition("b", "gram").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("b").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search(index: DataFrame, rows: DataFrame, id_col: str, key: str, wanted: str) -> DataFrame:
    """``rows`` whose key contains each word of ``wanted`` (a key): those with all groups, then those that hold the words."""
    words = wanted.split()
    grams = sorted({w[i : i + GRAM] for w in words for i in range(max(1, len(w) - GRAM + 1))})
    if not grams:
        return rows
    mine = index.filter(F.col("gram").isin(grams))
    if "b" in index.columns:
        buckets = index.sparkSession.range(1).select(F.array(*(_bucket(F.lit(g)) for g in grams))).first()[0]
        mine = mine.filter(F.col("b").isin(sorted(set(buckets))))
    ids = mine.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(F.col("id").alias(id_col))
    return rows.join(ids, id_col, "left_semi").filter(contains_all_words(F.col(key), wanted))


def search_all(index: DataFrame, rows: DataFrame, id_col: str, key: str, searches: DataFrame) -> DataFrame:
    """Many searches at once: ``sid`` and the id of each row whose key contains all words of ``wanted``.

    Each search looks up its rarest group only; the texts that have it carry their keys to the searches, so what is no match is
    dropped where the two meet. A group's texts are dealt into :data:`PARTS`, since a frequent one may have many searches. A
    search without words asks for nothing and is passed over.
    """
    words = searches.select("sid", F.array_distinct(F.filter(F.split("wanted", r"\s+"), lambda w: w != "")).alias("words")).filter("size(words) > 0")
    grams = words.select("sid", "words", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: _groups(w, F.least(F.length(w), F.lit(GRAM))))))).alias("gram"))
    # a group that no text has makes its search empty: it counts as the rarest
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = grams.join(counts, "gram", "left").groupBy("sid", "words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).select("sid", "words", F.col("g.gram").alias("gram"))
    asked = rarest.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    texts = rows.select(F.col(id_col).alias("id"), F.col(key).alias("__key"))
    held = index.select("gram", "id").join(rarest.select("gram").distinct(), "gram", "left_semi").join(texts, "id").withColumn("part", F.pmod(F.hash("id"), F.lit(PARTS)))
    return held.join(asked, ["gram", "part"]).filter(F.forall("words", lambda w: F.contains(F.col("__key"), w))).select("sid", F.col("id").alias(id_col))
