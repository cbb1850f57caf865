"""Entity resolution: candidates by shared words, scores, ranks and decisions.

:func:`candidates` forms all pairs that share a word. :func:`best` finds the first few of
each query without them: what confidence the last of them has at least bounds how many
words a title must share and how long it may be, and words are looked up rare ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_similarity, title_variants
from ..scratch import cut

# From which confidence a match is accepted, which lead it needs, and how many candidates are kept.
THRESHOLD, LEAD, KEPT = 0.8, 0.1, 5


def candidates(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``queries``: qid, q_title, q_year; ``titles``: cid, title, year, popularity. Pairs that share a word or a key."""
    words = lambda df, key, title: df.select(key, F.explode(F.array_distinct(F.flatten(F.transform(title_variants(F.col(title)), lambda v: F.concat(F.split(v, " "), F.array(F.concat(F.lit("="), v))))))).alias("w"))
    found = words(queries, "qid", "q_title").join(words(titles, "cid", "title"), "w").select("qid", "cid").distinct()
    return found.join(queries, "qid").join(titles, "cid")


def confidence(exact: Column, similarity: Column, q_year: Column, year: Column) -> Column:
    gap = F.abs(year - q_year)
    return (
        F.when(q_year.isNull(), F.when(exact, 0.6).otherwise(similarity * 0.5))
        .when(year.isNull(), similarity * 0.5)
        .when(exact & (gap == 0), 1.0).when(exact & (gap == 1), 0.85).when(exact, 0.45)
        .when((gap == 0) & (similarity >= 0.8), 0.82).when(gap == 0, similarity * 0.75)
        .otherwise(similarity * 0.4)
    )


def reason(exact: Column, similarity: Column, q_year: Column, year: Column) -> Column:
    gap = F.abs(year - q_year)
    return (
        F.when(q_year.isNull(), F.when(exact, "same title, no year asked").otherwise("similar title, no year asked")).when(year.isNull(), "no year given")
        .when(exact & (gap == 0), "same title and year").when(exact & (gap == 1), "same title, a year apart").when(exact, F.concat(F.lit("same title, "), gap.cast("string"), F.lit(" years apart")))
        .when((gap == 0) & (similarity >= 0.8), "same year, close title").when(gap == 0, "same year, similar title").otherwise(F.concat(F.lit("similar title, "), gap.cast("string"), F.lit(" years apart")))
    )


def score(pairs: DataFrame) -> DataFrame:
    similarity = F.round(title_similarity(F.col("q_title"), F.col("title")), 10)
    exact = F.arrays_overlap(title_variants(F.col("q_title")), title_variants(F.col("title")))
    rows = pairs.withColumns({"similarity": similarity, "exact": exact})
    args = [F.col(c) for c in ("exact", "similarity", "q_year", "year")]
    rows = rows.withColumns({"confidence": F.round(confidence(*args), 10), "reason": reason(*args)})
    # asked without a year, the only exact title has no rival
    only = F.col("q_year").isNull() & F.col("exact") & (F.count_if("exact").over(Window.partitionBy("qid")) == 1)
    return rows.withColumns({"confidence": F.when(only, 0.85).otherwise(F.col("confidence")), "reason": F.when(only, "same title, no rival").otherwise(F.col("reason"))})


def decide(scored: DataFrame) -> DataFrame:
    """Per query its candidates in order (``place``), and whether the best is beyond doubt (``confident``)."""
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.desc("popularity"), "cid")
    rows = scored.withColumns({"place": F.row_number().over(w), "second": F.lead("confidence").over(w)}).filter(F.col("place") <= KEPT)
    rival = F.coalesce((F.round(F.col("confidence") - F.col("second"), 10) < LEAD) & (F.col("second") >= THRESHOLD), F.lit(False))
    return rows.withColumn("confident", F.when(F.col("place") == 1, (F.col("confidence") >= THRESHOLD) & ~rival))


#: Words of a query of which pairs are looked up first.
SEED_WORDS = 6
#: How much a bound may be off by rounding.
SLACK = 1e-7


def _worded(classes: DataFrame, key: str, variants: str, keep: list[str], ranks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Per key and variant its distinct words, rare ones first: ``v`` and ``words``. And how many classes have each word."""
    each = classes.select(key, *keep, F.explode(variants).alias("v"))
    words = each.select(key, *keep, "v", F.explode(F.array_distinct(F.filter(F.split("v", " "), lambda w: w != ""))).alias("w"))
    ranks = words.groupBy("w").agg(F.count("*").alias("df")) if ranks is None else ranks
    ranked = words.join(ranks, "w", "left").groupBy(key, *keep, "v").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("r"))
    return ranked.select(key, *keep, "v", F.transform("r", lambda x: x["w"]).alias("words")), ranks


def _known(pairs: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes with what a match of them is worth, and how many titles it stands for."""
    both = pairs.distinct().join(asked, "qc").join(classes.select("cls", "year", "tv", F.size("members").alias("n")), "cls")
    overlap = lambda x, y: 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    words = lambda v: F.array_distinct(F.filter(F.split(v, " "), lambda w: w != ""))
    similarity = F.round(F.coalesce(F.array_max(F.flatten(F.transform("qv", lambda x: F.transform("tv", lambda y: F.when((F.size(words(x)) > 0) & (F.size(words(y)) > 0), overlap(words(x), words(y))).otherwise(0.0))))), F.lit(0.0)), 10)
    rows = both.withColumns({"similarity": similarity, "exact": F.arrays_overlap("qv", "tv")})
    return rows.select("qc", "cls", "n", "exact", confidence(*(F.col(c) for c in ("exact", "similarity", "q_year", "year"))).alias("worth"))


def _thresholds(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``least``: what the k-th best title known so far is worth; 0 where there are fewer."""
    running = F.sum("n").over(Window.partitionBy("qc").orderBy(F.desc("worth"), "cls").rowsBetween(Window.unboundedPreceding, 0))
    found = known.withColumn("running", running).groupBy("qc").agg(F.max(F.when(F.col("running") >= k, F.col("worth"))).alias("least"))
    return asked.join(found, "qc", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))


def _probes(worded: DataFrame, longest: int, similarity: Column) -> DataFrame:
    """Words to look up, with the length ``m`` that a title must have and the last place ``upto`` of the word in it, where a
    match takes ``similarity`` at least: two titles of n and m words then share half of that times n + m of them,
    and one of the shared words is among the first of both."""
    rows = worded.withColumn("need", similarity).filter("need is not null and need <= 1")
    rows = rows.select("qc", "q_year", "need", F.size("words").alias("n"), F.posexplode("words").alias("at", "w"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("m"))
    share = F.greatest(F.lit(1), F.ceil(F.col("need") * (F.col("n") + F.col("m")) / 2 - SLACK)).cast("int")
    rows = rows.withColumn("share", share).filter("share <= n and share <= m and at <= n - share")
    return rows.select("qc", "q_year", "w", "m", (F.col("m") - F.col("share")).alias("upto"))


def best(queries: DataFrame, titles: DataFrame, k: int = KEPT) -> DataFrame:
    """:func:`decide` of :func:`score` of :func:`candidates`, without forming all pairs that share a word.

    Titles that are alike and of one year are one class, of which the ``k`` most popular matter; queries likewise. Equal
    titles and titles of the same year that share their two rarest words come first and give each query a threshold; titles
    of the same or no year that could still reach it follow, by :func:`_probes`, and raise it; those of other years, which
    are worth little, come last and only for queries that they could still serve.
    """
    order = Window.partitionBy("tv", "year").orderBy(F.desc("popularity"), "cid")
    ranked = titles.select("cid", "title", "year", "popularity", title_variants(F.col("title")).alias("tv")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    classes = cut(ranked.groupBy("tv", "year").agg(F.min("cid").alias("cls"), F.collect_list(F.struct("cid", "title", "popularity")).alias("members")))
    named = cut(queries.select("qid", "q_title", "q_year", title_variants(F.col("q_title")).alias("qv")).withColumn("qc", F.min("qid").over(Window.partitionBy("qv", "q_year"))))
    asked = named.filter("qid = qc").select("qc", "q_year", "qv")

    title_words, ranks = _worded(classes, "cls", "tv", ["year"], None)
    title_words = cut(title_words)
    query_words = cut(_worded(asked, "qc", "qv", ["q_year"], ranks)[0])
    longest = title_words.agg(F.max(F.size("words"))).first()[0] or 1
    places = title_words.select("cls", "year", F.size("words").alias("m"), F.posexplode("words").alias("at", "w"))

    exact = asked.select("qc", F.explode("qv").alias("v")).join(classes.select("cls", F.explode("tv").alias("v")), "v").select("qc", "cls")
    second = lambda words, i, j: F.coalesce(F.get(words, j), F.lit(""))
    first_two = title_words.filter("size(words) > 0").select("cls", F.col("year").alias("y"), F.get("words", F.lit(0)).alias("a"), second(F.col("words"), 0, F.lit(1)).alias("b"))
    numbers = F.sequence(F.lit(0), F.least(F.size("words"), F.lit(SEED_WORDS)) - 1)
    two = F.flatten(F.transform(numbers, lambda i: F.transform(F.sequence(i + 1, F.least(F.size("words"), F.lit(SEED_WORDS))), lambda j: F.struct(F.get("words", i).alias("a"), second(F.col("words"), i, j).alias("b")))))
    seeds = query_words.filter("size(words) > 0").select("qc", F.col("q_year").alias("y"), F.explode(two).alias("t")).select("qc", "y", "t.a", "t.b").join(first_two, ["y", "a", "b"]).select("qc", "cls")
    found = cut(_known(exact.unionByName(seeds), asked, classes))

    least = _thresholds(found, asked, k).select("qc", "least")
    words = query_words.join(least, "qc")
    t = F.col("least") - SLACK
    same = F.when(t <= 0.6, t / 0.75).when(t <= 0.82, 0.8)
    none = F.when(t <= 0.5, t / 0.5)
    by_year = _probes(words.filter("q_year is not null"), longest, same).unionByName(_probes(words.filter("q_year is not null"), longest, none).withColumn("q_year", F.lit(None).cast("int")))
    met = by_year.join(places, (by_year["w"] == places["w"]) & (by_year["m"] == places["m"]) & by_year["q_year"].eqNullSafe(places["year"]) & (places["at"] <= by_year["upto"])).select("qc", "cls")
    found = cut(found.unionByName(_known(met.join(found, ["qc", "cls"], "left_anti"), asked, classes)))

    words = query_words.join(_thresholds(found, asked, k).select("qc", "least"), "qc")
    other = F.when(F.col("q_year").isNull(), none).when(t <= 0.4, t / 0.4)
    rest = _probes(words, longest, other)
    met = rest.join(places, (rest["w"] == places["w"]) & (rest["m"] == places["m"]) & (places["at"] <= rest["upto"])).select("qc", "cls")
    found = found.unionByName(_known(met.join(found, ["qc", "cls"], "left_anti"), asked, classes))

    # what can't be among the first k stays behind; equal titles are counted and stay
    kept = found.filter("exact or worth > 0").join(_thresholds(found, asked, k).select("qc", "least"), "qc").filter(F.col("exact") | (F.col("worth") >= F.col("least") - SLACK))
    members = kept.select("qc", "cls").join(classes, "cls").select("qc", "year", F.explode("members").alias("t")).select("qc", "year", "t.*")
    return decide(score(named.select("qid", "qc", "q_title", "q_year").join(members, "qc").drop("qc")))


#: Fixed value: candidates of a query whose other titles are asked for.
REFINED = 3


def refine(decided: DataFrame, titles: DataFrame) -> DataFrame:
    """:func:`decide` again where the best is in doubt, with other titles (``cid``, ``other``) of the first candidates of
    the same year that aren't exact. Another title never makes a candidate worse."""
    of = Window.partitionBy("qid")
    doubt = ~F.coalesce(F.max("confident").over(of), F.lit(False))
    rows = decided.withColumn("__may", doubt & F.coalesce((F.col("year") == F.col("q_year")) & ~F.col("exact"), F.lit(False)))
    rows = rows.withColumn("__nth", F.sum(F.col("__may").cast("int")).over(of.orderBy("place")))
    asked = rows.filter(F.col("__may") & (F.col("__nth") <= REFINED)).select("qid", "cid", "q_title", "q_year", "year").join(titles, "cid")
    similarity = F.round(title_similarity(F.col("q_title"), F.col("other")), 10)
    exact = F.arrays_overlap(title_variants(F.col("q_title")), title_variants(F.col("other")))
    scored = asked.withColumns({"similarity": similarity, "exact": exact})
    args = [F.col(c) for c in ("exact", "similarity", "q_year", "year")]
    found = F.struct(F.round(confidence(*args), 10).alias("confidence"), "exact", "similarity", reason(*args).alias("reason"))
    best = scored.select("qid", "cid", found.alias("__f")).groupBy("qid", "cid").agg(F.max("__f").alias("__f"))
    both = rows.join(best, ["qid", "cid"], "left")
    better = F.coalesce(F.col("__f.confidence") > F.col("confidence"), F.lit(False))
    new = {c: F.when(better, F.col(f"__f.{c}")).otherwise(F.col(c)) for c in ("confidence", "exact", "similarity", "reason")}
    return decide(both.withColumns(new).drop("__f", "__may", "__nth", "place", "second", "confident"))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, directory: str, name: str, prefix: str) -> DataFrame:
    """Each row with the longest ``prefix`` of its name in its directory; where there is none, the only one there is.

    Each name asks for its own beginnings, so the join is on equal ones.
    """
    own = prefixes.select(F.col(directory).alias("__d"), F.col(prefix).alias("__p")).distinct()
    begin = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda n: F.substring(F.col(name), F.lit(1), n)))
    asked = rows.select(directory, name).distinct().select(directory, name, begin.alias("__p")).withColumnRenamed(directory, "__d")
    best = asked.join(own, ["__d", "__p"]).groupBy("__d", name).agg(F.max_by("__p", F.length("__p")).alias("__best")).withColumnRenamed("__d", directory)
    alone = own.groupBy(F.col("__d").alias(directory)).agg(F.when(F.count("*") == 1, F.max("__p")).alias("__alone"))
    both = rows.join(best, [directory, name], "left").join(alone, directory, "left")
    return both.select(*(F.col(c) for c in rows.columns), F.coalesce("__best", "__alone").alias(prefix))
