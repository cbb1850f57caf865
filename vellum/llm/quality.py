"""Quality rules with robust multivariate outliers, with DataFrame functions only.

Base rules look at each text alone. Of the texts that pass, vectors of transformed
statistics are held against a minimum-covariance-determinant estimate of their language
and source:

1. Three starts: all rows by mean and covariance, by medians of coordinates and median
   deviations, and the half of the rows nearest to the medians. From each, concentration
   steps keep the ``SHARE`` of rows that lie closest, until no determinant falls any
   more (``STEPS`` at most). Of each group's starts that with the least determinant counts.
2. One reweighting step: mean and covariance of the rows that are not ``NEAR`` too far.
3. Groups lean on their language, by ``PRIOR`` rows of it, and languages on all texts: a
   group of one text has in effect the estimate of its language, a large one its own.
   So every text has a distance, and there is no size from which a group counts.
4. Determinants and distances are of covariances with the squares of ``FLOORS`` on the
   diagonal (a regularised determinant), so that a statistic that hardly varies in a
   source rejects nobody for little.

Rows whose squared Mahalanobis distance is beyond ``FAR`` are rejected. Distances are
counted in bins, so the share kept is exact: rows of the last bin count in part, all
alike. Counts, sums and bins are added up before they are shuffled; medians are sketches
of fixed size and only give starts.

Defined results: a null text has no words, and so fails the base rules; null languages
and sources are groups of their own; a null id is kept; repeated rows each give a row;
an empty table gives an empty table; extra columns are ignored, whatever their names
(``keep_good`` keeps them); a text is handled whole in one task, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, row_key, small, table

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"

SHARE = 0.75
STEPS = 20
#: Rows of its language that a group leans on, and of all texts that a language does; least deviation of each feature.
PRIOR = 20
FLOORS = (0.8, 0.6, 0.25, 0.1, 0.1)
#: Chi-squared with five degrees of freedom: 1 - 1e-6 and 0.975; and what makes the covariance of the closest 75 % consistent.
FAR = 35.9
NEAR = 12.83
CONSISTENT = 1.41
#: Bins of squared distances: so many for each doubling, between these powers of two.
BINS, LEAST_BIN, MOST_BIN = 16, -40, 40

FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``keep``, and the counts of the base rules. No shuffle."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    chars = F.length(F.translate("text", _BLANK, ""))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    out = rows.select("own", F.transform(words, lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    out = out.select("own", "h", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("h").cast("long").alias("n_words"))

    counts = ["own", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    out = out.select(*counts, F.when(F.col("n_words") >= WINDOW, F.col("h")).alias("w"))
    step = 1
    while step < WINDOW:  # hashes of 2, 4, 8 words from each word on
        rest = F.size("w") - step
        out = out.select(*counts, F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(1 + step), rest), lambda a, b: F.xxhash64(a, b)).alias("w"))
        step *= 2
    # only texts with a window that comes again go on
    again = F.size(F.array_distinct("w")) < F.size("w")
    out = out.select(*counts, F.when(again, F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    rest = F.size("s") - 1
    same = F.zip_with(F.slice("s", F.lit(1), rest), F.slice("s", F.lit(2), rest), lambda a, b: a["x"] == b["x"])
    out = out.select(*counts, "s", same.alias("same"))
    found = F.arrays_zip("s", F.concat(F.array(F.lit(False)), "same").alias("l"), F.concat("same", F.array(F.lit(False))).alias("r"))
    at = F.array_sort(F.transform(F.filter(found, lambda x: x["l"] | x["r"]), lambda x: x["s"]["i"]))
    out = out.select(*counts, at.alias("at"))
    rest = F.size("at") - 1
    covered = F.aggregate(F.zip_with(F.slice("at", F.lit(1), rest), F.slice("at", F.lit(2), rest), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)
    out = out.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.select(F.col("own.id").alias(id_col), *(F.col(f"own.k{i}").alias(c) for i, c in enumerate(keep)), *counts[1:], "n_repeat_words")


def _features(rows: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({
        "f_words": F.log1p("n_words"), "f_length": F.log(F.greatest(ratio("word_chars", "n_words"), F.lit(1.0))) * 2, "f_symbols": F.log1p(10 * ratio("n_symbols", "n_words")),
        "f_lines": ratio("n_dup_lines", "n_lines"), "f_repeats": ratio("n_repeat_words", "n_words"),
    })


_D = range(len(FEATURES))
_PAIRS = [(i, j) for i in _D for j in range(i + 1)]
_MOMENTS = [*(f"m{i}" for i in _D), *(f"c{i}{j}" for i, j in _PAIRS)]


def _moments(rows: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """Per key: ``n``, the sum of the weights, means ``m0``.. and covariances ``c00``.., from sums."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(f) for f in FEATURES]
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("n"), *(F.sum(w * x[i]).alias(f"s{i}") for i in _D), *(F.sum(w * x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS))
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    return sums.select(*keys, "n", *(mean(i).alias(f"m{i}") for i in _D), *((F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _PAIRS))


def _pooled(estimates: DataFrame, *keys: str) -> DataFrame:
    """Estimates of groups put together, within and between them, by ``n``."""
    n, m = F.col("n"), [F.col(f"m{i}") for i in _D]
    sums = estimates.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(n * m[i]).alias(f"s{i}") for i in _D), *(F.sum(n * (F.col(f"c{i}{j}") + m[i] * m[j])).alias(f"q{i}{j}") for i, j in _PAIRS))
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    return sums.select(*keys, "n", *(mean(i).alias(f"m{i}") for i in _D), *((F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _PAIRS))


def _leaning(estimates: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
    """``estimates`` with ``PRIOR`` rows of ``prior`` added to each."""
    p = prior.select(*on, *(F.col(c).alias(f"p_{c}") for c in _MOMENTS))
    both = estimates.join(F.broadcast(p), on) if on else estimates.crossJoin(F.broadcast(p))
    a, total = F.col("n"), F.col("n") + PRIOR
    mean = lambda i: (a * F.col(f"m{i}") + PRIOR * F.col(f"p_m{i}")) / total
    own = lambda i, j: F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")
    lent = lambda i, j: F.col(f"p_c{i}{j}") + F.col(f"p_m{i}") * F.col(f"p_m{j}")
    covariances = (((a * own(i, j) + PRIOR * lent(i, j)) / total - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _PAIRS)
    return both.select(*(c for c in estimates.columns if c not in _MOMENTS), *(mean(i).alias(f"m{i}") for i in _D), *covariances)


def _whitened(estimates: DataFrame, ridge: list[float], scale: float = 1.0) -> DataFrame:
    """With ``w00``.., the inverse of the Cholesky factor of the covariance with its ridge, and ``det``, the log determinant."""
    df = estimates
    for i in _D:
        for j in range(i + 1):
            x = F.col(f"c{i}{j}") * scale + (F.lit(ridge[i]) if i == j else F.lit(0.0))
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(ridge[i] * 1e-6))) if i == j else x / F.col(f"l{j}{j}"))
    for j in _D:
        for i in range(j, len(FEATURES)):
            x = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                x = x - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            df = df.withColumn(f"w{i}{j}", x / F.col(f"l{i}{i}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in _D), F.lit(0.0)) * 2
    return df.withColumn("det", det).select(*estimates.columns, *(f"w{i}{j}" for i, j in _PAIRS), "det")


def _squared_distance() -> Column:
    total = F.lit(0.0)
    for i in _D:
        z = sum((F.col(f"w{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def _closest(measured: DataFrame, share: float) -> DataFrame:
    """``measured`` (``g``, ``start``, ``d2``) with ``weight``: 1 for rows that lie closest, and for those of the bin in
    which the share ends, the part of it that is wanted."""
    power = F.log2(F.greatest(F.col("d2"), F.lit(2.0**LEAST_BIN)))
    binned = measured.withColumn("bin", F.floor(F.least(power, F.lit(float(MOST_BIN))) * BINS).cast("int"))
    of = Window.partitionBy("g", "start")
    counts = binned.groupBy("g", "start", "bin").agg(F.count("*").alias("c"))
    summed = counts.withColumn("upto", F.sum("c").over(of.orderBy("bin"))).withColumn("wanted", F.ceil(F.sum("c").over(of) * share))
    ends = summed.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("c") < F.col("wanted")))
    edge = materialise(ends.select("g", "start", F.col("bin").alias("edge"), ((F.col("wanted") - F.col("upto") + F.col("c")) / F.col("c")).alias("part")), "edge")
    weight = F.when(F.col("bin") < F.col("edge"), 1.0).when(F.col("bin") == F.col("edge"), F.col("part"))
    return binned.join(small(edge), ["g", "start"]).withColumn("weight", weight).filter("weight > 0")


def _starts(rows: DataFrame, ridge: list[float]) -> DataFrame:
    """Per group and start: means and covariances."""
    medians = rows.groupBy("g").agg(*(F.percentile_approx(FEATURES[i], 0.5, 200).alias(f"m{i}") for i in _D))
    middle = small(materialise(medians, "middle"))
    apart = rows.join(middle, "g").groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in _D), *(F.percentile_approx(F.abs(F.col(FEATURES[i]) - F.col(f"m{i}")), 0.5, 200).alias(f"a{i}") for i in _D))
    diagonal = apart.select("g", F.lit(0.0).alias("n"), *(f"m{i}" for i in _D), *(((1.4826 * F.col(f"a{i}")) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    robust = materialise(diagonal, "diagonal")
    measured = rows.join(small(_whitened(robust, ridge)), "g").withColumns({"start": F.lit(2), "d2": _squared_distance()})
    near = _moments(_closest(measured.select("g", "start", "d2", *FEATURES), 0.5), "g", weight=F.col("weight"))
    named = [_moments(rows, "g"), robust, near]
    out = None
    for k, df in enumerate(named):
        own = df.select("g", F.lit(k).alias("start"), *_MOMENTS)
        out = own if out is None else out.unionByName(own)
    return materialise(out, "starts")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """``rows``: ``g``, ``lang`` and the features. Per group: means, and the whitening of its covariance."""
    ridge = [x * x for x in FLOORS]
    now, last = materialise(_whitened(_starts(rows, ridge), ridge), "estimate"), None
    for _ in range(STEPS):
        measured = rows.join(small(now), "g").withColumn("d2", _squared_distance()).select("g", "start", "d2", *FEATURES)
        closest = _moments(_closest(measured, SHARE), "g", "start", weight=F.col("weight"))
        now = materialise(_whitened(closest.drop("n"), ridge, CONSISTENT), "estimate")
        total = now.agg(F.coalesce(F.sum("det"), F.lit(0.0))).first()[0]
        if last is not None and total >= last - 1e-6 * max(1.0, abs(last)):
            break
        last = total
    best = now.groupBy("g").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("det", "start")).alias("b")).select("g", "b.*")
    measured = rows.join(small(materialise(best, "best")), "g").withColumn("d2", _squared_distance())
    own = materialise(_moments(measured.filter(F.col("d2") <= NEAR).select("g", "lang", *FEATURES), "g", "lang"), "reweighted")
    languages = _pooled(own, "lang")
    lent = materialise(_leaning(languages, _pooled(languages), []).withColumnRenamed("lang", "of"), "languages")
    # each group has its language once, also where that is unknown
    both = own.join(F.broadcast(lent.select("of", *(F.col(c).alias(f"p_{c}") for c in _MOMENTS))), F.col("lang").eqNullSafe(F.col("of")))
    leaning = _leaning(both.select("g", "n", *_MOMENTS), both.select("g", *(F.col(f"p_{c}").alias(c) for c in _MOMENTS)), ["g"])
    return materialise(_whitened(leaning, ridge), "estimates").select("g", *(f"m{i}" for i in _D), *(f"w{i}{j}" for i, j in _PAIRS))


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, ``distance2``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = materialise(statistics(rows, id_col="id", keep=("lang", "source")).withColumn("base_failed", failed), "statistics")

    none = F.lit("none")
    key = F.concat_ws("\x1f", F.coalesce("lang", none), F.coalesce("source", none), F.col("lang").isNull().cast("string"), F.col("source").isNull().cast("string"))
    rows = materialise(_features(stats).withColumn("g", F.xxhash64(F.sha2(key, 256))), "features")

    estimates = small(robust_estimates(rows.filter("not base_failed").select("g", "lang", *FEATURES)))
    judged = rows.join(estimates, "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), _squared_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= FAR, F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")


def keep_good(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that :func:`assess` rejects, each by its own verdict, also where ids are null or come again."""
    # a verdict depends on text, language and source alone; the id only spreads copies over tasks
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.select(row.alias("row"), row_key(id_col, "text", "lang", "source").alias("key"), "text", "lang", "source")
    kept = assess(keyed.drop("row"), id_col="key").filter("kept").select("key").distinct()
    return keyed.join(kept, "key", "left_semi").select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).drop("distance2")
