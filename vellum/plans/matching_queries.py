"""Entity resolution over part names: every hundredth title is asked, with and without a year, against all titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_f1
from ..operators import matching
from ._registry import query

_F1 = "CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE round(2 * (len(list_intersect(a, b)) / len(a)) * (len(list_intersect(a, b)) / len(b)) / (len(list_intersect(a, b)) / len(a) + len(list_intersect(a, b)) / len(b)), 10) END"


@query(f"SELECT p_partkey, {_F1} AS f1 FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, ['blue', 'large', 'anvil'] AS b FROM part)")
def word_f1_similarity(t):
    return t.part.select("p_partkey", F.round(word_f1(F.col("p_name"), F.lit("blue large anvil")), 10).alias("f1"))


def asked(t):
    year = F.when(F.col("p_partkey") % 3 != 0, 1990 + F.col("p_size") % 4)
    return t.part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit(" 'deluxe'")).otherwise(F.lit(""))).alias("q_title"), year.alias("q_year"))


def known(t):
    return t.part.select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("title"), (1990 + F.col("p_size") % 4).alias("year"), F.col("p_retailprice").alias("popularity"))


_SCORED = f"""
q AS (SELECT p_partkey AS qid, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' deluxe' ELSE '' END AS q_title, CASE WHEN p_partkey % 3 <> 0 THEN 1990 + p_size % 4 END AS q_year FROM part WHERE p_partkey % 100 = 0),
c AS (SELECT p_partkey AS cid, p_name AS title, 1990 + p_size % 4 AS year, p_retailprice AS popularity FROM part),
p AS (SELECT *, string_split(q_title, ' ') AS a, string_split(title, ' ') AS b, q_title = title AS exact, abs(year - q_year) AS gap FROM q, c WHERE len(list_intersect(string_split(q_title, ' '), string_split(title, ' '))) > 0),
f AS (SELECT *, {_F1} AS s FROM p),
r AS (SELECT *, CASE WHEN q_year IS NULL THEN CASE WHEN exact THEN 0.6 ELSE s * 0.5 END WHEN exact AND gap = 0 THEN 1.0 WHEN exact AND gap = 1 THEN 0.85 WHEN exact THEN 0.45
  WHEN gap = 0 AND s >= 0.8 THEN 0.82 WHEN gap = 0 THEN s * 0.75 ELSE s * 0.4 END AS c0 FROM f),
z AS (SELECT qid, cid, popularity, exact, q_title, title, a, gap, CAST(round(CASE WHEN q_year IS NULL AND exact AND count(*) FILTER (exact) OVER (PARTITION BY qid) = 1 THEN 0.85 ELSE c0 END, 10) AS DOUBLE) AS confidence FROM r),
k AS (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS second FROM z WINDOW w AS (PARTITION BY qid ORDER BY confidence DESC, popularity DESC, cid))"""


@query(f"WITH {_SCORED} SELECT qid, cid, CAST(place AS INTEGER) AS place, confidence FROM k WHERE place <= 5")
def match_candidates(t):
    return matching.best(asked(t), known(t)).select("qid", "cid", "place", "confidence")


@query(f"WITH {_SCORED} SELECT qid, cid, confidence >= 0.8 AND NOT coalesce(round(confidence - second, 10) < 0.1 AND second >= 0.8, false) AS confident FROM k WHERE place = 1", name="rank_confidence_ambiguity")
def rank_confidence_ambiguity(t):
    return matching.best(asked(t), known(t)).filter("place = 1").select("qid", "cid", "confident")


@query(f"WITH {_SCORED} SELECT CASE WHEN confidence >= 0.8 AND NOT coalesce(round(confidence - second, 10) < 0.1 AND second >= 0.8, false) THEN 'apply' WHEN confidence > 0 THEN 'review' ELSE 'none' END AS decision, count(*) AS n FROM k WHERE place = 1 GROUP BY 1", name="match_decision")
def match_decision(t):
    best = matching.best(asked(t), known(t)).filter("place = 1")
    decision = F.when(F.col("confident"), "apply").when(F.col("confidence") > 0, "review").otherwise("none")
    return best.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_SCORED},
d AS (SELECT *, bool_or(place = 1 AND confidence >= 0.8 AND NOT coalesce(round(confidence - second, 10) < 0.1 AND second >= 0.8, false)) OVER (PARTITION BY qid) AS sure FROM k WHERE place <= 5),
m AS (SELECT * EXCLUDE (second), CAST(sum(CASE WHEN NOT sure AND gap = 0 AND NOT exact THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS nth FROM d),
o AS (SELECT qid, cid, q_title = title || ' deluxe' AS same, a, string_split(title || ' deluxe', ' ') AS b FROM m WHERE NOT sure AND gap = 0 AND NOT exact AND nth <= 3),
n AS (SELECT qid, cid, CASE WHEN same THEN 1.0 WHEN {_F1} >= 0.8 THEN 0.82 ELSE round({_F1} * 0.75, 10) END AS other FROM o),
x AS (SELECT m.qid, m.cid, popularity, greatest(confidence, CAST(coalesce(other, 0) AS DOUBLE)) AS confidence FROM m LEFT JOIN n ON n.qid = m.qid AND n.cid = m.cid),
y AS (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS second FROM x WINDOW w AS (PARTITION BY qid ORDER BY confidence DESC, popularity DESC, cid))
SELECT qid, cid, CAST(place AS INTEGER) AS place, confidence, CASE WHEN place = 1 THEN confidence >= 0.8 AND NOT coalesce(round(confidence - second, 10) < 0.1 AND second >= 0.8, false) END AS confident FROM y""")
def match_refined(t):
    """Doubtful matches held against other titles too."""
    others = t.part.select(F.col("p_partkey").alias("cid"), F.concat("p_name", F.lit(" 'deluxe'")).alias("other"))
    decided = matching.best(asked(t), known(t))
    return matching.refine(decided, others).select("qid", "cid", "place", "confidence", "confident")


@query("""
WITH s AS (SELECT DISTINCT concat(p_brand, '/', p_size % 9) AS dir, p_name || '.fr' AS sub FROM part), v AS (SELECT DISTINCT concat(p_brand, '/', p_size % 9) AS dir, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name ELSE substring(p_name, 1, 6) END AS base FROM part),
n AS (SELECT dir, count(*) AS n, max(base) AS sole FROM v GROUP BY 1)
SELECT s.dir, s.sub, coalesce(max_by(base, length(base)) FILTER (starts_with(sub, base)), max(CASE WHEN n = 1 THEN sole END)) AS base FROM s LEFT JOIN v ON v.dir = s.dir LEFT JOIN n ON n.dir = s.dir GROUP BY 1, 2""")
def longest_prefix_in_directory(t):
    folder = F.concat("p_brand", F.lit("/"), (F.col("p_size") % 9).cast("string")).alias("dir")
    subs = t.part.select(folder, F.concat("p_name", F.lit(".fr")).alias("sub")).distinct()
    k = F.col("p_partkey") % 3
    videos = t.part.select(folder, F.when(k == 0, F.split("p_name", " ")[0]).when(k == 1, F.col("p_name")).otherwise(F.substring("p_name", 1, 6)).alias("base")).distinct()
    return matching.longest_prefix(subs, videos, "dir", "sub", "base")
