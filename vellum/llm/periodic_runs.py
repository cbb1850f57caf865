"""Runs of words that repeat with a period, by a suffix automaton.

1. In a run every word lies in five words that come again no further off than a quarter of
   the run (a run is at least six words long and four periods). So stretches of words whose
   five-word groups all come again nearby are cut out first, by one sort of hashes; the
   rest can hold no run. Equal groups have equal hashes, so no run is lost.
2. Each stretch gets a suffix automaton. Its states are visited from long to short, and the
   ordered set of places where a state's string ends is merged into that of its suffix
   link, the smaller set into the larger one. Two places that become neighbours and are no
   further apart than the link's string is long are ends of a square: the words between,
   and as many before, repeat at that distance.
3. Squares of one period that overlap are one stretch of equal words, extended to both
   sides as far as words stay equal: a run. Of runs with the same words the smallest period
   counts.

Defined results: a null or empty text has no words and no runs; a row with a null id is
judged like any other; repeated rows each give a row; an empty table gives an empty table;
extra columns are ignored, whatever their names. A text is handled whole in one task; its
automaton takes about half a kilobyte for each word of stretches that can hold a run.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, small_batches

#: Least words of a run, and least number of its periods.
LEAST, PERIODS = 6, 4
#: Words of the groups that find stretches: any that fits LEAST and PERIODS must be at most this.
_GROUP = 5
#: Times that stretches are cut; each cut only leaves out what can hold no run.
_ROUNDS = 8
#: Places in a list of an ordered set.
_CHUNK = 2048


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: ``(first, end)`` of maximal stretches whose five-word groups come again near enough."""
    n = len(hashes) - _GROUP + 1
    if n < LEAST - _GROUP + 1:
        return []
    groups = np.zeros(n, dtype=np.uint64)
    h = hashes.view(np.uint64)
    for i in range(_GROUP):
        groups *= np.uint64(0x9E3779B97F4A7C15)
        groups += h[i : i + n]
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return []
    near = np.full(n, np.iinfo(np.int64).max)
    a, b = order[same], order[same + 1]
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    able = near < n
    for _ in range(_ROUNDS):
        edge = np.diff(np.concatenate(([0], able.view(np.int8), [0])))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        width = end - first + _GROUP - 1
        fits = near[able] * PERIODS <= np.repeat(width, end - first)
        if fits.all():
            break
        able[np.flatnonzero(able)[~fits]] = False
    return [(i, j) for i, j, w in zip(first.tolist(), (end + _GROUP - 1).tolist(), width.tolist(), strict=True) if w >= LEAST]


class Places:
    """An ordered set of whole numbers, in lists of bounded length."""

    __slots__ = ("lists", "heads", "size")

    def __init__(self, place: int):
        self.lists, self.heads, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Add a place that isn't there; its neighbours."""
        k = max(bisect_left(self.heads, place) - 1, 0)
        at = self.lists[k]
        i = bisect_left(at, place)
        before = at[i - 1] if i else None
        after = at[i] if i < len(at) else self.lists[k + 1][0] if k + 1 < len(self.lists) else None
        at.insert(i, place)
        self.size += 1
        if not i:
            self.heads[k] = place
        if len(at) > _CHUNK:
            half = len(at) // 2
            self.lists.insert(k + 1, at[half:])
            self.heads.insert(k + 1, at[half])
            del at[half:]
        return before, after

    def __iter__(self):
        for at in self.lists:
            yield from at


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``words``: per state its length, its suffix link and the place where it was made (-1: a clone)."""
    length, link, place, steps = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        place.append(i)
        steps.append({})
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = now
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                place.append(-1)
                steps.append(steps[q].copy())
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return length, link, place


def squares(words: list[int]) -> list[tuple[int, int, int]]:
    """``(period, first, last)``: words from ``first`` to ``last`` equal those a period on, and there are at least a period of them."""
    length, link, place = automaton(words)
    sets: list = [None if p < 0 else Places(p) for p in place]
    found = []
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        to, mine = link[v], sets[v]
        sets[v] = None
        if not to:
            continue
        theirs, n = sets[to], length[to]
        if theirs is None:
            sets[to] = mine
            continue
        if mine.size > theirs.size:
            mine, theirs = theirs, mine
        for x in mine:
            before, after = theirs.add(x)
            if before is not None and x - before <= n:
                found.append((x - before, before - n + 1, before))
            if after is not None and after - x <= n:
                found.append((after - x, x - n + 1, x))
        sets[to] = theirs
    return found


def runs(words: list) -> list[tuple[int, int, int]]:
    """``(start, period, length)`` of all runs of a sequence, by start, then period."""
    ids: dict = {}
    numbers = [ids.setdefault(w, len(ids)) for w in words]
    found: dict[tuple[int, int], int] = {}
    at = (0, 0)  # the period, and the end of equal words that were extended last
    for period, first, last in sorted(squares(numbers)):
        if at[0] == period and last <= at[1]:
            continue
        while first and numbers[first - 1] == numbers[first - 1 + period]:
            first -= 1
        while last + period + 1 < len(numbers) and numbers[last + 1] == numbers[last + 1 + period]:
            last += 1
        at = (period, last)
        size = last - first + 1 + period
        if size >= max(LEAST, PERIODS * period):
            found[first, size] = min(found.get((first, size), period), period)
    return sorted((start, period, size) for (start, size), period in found.items())


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """:func:`runs`, with the automaton only where runs can be."""
    if len(words) < LEAST:
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    found = []
    for i, j in stretches(hashes):
        found += [(i + start, period, size) for start, period, size in runs(words[i:j])]
    return sorted(found)


def periodic(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document with its made-up periodic end (a tenth of all documents have one)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", change=None, collapsed: bool = False) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period``, by start, then period) and
    ``collapsed_sha256``: the digest of the words joined by spaces, each run cut to its first period; with
    ``collapsed`` also that text. ``change(words, id)`` gives the words to use instead of a text's own. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = f"id {dict(rows.dtypes)['id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string" + (", collapsed string" if collapsed else "")

    def run(batches):
        for b in batches:
            n, found, digests, texts = [], [], [], []
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split()  # of bytes: at space and U+0009..U+000D
                if change:
                    words = change(words, doc_id)
                own = runs_of(words)
                n.append(len(words))
                found.append([{"start": s, "length": size, "period": p} for s, p, size in own])
                if own:
                    dropped = np.zeros(len(words) + 1, dtype=np.int64)
                    for s, p, size in own:
                        dropped[s + p] += 1
                        dropped[s + size] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if collapsed:
                    texts.append(kept.decode())
            out = [b.column("id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(digests, pa.string())]
            yield pa.record_batch([*out, pa.array(texts, pa.string())] if collapsed else out, ["id", "n_words", "runs", "collapsed_sha256"] + ["collapsed"] * collapsed)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = detect(documents(spark, sf_dir), change=periodic)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    # the longest; of these the first by start, then period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed_sha256", F.when(F.size("runs") > 0, best).alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"))
    length = -F.col("best.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END) END)"

OP13_SQL = rf"""
WITH h AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE xor({_CRC}, CAST(4294967295 AS BIGINT)) END AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
c AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM c),
g AS MATERIALIZED (SELECT doc_id, n, i, hash(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM d, unnest(range(0, n - 4)) u(i)),
s AS MATERIALIZED (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
f AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM r WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, q := period), struct_pack(a := -length, b := start, c := period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM f GROUP BY 1),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM f),
x AS (SELECT doc_id, list(i) AS gone FROM o GROUP BY 1),
k AS (SELECT d.doc_id, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (SELECT string_agg(w[j + 1], ' ' ORDER BY j) FROM unnest(range(0, n)) u(j) LEFT JOIN unnest(gone) v(z) ON z = j WHERE z IS NULL) END AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT k.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(floor(1000 * best.l / best.q) AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM k LEFT JOIN t USING (doc_id)"""
