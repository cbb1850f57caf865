"""Secret scans, with DataFrame functions only.

Three patterns find assigned secrets, access keys and long hex strings. Further
strings are found by how random they are:

- Candidates are runs of at least 20 characters of ``[A-Za-z0-9+/_=-]`` with a letter
  and a digit, in what is left of the text outside the spans of the patterns (blanked
  one kind after another), and the parts of such runs between ``=``, ``/``, ``_`` and
  ``-`` that are as long. Each is read in the encoding that its characters fit
  (hexadecimal, base 32 and 36 of either case, base 62, base 64). Of those found that
  overlap, the likeliest stays.
- Three tests ask whether its digits are as random ones would be: chi-squared over the
  whole alphabet (by pairs of equal digits, with their exact mean and variance, since
  most digits occur once or never), runs above and below its middle, and correlation of
  neighbours. Fisher's method joins them; a candidate must stay above ``RANDOM_P``.
- Evidence is an e-value, the mean of two: the likelihood under uniform digits over
  that under running text, and what the chi-squared test says against running text,
  by its chance there of so few equal pairs. Both grow with length. The candidates of a
  document are held to the false-discovery rate ``RATE`` (Benjamini and Hochberg for
  e-values), with weights in proportion to length.

Of random strings of 20 characters about 7 in 10 are found in lower-case base 32 and 36,
9 in 10 in the other encodings; of 32 and more, 19 in 20 and more in all of them.

Matches are looked for left to right and don't overlap within a kind. Their places are
sums of the lengths of matches and of what lies between, so a text takes time in
proportion to its length, and to the power 1.5 of the number of its matches. Among the
parts of one run the choice is made in rounds of a sweep (about their logarithm; in the
worst case, parts alternately cut at ``/`` and ``_`` each of which is likelier than the one
before, half their number).

Defined results: a null text is the empty text, with no spans; a null id is kept;
repeated rows each give a row; an empty table gives an empty table; extra columns are
ignored, whatever their names (``redact`` keeps them); a text is handled whole in one
task, however long. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

#: The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
VALUE_LEAST = 8

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Parts of candidates between separators: a name, a path or both before a value that may itself hold ``/`` or ``_-``.
PARTS = tuple(rf"(?<![A-Za-z0-9+{own}])[A-Za-z0-9+{own}]{{20,}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?" for own in ("/_-", "_-", "/", ""))
RANDOM_P = 0.001
RATE = 0.001
MASK = "[SECRET]"

#: Shares of lower case, upper case, digits and others in running text, and of letters there, in thousandths, about the
#: mean of European languages; a fifth is dealt to all letters alike.
LOWER, UPPER, DIGITS, OTHERS = 0.80, 0.06, 0.08, 0.06
LETTERS = {
    "a": 85, "b": 13, "c": 32, "d": 42, "e": 150, "f": 12, "g": 18, "h": 30, "i": 75, "j": 4, "k": 7, "l": 45, "m": 27,
    "n": 77, "o": 60, "p": 24, "q": 5, "r": 67, "s": 72, "t": 75, "u": 45, "v": 12, "w": 9, "x": 3, "y": 8, "z": 5,
}
#: Matches in a text up to which places are added up at once; more are dealt into blocks.
BLOCK = 64
#: Characters of a text that ``redact`` rewrites at once.
CHUNK = 4096
#: The least chance under running text that counts as evidence.
LEAST_P = 1e-7

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Pattern that a string must fit, alphabet, and what is done to the string first.
_ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Za-z0-9]+$", _ALNUM),
    ("", _ALNUM + "+/"),
)


def _text_shares() -> dict[str, float]:
    total = sum(LETTERS.values())
    letter = {c: 0.8 * n / total + 0.2 / 26 for c, n in LETTERS.items()}
    return {c: LOWER * x for c, x in letter.items()} | {c.upper(): UPPER * x for c, x in letter.items()} | {c: DIGITS / 10 for c in "0123456789"} | {c: OTHERS / 2 for c in "+/"}


#: Log share in running text of each character of base 64, in its order.
_LOG_SHARES = [math.log(_text_shares()[c]) for c in _ALNUM + "+/"]


def coincidence(alphabet: str) -> tuple[float, float]:
    """The chances that two and that three characters of running text in ``alphabet`` are equal."""
    own = [_text_shares()[c] for c in alphabet]
    return tuple(sum((x / sum(own)) ** e for x in own) for e in (2, 3))


def _let(x: Column, f) -> Column:
    """``f(x)``, with ``x`` worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


_NO_SPANS = "cast(array() as array<struct<start:int,end:int,found:string>>)"


def _placed(gaps: Column, matches: Column) -> Column:
    """Spans (start, end, found) of ``matches``, of which each comes after a gap of so many characters."""
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("n"), m.alias("found")))

    def added(xs):
        def step(acc, x):
            start = acc["at"] + x["gap"]
            return F.struct((start + x["n"]).alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["found"].alias("found"))).alias("spans"))

        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("spans")), step)

    def blocked(xs):
        size = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: added(F.slice(xs, b * size + 1, size)))
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

        def moved(blocks):
            starts = F.aggregate(blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
            return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["spans"], lambda x: _moved(x, at))))

        return _let(blocks, moved)

    return F.when(F.size(matches) == 0, F.expr(_NO_SPANS)).when(F.size(matches) <= BLOCK, added(both)["spans"]).otherwise(_let(both, blocked))


def _moved(x: Column, by: Column) -> Column:
    return F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["found"].alias("found"))


def _find(text: Column, pattern: str, matches: Column) -> Column:
    """Spans of ``matches``, which are all matches of ``pattern`` in ``text``."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(F.size(matches) > 0, _placed(gaps, matches)).otherwise(F.expr(_NO_SPANS))


def _blanked(text: Column, pattern: str, keep=None) -> Column:
    """``text`` with blanks in place of the matches (those that ``keep`` lets pass): what is left keeps its place."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    one = lambda before, m: F.concat(before, F.coalesce(blank(m) if keep is None else F.when(keep(m), blank(m)).otherwise(m), F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one), "")


def _two_sided(z: Column) -> Column:
    """Chance that a normal variable is as far from 0 as ``z``, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _above(z: Column) -> Column:
    """Chance that a normal variable is above ``z``."""
    half = _two_sided(z) / 2
    return F.when(z > 0, half).otherwise(1 - half)


def _body(token: Column) -> Column:
    return F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")


def _of_encoding(body: Column) -> Column:
    """``alphabet`` of the encoding that ``body`` fits, its size ``k``, and the chances that ``two`` and ``three`` characters of text in it are equal."""

    def of(alphabet):
        two, three = coincidence(alphabet)
        return F.struct(F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"), F.lit(two).alias("two"), F.lit(three).alias("three"))

    out = of(_ENCODINGS[-1][1])
    for pattern, alphabet in reversed(_ENCODINGS[:-1]):
        out = F.when(body.rlike(pattern), of(alphabet)).otherwise(out)
    return out


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _before(v: Column) -> Column:
    return F.slice(v, 1, F.size(v) - 1)


def _after(v: Column) -> Column:
    return F.slice(v, 2, F.size(v) - 1)


def judged(token: Column) -> Column:
    """``le``, the log e-value of ``token``, and ``p``, Fisher's joint p-value of the three tests on its digits."""
    shares = F.array(*map(F.lit, _LOG_SHARES))

    def counted(x):
        v, k = x["v"], x["k"]
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(x["chars"]), lambda c: n - F.size(F.array_remove(x["chars"], c)))
        turn = lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)
        return F.struct(
            x.alias("x"), n.alias("n"), _sum(F.transform(counts, lambda c: c * (c - 1) / 2)).alias("equal"), F.size(F.filter(v, lambda d: d >= k / 2)).cast("double").alias("high"),
            _sum(F.zip_with(_before(v), _after(v), turn)).alias("turns"), (_sum(v) / n).alias("middle"),
        )

    def placed(y):
        x, n, high, middle = y["x"], y["n"], y["high"], y["middle"]
        v, k, two, three = x["v"], x["k"], x["two"], x["three"]
        couples, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2)
        mean = 2 * high * (n - high) / n
        spread = mean * (mean - 1) / (n - 1)
        var = _sum(F.transform(v, lambda d: (d - middle) * (d - middle)))
        cov = _sum(F.zip_with(_before(v), _after(v), lambda a, b: (a - middle) * (b - middle)))
        return F.struct(
            x["likelihood"].alias("likelihood"), ((y["equal"] - couples / k) / F.sqrt(couples * (1 / k) * (1 - 1 / k))).alias("chi"),
            ((y["equal"] - couples * two) / F.sqrt(couples * (two - two * two) + triples * (three - two * two))).alias("text"),
            F.when(spread > 0, (y["turns"] - mean) / F.sqrt(spread)).alias("runs"), F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)).alias("serial"),
        )

    def joined(z):
        both = [F.greatest(p, F.lit(1e-12)) for p in (_above(z["chi"]), F.coalesce(_two_sided(z["runs"]), F.lit(0.0)), F.coalesce(_two_sided(z["serial"]), F.lit(0.0)))]
        # 1 / (2 sqrt(p)) is an e-value where p is a p-value
        as_text = -F.log(F.greatest(1 - _above(z["text"]), F.lit(LEAST_P))) / 2 - math.log(2)
        return F.struct(z["likelihood"].alias("a"), as_text.alias("b"), (-sum((F.log(p) for p in both), F.lit(0.0))).alias("half"))

    def weighed(e):
        a, b, half = e["a"], e["b"], e["half"]
        le = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - math.log(2)
        return F.struct(le.alias("le"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p"))

    def read(y):
        body, of = y["body"], y["of"]
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        digits = F.transform(chars, lambda c: F.call_function("locate", c, of["alphabet"]) - 1.0)
        text = _sum(F.transform(chars, lambda c: F.coalesce(F.get(shares, F.call_function("locate", c, F.lit(_ALNUM + "+/")) - 1), F.lit(math.log(OTHERS / 2)))))
        x = F.struct(digits.alias("v"), chars.alias("chars"), of["k"].alias("k"), of["two"].alias("two"), of["three"].alias("three"), (-F.length(body) * F.log(of["k"]) - text).alias("likelihood"))
        return _let(x, lambda x: _let(counted(x), lambda y: _let(placed(y), lambda z: _let(joined(z), weighed))))

    # the encoding is looked for once for a string, not for each of its characters
    return _let(_body(token), lambda body: _let(F.struct(body.alias("body"), _of_encoding(body).alias("of")), read))


def _in_order(spans: Column) -> Column:
    """``spans``, each once, by start and, of equal ones, the longest first."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x.alias("x"))))
    return _let(keyed, lambda xs: F.transform(F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x)), lambda x: x["x"]))


_RANK = "struct<own:double,n:int,start:int,end:int>"


def _beaten(xs: Column, beats) -> Column:
    """The indices in ``xs``, structs ordered by start, of those that another one that overlaps ``beats``.

    A sweep holds those that are open (of the parts of a run, five at most). Spark copies all that a fold holds at each
    step, so the indices of those that are closed are gathered in one string."""
    opened = f"array<struct<rank:{_RANK},won:boolean,i:int,out:boolean>>"

    def step(acc, x):
        ends = lambda o: o["rank"]["end"] <= x["rank"]["start"]
        still = F.filter(acc["open"], lambda o: ~ends(o))
        met = lambda o, out: F.struct(o["rank"].alias("rank"), o["won"].alias("won"), o["i"].alias("i"), out.alias("out"))
        return F.struct(
            F.array_append(F.transform(still, lambda o: met(o, o["out"] | beats(x, o))), met(x, F.exists(still, lambda o: beats(o, x)))).alias("open"),
            F.concat(acc["gone"], gone(F.filter(acc["open"], ends))).alias("gone"),
        )

    gone = lambda os: F.array_join(F.transform(F.filter(os, lambda o: o["out"]), lambda o: F.concat(o["i"].cast("string"), F.lit(","))), "")
    numbered = F.transform(xs, lambda x, i: F.struct(x["rank"].alias("rank"), x["won"].alias("won"), i.alias("i")))
    start = F.struct(F.expr(f"cast(array() as {opened})").alias("open"), F.lit("").alias("gone"))
    every = F.aggregate(numbered, start, step, lambda acc: F.concat(acc["gone"], gone(acc["open"])))
    return F.transform(F.filter(F.split(every, ","), lambda i: i != ""), lambda i: i.cast("int"))


def _likeliest(found: Column) -> Column:
    """Of spans that overlap, that with the highest e-value without its weight, and of equal ones the longest.

    In rounds: spans that outrank all that they overlap stay, and what they overlap goes. That is the choice by
    descending rank, in as many rounds as such overlaps follow from each other."""
    ranked = F.transform(found, lambda x: F.struct((-x["own"]).alias("own"), (x["start"] - x["end"]).alias("n"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.expr(f"cast(array() as array<{_RANK}>)")
    at = lambda xs, places: F.transform(places, lambda i: F.get(xs, i))
    others = lambda xs, places: F.array_except(F.transform(xs, lambda _, i: i), places)

    def ordered(won, lost):
        """Ranks that won and that didn't, by start and the longest first."""
        keyed = lambda xs, flag: F.transform(xs, lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"), r.alias("rank"), F.lit(flag).alias("won")))
        return F.array_sort(F.concat(keyed(won, True), keyed(lost, False)))

    def left(marked):
        gone = F.array_union(_beaten(marked, lambda a, b: a["won"]), F.filter(F.transform(marked, lambda x, i: F.when(x["won"], i)), lambda i: i.isNotNull()))
        return F.transform(at(marked, others(marked, gone)), lambda x: x["rank"])

    def chosen(acc):
        def split(xs):
            lost = lambda places: F.transform(at(xs, places), lambda x: x["rank"])
            return _let(_beaten(xs, lambda a, b: a["rank"] < b["rank"]), lambda places: F.struct(lost(others(xs, places)).alias("won"), lost(places).alias("lost")))

        def after(parts):
            return F.struct(_let(ordered(parts["won"], parts["lost"]), lambda marked: left(marked)).alias("rest"), F.concat(acc["kept"], parts["won"]).alias("kept"))

        return _let(_let(ordered(none, acc["rest"]), split), after)

    def rounds(xs):
        # as many as there may be, in two levels, since each step costs a copy even where nothing is left
        steps = F.sequence(F.lit(0), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"))
        over = lambda acc: F.size(acc["rest"]) == 0
        one = lambda acc, _: F.when(over(acc), acc).otherwise(chosen(acc))
        many = lambda acc, _: F.when(over(acc), acc).otherwise(F.aggregate(steps, acc, one))
        return F.aggregate(steps, F.struct(xs.alias("rest"), none.alias("kept")), many, lambda acc: acc["kept"])

    return F.when(F.size(ranked) <= 1, ranked).otherwise(_let(ranked, rounds))


def _least(scored: Column) -> Column:
    """The least weighted log e-value that the false-discovery rate lets pass; null if none."""
    m = F.size(scored).cast("double")
    ranked = F.reverse(F.array_sort(F.transform(scored, lambda x: x["le"])))
    return F.array_min(F.filter(F.transform(ranked, lambda le, i: F.when(le >= F.log(m / RATE / (i + 1)), le)), lambda x: x.isNotNull()))


def _likely(found: Column) -> Column:
    return found.rlike("[0-9]") & found.rlike("[A-Za-z]")


def _candidates(run: Column) -> Column:
    """A run and its parts, as spans in the text."""
    parts = [_find(run["found"], p, F.regexp_extract_all(run["found"], F.lit(p), F.lit(0))) for p in PARTS]
    moved = F.transform(F.concat(*parts), lambda x: _moved(x, run["start"]))
    every = F.concat(F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"), run["found"].alias("found"))), moved)
    return F.filter(_in_order(every), lambda x: _likely(x["found"]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id and ``found``, an array of (start, kind, end): code points from 0, end exclusive, kind as in :data:`KINDS`."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, every = F.col("text"), lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    matched = rows.select("id", "text", every(text, ASSIGN).alias("a"), every(text, ACCESS).alias("k"), every(text, HEX).alias("h"))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= VALUE_LEAST

    def of(column, kind):
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.array_sort(F.concat(of(F.filter(_find(text, ASSIGN, F.col("a")), lambda x: long_value(x["found"])), 0), of(_find(text, ACCESS, F.col("k")), 1), of(_find(text, HEX, F.col("h")), 2)))
    none = F.size("a") + F.size("k") + F.size("h") == 0
    left = _blanked(_blanked(_blanked(text, ASSIGN, long_value), ACCESS), HEX)
    spans = matched.select("id", "text", F.when(none, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).otherwise(base).alias("base"), F.when(none, text).otherwise(left).alias("left"))
    runs = spans.select("id", "text", "base", "left", every(F.col("left"), CANDIDATE).alias("c"))
    runs = runs.select("id", "text", "base", F.filter(_find(F.col("left"), CANDIDATE, F.col("c")), lambda x: _likely(x["found"])).alias("runs"))
    one = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.length(x["found"]).alias("n"), judged(x["found"]).alias("by"))
    # by run, since only candidates of one run overlap
    scored = runs.select("id", "text", "base", F.transform("runs", lambda r: F.transform(_candidates(r), one)).alias("scored"))
    tested = scored.select("id", "text", "base", "scored", F.aggregate(F.flatten("scored"), F.struct(F.lit(0).alias("m"), F.lit(0).alias("total")), lambda s, x: F.struct((s["m"] + 1).alias("m"), (s["total"] + x["n"]).alias("total"))).alias("sum"))

    def weighed(x):
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["by"]["le"] + F.log(x["n"] * F.col("sum.m") / F.col("sum.total"))).alias("le"), x["by"]["le"].alias("own"))

    passed = F.transform("scored", lambda xs: F.transform(F.filter(xs, lambda x: x["by"]["p"] >= RANDOM_P), weighed))
    tested = tested.select("id", "text", "base", F.when(F.size("scored") > 0, passed).alias("scored"))
    tested = tested.select("id", "text", "base", "scored", F.when(F.size("scored") > 0, _let(F.flatten("scored"), _least)).alias("least"))
    random = F.flatten(F.transform("scored", lambda xs: of(_likeliest(F.filter(xs, lambda x: x["le"] >= F.col("least"))), 3)))
    found = F.when(F.col("least").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", random)))
    return tested.select(F.col("id").alias(id_col), *(["text"] if keep_text else []), found.alias("found"))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_random``."""
    found = scan(docs, id_col=id_col, text_col=text_col)
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        id_col, number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), number(3).alias("n_random"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with each span of secrets (overlapping ones as one) replaced by ``mask``; null texts stay null."""
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    found = scan(docs.select(row.alias("row"), F.col(text_col).alias("text")), id_col="row", keep_text=True)

    def rewritten(chunk, i):
        at, end = i * CHUNK, (i + 1) * CHUNK
        own = F.filter("found", lambda x: (x["start"] < end) & (x["end"] > at))

        def step(acc, x):
            start = F.greatest(x["start"] - at, F.lit(0))
            before = F.concat(acc["out"], F.substring(chunk, acc["at"] + 1, start - acc["at"]))
            # one that began in the chunk before has its mask there
            masked = F.concat(before, F.when(x["start"] >= at, F.lit(mask)).otherwise(F.lit("")))
            return F.struct(F.when(start >= acc["at"], masked).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"] - at).alias("at"))

        none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(own, none, step, lambda acc: F.concat(acc["out"], F.call_function("substring", chunk, acc["at"] + 1)))

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    old = F.col(f"row.c{docs.columns.index(text_col)}")
    new = F.when(F.size("found") > 0, F.array_join(F.transform(chunks, rewritten), "")).otherwise(old)
    return found.select(*((new if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
