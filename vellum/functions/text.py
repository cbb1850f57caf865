"""Text keys, paths and labels as Column functions."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Articles that sorting passes over, and apostrophes that keys drop.
ARTICLES = ["the", "a", "an", "le", "la", "les", "un", "une", "des", "l"]
APOSTROPHES = "'’`"


def once(f, *values: Column) -> Column:
    """``f`` of the values, each worked out once for a row however often ``f`` uses it."""
    row = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.get(F.transform(F.array(row), lambda x: f(*(x[f"v{i}"] for i in range(len(values))))), F.lit(0))


def _bases() -> tuple[str, str]:
    """Precomposed letters of all scripts and their bases, by decomposition."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x10000)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _bases()


def strip_diacritics(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), "[\\u0300-\\u036f]", "")


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title_key(x: Column) -> Column:
    """Key of a title: no accents, case, apostrophes or punctuation; ``&`` is a word."""
    low = F.lower(strip_diacritics(x))
    words = F.replace(F.translate(low, APOSTROPHES, ""), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))


def sort_title(x: Column) -> Column:
    key = title_key(x)
    bare = F.regexp_replace(key, f"^(?:{'|'.join(ARTICLES)})\\s+", "")
    return F.when(bare == "", key).otherwise(bare)


def contains_all_words(key: Column, wanted: str) -> Column:
    """Whether ``key`` contains each word of the search text ``wanted`` (already a key)."""
    hit = F.lit(True)
    for word in wanted.split():
        hit = hit & F.contains(key, F.lit(word))
    return hit


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_diacritics(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def word_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the shares of words that two keys have in common."""
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: w != ""))
    x, y = words(a), words(b)
    shared = F.size(F.array_intersect(x, y))
    p, r = shared / F.size(x), shared / F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (shared == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def title_variants(x: Column) -> Column:
    """The key with apostrophes dropped, and with them as spaces."""
    return F.array_distinct(F.array(title_key(x), title_key(F.translate(x, APOSTROPHES, " " * len(APOSTROPHES)))))


def title_similarity(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(title_variants(a), lambda x: F.transform(title_variants(b), lambda y: word_f1(x, y))))
    return F.array_max(pairs)


def path_segments(path: Column) -> Column:
    """Non-empty segments, either separator."""
    return F.filter(F.split(path, r"[\\/]+"), lambda s: s != "")


def split_extension(name: Column) -> Column:
    """Struct of base and lower-case extension with its dot; a dot at the start begins none."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.struct(F.substring(name, F.lit(1), F.length(name) - F.length(ext)).alias("base"), F.lower(ext).alias("extension"))


def human_bytes(n: Column) -> Column:
    """Bytes in decimal units with one digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((3, "kB"), (6, "MB"), (9, "GB"), (12, "TB")):
        out = F.when(n >= 10**power, F.concat((F.floor(n / 10 ** (power - 1) + 0.5) / 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio_of(position: Column, duration: Column) -> Column:
    """Progress from 0 to 1; 0 where either is unknown or not positive."""
    return F.when((duration > 0) & (position > 0), F.least(F.lit(1.0), position / duration)).otherwise(F.lit(0.0))


def byte_range(header: Column, size: Column) -> Column:
    """A range header against a size: struct of kind (full, partial, unsatisfiable), start, end."""
    one = F.regexp_extract(F.lower(F.trim(header)), r"^bytes=([^,]*)$", 1)
    spec = F.trim(one)
    first = F.regexp_extract(spec, r"^(\d*)\s*-\s*(\d*)$", 1)
    last = F.regexp_extract(spec, r"^(\d*)\s*-\s*(\d*)$", 2)
    readable = F.coalesce(spec.rlike(r"^(\d+\s*-\s*\d*|-\s*\d+)$"), F.lit(False))
    dashed = F.coalesce(spec.contains("-"), F.lit(False))
    start, end = F.expr("cast(null as bigint)"), F.expr("cast(null as bigint)")
    first_n, last_n = F.try_to_number(first, F.lit("9" * 18)).cast("long"), F.try_to_number(last, F.lit("9" * 18)).cast("long")
    suffix = first == ""
    bad = (suffix & (last_n == 0)) | (~suffix & (first_n >= size)) | (~suffix & (last != "") & (last_n < first_n))
    kind = F.when(~dashed, "full").when(size == 0, "unsatisfiable").when(~readable, "full").when(bad, "unsatisfiable").otherwise("partial")
    start = F.when(suffix, F.greatest(F.lit(0).cast("long"), size - last_n)).otherwise(first_n)
    end = F.when(suffix | (last == ""), size - 1).otherwise(F.least(last_n, size - 1))
    partial = kind == "partial"
    return F.struct(kind.alias("kind"), F.when(partial, start).alias("start"), F.when(partial, end).alias("end"))


def joined_list(items: Column, last: str = " and ") -> Column:
    """``a, b and c``."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(items, -1)))


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Accents composed; Spark has no function for it. A batch at a time, and texts of ASCII alone are left as they are."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def path_key(x: Column) -> Column:
    """Key of a path: the same for composed and decomposed accents and for either case."""
    return F.lower(nfc(x))


#: Domains and names of release sites that file names carry.
SITE_DOMAINS = ["com", "net", "org", "info", "biz", "club", "site", "link", "online", "xyz", "art", "tv", "cc", "io", "co", "me", "to", "ws", "st", "sx", "nz", "eu", "fr", "be", "ch", "ca", "ru"]
SITES = ["darkino", "tirexo", "wawacity", "zone-telechargement", "zone telechargement", "extreme-download", "annuaire-telechargement", "oxtorrent", "cpasbien", "yggtorrent", "torrent9", "gktorrent", "rarbg", "yts", "ettv", "eztv"]


def strip_release_sites(name: Column) -> Column:
    """A file name without the marks of release sites: ``word.domain-1234-`` anywhere, known sites at either end."""
    domain, site = "|".join(SITE_DOMAINS), "|".join(SITES)
    known = rf"(?:www\d*[\s.])?(?:{site})(?:[\s.](?:{domain}))?"
    out = F.regexp_replace(name, rf"(?iu)(?:^|[\s._-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*[\s.](?:{domain})\s*-\s*\d{{2,}}\s*-\s*", " ")
    return collapse_spaces(F.regexp_replace(out, rf"(?iu)^\s*{known}\s*[-_.]?\s*|[\s._-]+{known}\s*$", " "))


#: The least length of a first sentence, the limit of a short synopsis, where and from which share on it may be cut.
LEAST_SENTENCE, SHORT, SOFT_BREAKS, SECOND_HALF = 25, 150, ",;:—–", 0.55


def whole_sentence(text: Column) -> Column:
    """The first sentence that is long enough, or the whole text."""
    clean = collapse_spaces(text)
    found = F.regexp_extract(clean, rf"^(.{{{LEAST_SENTENCE - 1},}}?[.!?…](?![.!?…])(?= |$))", 1)
    return F.when(found != "", found).otherwise(clean)


def short_synopsis(text: Column, limit: int = SHORT) -> Column:
    """The first sentence, cut at a break in its later part or else between words where it is longer than ``limit``; null if empty."""
    sentence = whole_sentence(text)
    window = F.substring(sentence, 1, limit)
    last = lambda c: F.length(window) - F.instr(F.reverse(window), c)  # noqa: E731  the place of the last one, from 0
    least = math.ceil(limit * SECOND_HALF)
    soft = F.greatest(*(F.when(F.instr(window, c) > 0, last(c)).otherwise(-1) for c in SOFT_BREAKS))
    cut = F.when(soft >= least, soft).when(F.instr(window, " ") > 0, last(" ")).otherwise(F.length(window))
    ended = F.concat(F.regexp_replace(F.substring(window, F.lit(1), cut), r"[\s.,;:!?—–]+$", ""), F.lit("…"))
    return F.when(sentence == "", None).when(F.length(sentence) <= limit, sentence).otherwise(ended)


def non_blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_translation(translations: Column, languages: list[str]) -> Column:
    """The first non-blank ``overview`` of ``translations`` (language, overview), by the order of ``languages``."""
    def told(language):
        own = F.filter(translations, lambda x: x["language"] == language)
        return F.get(F.filter(F.transform(own, lambda x: non_blank(x["overview"])), lambda x: x.isNotNull()), F.lit(0))

    return F.coalesce(*map(told, languages))


def positive_number(x: Column) -> Column:
    """A positive whole number that a double holds exactly, from text; else null."""
    n = F.when(x.rlike(r"^\s*\d{1,16}\s*$"), F.trim(x).cast("long"))
    return F.when((n > 0) & (n <= (1 << 53) - 1), n)


def finite_number(x: Column) -> Column:
    """A finite number that isn't negative, from text; else null. A blank text counts as 0."""
    plain = F.trim(x)
    n = F.when(plain == "", F.lit(0.0)).when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.cast("double"))
    return F.when((n >= 0) & (n < F.lit(float("inf"))), n)


def one_of(x: Column, allowed: list[str], default: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(default)


def image_set(kind: str, path: Column, sizes: dict[str, int]) -> Column:
    """The addresses of an image in each size, with its width."""
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.array_join(F.array(*(F.concat(F.lit(f"/images/{kind}/{size}"), rooted, F.lit(f" {w}w")) for size, w in sizes.items())), ", ")


def show_directory(directory: Column, root: Column, season: str) -> Column:
    """The directory above a season's folder, unless that is the root or above it."""
    parent, last = F.regexp_extract(directory, r"^(.*)[\\/][^\\/]*$", 1), F.regexp_extract(directory, r"([^\\/]*)$", 1)
    return F.when(last.rlike(season) & (F.length(parent) > F.length(root)), parent).otherwise(directory)


def review_key(x: Column) -> Column:
    """``movie-12`` or ``show-12`` as kind and id; else null."""
    found = lambda g: F.regexp_extract(x, r"^(movie|show)-(\d+)$", g)
    return F.when(found(1) != "", F.struct(found(1).alias("kind"), F.nullif(found(2), F.lit("")).cast("long").alias("id")))
