"""Names of files and folders: titles, years, episodes, subtitle suffixes, as Column functions.

All is regular expressions and short folds over one row, so it stays in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .glued import segment
from .text import once, path_segments, split_extension, strip_diacritics, strip_release_sites

# Marks that can't be part of a title.
STRONG = [
    r"\d{3,4}p", r"\d{3,4}i", "4k", "uhd", "fullhd", "hdlight", "hqcam",
    "blu[-. ]?ray", "bdrip", "brrip", "bd[-. ]?remux", "bdmux", "bdmv", "remux", "web[-. ]?dl", "web[-. ]?rip", "webhd", "hdtv", "pdtv", "sdtv", "tvrip", "dvd[-. ]?rip", "dvd[-. ]?scr(?:eener)?", "dvdr[59]?", "dvd[59]", "vhsrip", "hdcam", "cam[-. ]?rip", "telesync", "telecine", "screener", "r5",
    "x[-. ]?26[45]", "h[-. ]?26[45]", "hevc", "avc", "xvid", "divx", "vp9", "av1", "mpeg[-. ]?[24]", "hi10p", "(?:8|10|12)[-. ]?bits?",
    "dts[-. ]?hd(?:[-. ]?ma)?", "dts[-. ]?x", "dts", "truehd", "atmos", "e?[-. ]?ac[-. ]?3", r"ddp?\+?[-. ]?[0-9][-. ][01]", "ddp", r"dd\+", "aac(?:[-. ]?[0-9][-. ][01])?", "flac", "lpcm", "[0-9][-. ][01]ch", "[0-9][-. ][01]",
    r"hdr10\+?", "hdr", "dolby[-. ]?vision", "dovi", "sdr",
    "vostfr", "vosta", "vost", "vf[fqib]?", "truefrench", "subfrench", "multi(?:lang(?:ue)?s?)?", "dual[-. ]?audio",
]
# Marks that end a title only if something stands before them.
WEAK = [
    "web", "vo", "french", "english", "mp3", "opus", "extended(?:[-. ]?cut)?", "director'?s?[-. ]?cut", "final[-. ]?cut", "theatrical(?:[-. ]?cut)?", "uncut", "unrated", "remaster(?:ed|is[ée]e?)?", "imax", "criterion", "int[ée]grale", "integrale", "proper", "repack", "readnfo", "internal", "limited", "complete",
]
# What is no title of an episode when it stands alone.
ALONE = r"(?i)^(?:final|fin|end|complete|complet|proper|repack|internal|limited|\d+)$"
# The markers of episodes, and the folders of seasons.
SEASON_EPISODE = r"(?iu)(?<![\p{L}\p{N}])(?:saison|season|s)[ ._-]*(\d{1,2})[ ._-]*(?:épisode|episode|ep|e)[ ._-]*(\d{1,3})(?:[ ._-]*[-–][ ._-]*(?:s\d{1,2}[ ._-]*)?(?:épisode|episode|ep|e)?[ ._-]*(\d{1,3})|(?:épisode|episode|ep|e)(\d{1,3}))?(?!\d)"
X_FORMAT = r"(?iu)(?<![\p{L}\p{N}])(\d{1,2})x(\d{1,3})(?:[ ._-]*[-–][ ._-]*(?:\d{1,2}x)?(\d{1,3}))?(?![\p{L}\p{N}])"
EPISODE_ONLY = r"(?iu)(?<![\p{L}\p{N}])(?:épisode|episode|ep|e)[ ._-]*(\d{1,3})(?:[ ._-]*[-–][ ._-]*(?:épisode|episode|ep|e)?[ ._-]*(\d{1,3}))?(?![\p{L}\p{N}])"
LEADING_NUMBER = r"^[ ._-]*(\d{1,3})(?![\p{L}\p{N}])"
SEASON_FOLDER = r"(?iu)^(?:saison|season|series|s[ée]rie|s)[ ._-]*(\d{1,3})$"
SPECIALS_FOLDER = r"(?iu)^(?:specials?|sp[ée]ciaux|sp[ée]cial|hors[ ._-]*s[ée]rie)$"
TRAILING_SEASON = r"(?iu)[ ._-]+(?:s\d{1,2}|saison[ ._-]*\d{1,2}|season[ ._-]*\d{1,2}|int[ée]grale|complete|complet)$"
LONGEST_RANGE = 8
MIN_YEAR, MAX_YEAR = 1888, 2100
# Aliases of languages in subtitle names, and the marks of forced and descriptive ones.
LANGUAGE_ALIASES = {
    "fr": ["fr", "fra", "fre", "french", "francais", "vf", "vff", "vfq", "vostfr", "truefrench", "subfrench"], "en": ["en", "eng", "english", "anglais"], "es": ["es", "spa", "esp", "spanish", "espagnol"], "de": ["de", "ger", "deu", "german", "allemand"],
    "it": ["it", "ita", "italian", "italien"], "pt": ["pt", "por", "portuguese", "ptbr"], "nl": ["nl", "dut", "nld", "dutch"], "ja": ["ja", "jpn", "jap", "japanese", "japonais"], "zh": ["zh", "chi", "zho", "chinese"], "ko": ["ko", "kor", "korean"], "ru": ["ru", "rus", "russian"],
    "ar": ["ar", "ara", "arabic"], "pl": ["pl", "pol"], "tr": ["tr", "tur"], "sv": ["sv", "swe"], "da": ["da", "dan"], "no": ["no", "nor"], "fi": ["fi", "fin"], "cs": ["cs", "cze", "ces"], "hu": ["hu", "hun"], "el": ["el", "gre", "ell"], "he": ["he", "heb"], "ro": ["ro", "ron", "rum"],
}
FORCED = ["forced", "force", "forces"]
DESCRIPTIVE = ["sdh", "cc", "hi", "sourds", "malentendants"]


def _whole(patterns: list[str]) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(patterns)})(?![\p{{L}}\p{{N}}])"


def separators_to_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[._]+", " "), r"\s+", " "))


def trim_junk(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[\s._\-–—(\[{]+", ""), r"[\s._\-–—)\]}]+$", "")


def without_blocks(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", " "), r"\{[^}]*\}", " ")


def is_only_noise(x: Column) -> Column:
    """Whether nothing but marks is left of a text: it is empty, or begins with a mark that can't be part of a title."""
    return once(lambda plain: (plain == "") | (F.regexp_instr(plain, F.lit(_whole(STRONG))) == 1), trim_junk(separators_to_spaces(without_blocks(x))))


def is_meaningless_title(x: Column) -> Column:
    """Whether a title of an episode is empty, a number, or a word that is none alone."""
    return once(lambda plain: (plain == "") | plain.rlike(ALONE), trim_junk(x))


def prepare_name(name: Column) -> Column:
    """A name without marks of release sites and blocks, its glued words told apart; years and marks of noise show only then."""
    blocks = F.regexp_replace(F.regexp_replace(strip_release_sites(name), r"\[(?!\d{4}\])[^\]]*\]", " "), r"\{[^}]*\}", " ")
    return segment(blocks)


def noise_cut(x: Column) -> Column:
    """Characters before the first mark; null if there is none. A weak mark at the start is none."""
    strong = F.nullif(F.regexp_instr(x, F.lit(_whole(STRONG))), F.lit(0)) - 1
    weak = F.regexp_instr(x, F.lit(_whole(WEAK))) - 1
    return F.least(strong, F.when(weak > 0, weak))


def positions(x: Column, pattern: str) -> Column:
    """Where the pattern's matches start (from 0), with their text: a fold, since a match starts where its text next occurs."""
    start = F.expr("named_struct('at', 1, 'out', cast(array() as array<struct<at:int,found:string>>))")

    def step(acc, m):
        at = F.call_function("locate", m, x, acc["at"])
        return F.struct((at + F.length(m)).alias("at"), F.array_append(acc["out"], F.struct((at - 1).alias("at"), m.alias("found"))).alias("out"))

    return F.aggregate(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), start, step, lambda acc: acc["out"])


def _until_noise(plain: Column) -> Column:
    return trim_junk(F.left(plain, F.coalesce(noise_cut(plain), F.length(plain))))


def clean_title(x: Column, cut: bool = False) -> Column:
    plain = separators_to_spaces(without_blocks(x))
    return once(_until_noise, plain) if cut else trim_junk(plain)


def title_and_year(name: Column, min_year: int = MIN_YEAR, max_year: int = MAX_YEAR) -> Column:
    """Struct of title ("" if none) and year: a year in brackets first, else the first year with a title before it."""
    title_year = lambda title, year: F.struct(title.alias("title"), year.alias("year"))
    in_range = lambda x: (x["year"] >= min_year) & (x["year"] <= max_year) & (x["title"] != "")
    first = lambda found: F.get(F.filter(found, in_range), F.lit(0))

    def choose(source, plain, cut):
        bracketed = F.transform(positions(source, r"[(\[]\d{4}[)\]]"), lambda m: title_year(clean_title(F.left(source, m["at"])), F.substring(m["found"], 2, 4).cast("int")))
        alone = F.transform(positions(plain, r"(?<![\p{L}\p{N}])\d{4}(?![\p{L}\p{N}])"), lambda m: title_year(trim_junk(F.left(plain, F.least(cut, m["at"]))), m["found"].cast("int")))
        return F.coalesce(first(bracketed), first(alone), title_year(trim_junk(F.left(plain, cut)), F.lit(None).cast("int")))

    def with_cut(source, plain):
        return once(choose, source, plain, F.coalesce(noise_cut(plain), F.length(plain)))

    return once(lambda source: once(with_cut, source, separators_to_spaces(without_blocks(source))), prepare_name(name))


def parse_movie(path: Column, max_year: int = MAX_YEAR) -> Column:
    """Struct of title, year and source (folder, file); null if there is no title. A folder counts first only with a year."""
    made = lambda title, year, source: F.struct(title.alias("title"), year.alias("year"), F.lit(source).alias("source"))

    def choose(file, folder):
        return (
            F.when((folder["title"] != "") & folder["year"].isNotNull(), made(folder["title"], folder["year"], "folder")).when(file["title"] != "", made(file["title"], F.coalesce(file["year"], folder["year"]), "file"))
            .when(folder["title"] != "", made(folder["title"], folder["year"], "folder"))
        )

    def of(segments):
        file = title_and_year(split_extension(F.element_at(segments, -1))["base"], max_year=max_year)
        return once(choose, file, F.when(F.size(segments) > 1, title_and_year(F.try_element_at(segments, F.lit(-2)), max_year=max_year)))

    return once(of, path_segments(path))


def _marker(base: Column, pattern: str, season: int | None, episode: int, ends: tuple[int, ...], short: str) -> Column:
    number = lambda i: F.nullif(F.regexp_extract(base, pattern, i), F.lit("")).cast("int")

    def range_of(found, first, last):
        kept = F.when((last > first) & (last - first <= LONGEST_RANGE), last)
        start = F.regexp_instr(base, F.lit(pattern)) - 1
        end = start + F.when(kept.isNotNull(), F.length(found)).otherwise(F.length(F.regexp_extract(found, short, 0)))
        own = number(season) if season else F.lit(None).cast("int")
        return F.when(found != "", F.struct(own.alias("season"), first.alias("first"), kept.alias("last"), start.alias("start"), end.alias("end")))

    last = F.coalesce(*(number(i) for i in ends)) if ends else F.lit(None).cast("int")
    return once(range_of, F.regexp_extract(base, pattern, 0), number(episode), last)


def episode_marker(base: Column, in_season: Column) -> Column:
    """Struct of season, first, last, start, end; the last two patterns only in a season's folder."""
    head = lambda p, end: p[: p.index(end) + len(end)]
    anchored = lambda p: "(?iu)^" + p.removeprefix("(?iu)").removeprefix(r"(?<![\p{L}\p{N}])")
    return F.coalesce(
        _marker(base, SEASON_EPISODE, 1, 2, (3, 4), anchored(head(SEASON_EPISODE, r"[ ._-]*(\d{1,3})"))),
        _marker(base, X_FORMAT, 1, 2, (3,), anchored(head(X_FORMAT, r"x(\d{1,3})"))),
        F.when(in_season, _marker(base, EPISODE_ONLY, None, 1, (2,), anchored(head(EPISODE_ONLY, r"[ ._-]*(\d{1,3})")))),
        F.when(in_season, _marker(base, LEADING_NUMBER, None, 1, (), LEADING_NUMBER)),
    )


def parse_episode(path: Column, max_year: int = MAX_YEAR) -> Column:
    """Struct of show, show_year, season, first, last, title and source; null if there is no number or no title."""
    bare = lambda x: title_and_year(F.regexp_replace(x, TRAILING_SEASON, ""), max_year=max_year)

    def made(marker, season, folder, prefix, rest):
        from_folder = F.coalesce(folder["title"] != "", F.lit(False))
        show = F.when(from_folder, folder).otherwise(prefix)
        noise = is_only_noise(rest)
        named = once(lambda title: F.when(~noise & ~is_meaningless_title(title), title), clean_title(rest, cut=True))
        return F.when(
            marker.isNotNull() & season.isNotNull() & (show["title"] != ""),
            F.struct(show["title"].alias("show"), show["year"].alias("show_year"), season.alias("season"), marker["first"].alias("first"), marker["last"].alias("last"), named.alias("title"), F.when(from_folder, "folder").otherwise("file").alias("source")),
        )

    def with_marker(base, folders, deepest, marker):
        show_at = F.coalesce(deepest["at"], F.size(folders)) - 1
        folder = F.when(show_at >= 0, bare(F.get(folders, show_at)))
        return once(made, marker, F.coalesce(marker["season"], deepest["season"]), folder, bare(F.left(base, marker["start"])), F.call_function("substr", base, marker["end"] + 1))

    def with_season(base, folders, deepest):
        return once(with_marker, base, folders, deepest, episode_marker(base, deepest.isNotNull()))

    def with_folders(base, folders):
        numbered = F.transform(folders, lambda x, i: F.struct(i.alias("at"), F.when(x.rlike(SEASON_FOLDER), F.regexp_extract(x, SEASON_FOLDER, 1).cast("int")).when(x.rlike(SPECIALS_FOLDER), 0).alias("season")))
        return once(with_season, base, folders, F.get(F.reverse(F.filter(numbered, lambda x: x["season"].isNotNull())), F.lit(0)))

    def of(segments):
        return once(with_folders, split_extension(F.element_at(segments, -1))["base"], F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))))

    return once(of, path_segments(path))


def parse_path(path: Column, kind: Column, max_year: int = MAX_YEAR) -> Column:
    """By the kind of collection, a struct of kind (movie, episode, unknown) with what was found."""

    def made(movie, episode):
        return F.struct(F.when(movie.isNotNull(), "movie").when(episode.isNotNull(), "episode").otherwise("unknown").alias("kind"), movie.alias("movie"), episode.alias("episode"))

    return once(made, F.when(kind == "movie", parse_movie(path, max_year)), F.when(kind == "show", parse_episode(path, max_year)))


def parse_subtitle(name: Column, video: Column | None = None) -> Column:
    """Struct of language, forced and descriptive from what a name adds to its video's, else from its last three words."""
    base = split_extension(name)["base"]
    words = lambda x: F.filter(F.split(F.lower(strip_diacritics(x)), "[^a-z0-9]+"), lambda w: w != "")
    own = words(base)
    tail = F.slice(own, F.greatest(F.size(own) - 2, F.lit(1)), F.lit(3))
    if video is not None:
        other = split_extension(video)["base"]
        tail = F.when((other != "") & F.lower(base).startswith(F.lower(other)), words(F.call_function("substr", base, F.length(other) + 1))).otherwise(tail)
    known = F.create_map(*(F.lit(x) for code, aliases in LANGUAGE_ALIASES.items() for a in aliases for x in (a, code)))
    language = F.get(F.filter(F.transform(F.reverse(tail), lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(language.alias("language"), F.exists(tail, lambda w: w.isin(FORCED)).alias("forced"), F.exists(tail, lambda w: w.isin(DESCRIPTIVE)).alias("descriptive"))
