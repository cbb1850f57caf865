"""Titles of sound and subtitle tracks: what they tell beyond language and encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks in titles (pattern, label, family), in the order in which they are looked for.
MARKERS = [
    (r"\b(?:audio[- ]?description|AD)\b", "Audiodescription", "ad"),
    (r"\bVFF\b", "VFF", "vf"),
    (r"\bVFQ\b", "VFQ", "vf"),
    (r"\bVFI\b", "VFI", "vf"),
    (r"\bVFB?\b", "VF", "vf"),
    (r"\b(?:VO|VOST|original)\b", "VO", "vo"),
    (r"\bcommentaires?\b|\bcommentary\b", "Commentaires", "commentary"),
]
# Words that say nothing to a viewer: encodings, languages, kinds of subtitles, fillers.
TECHNICAL = [
    r"\b(?:aac|ac-?3|e-?ac-?3|eac3|dts(?:[- ]?hd)?(?:[- ]?ma)?|truehd|flac|mp3|opus|vorbis|pcm|lpcm|atmos|dd\+?|ddp?)\b",
    r"\b(?:srt|subrip|ass|ssa|webvtt|vtt|pgs|sup|vobsub|mov_text|sub)\b",
    r"\b(?:lc|he|hev1|main|stereo|surround|mono|multi)\b",
    r"@?\s*\d+\s*(?:kb/s|kbps|kbit/s|k)\b",
    r"\b\d\.\d\b",
    r"\b(?:\d+\s*bits?|\d+\s*ch(?:annels?)?|\d+\s*hz|\d+\s*khz)\b",
]
LANGUAGES = (
    r"\b(?:fran[çc]ais(?:e)?|french|anglais(?:e)?|english|japonais(?:e)?|japanese|jap|espagnol(?:e)?|spanish|allemand(?:e)?|german|italien(?:ne)?|italian|russe|russian"
    r"|ukrainien(?:ne)?|ukrainian|cor[ée]en(?:ne)?|korean|chinois(?:e)?|chinese|portugais(?:e)?|portuguese|n[ée]erlandais(?:e)?|dutch|arabe|arabic"
    r"|fre|fra|eng|jpn|spa|ger|deu|ita|rus|ukr|kor|chi|zho|por|nld|dut|ara|und|fr|en|ja|es|de|it|ru|uk|ko|zh|pt|nl|ar)\b"
)
KINDS = r"\b(?:forced|forc[ée]s?|full|complet(?:e|s)?|sdh|hi|cc|malentendants?)\b"
FILLERS = r"\b(?:subs?|subtitles?|sous[- ]?titres?|piste|track|audio|version|france|vost(?:fr)?)\b"
LONGEST, LEAST_LETTERS, LATIN_SHARE = 42, 3, 0.6


def plain_title(raw: Column) -> Column:
    """A title without the decorations around and in it."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[|*_~]+", " "), "[‐-―]", "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(F.trim(text), r"^[\s\-:,.()\[\]]+|[\s\-:,.()\[\]]+$", ""))


def informative_title(raw: Column) -> Column:
    """The plain title where it tells more than language, encoding and marks; else null. Long ones are cut."""
    clean = plain_title(raw)
    letters, latin = (F.length(F.regexp_replace(clean, p, "")) for p in (r"[^\p{L}]", r"[^\p{IsLatin}]|[^\p{L}]"))
    rest = clean
    for pattern, _, _ in MARKERS:
        rest = F.regexp_replace(rest, rf"^(.*?)(?i:{pattern})", "$1 ")  # the first hit of each
    for pattern in [*TECHNICAL, LANGUAGES, KINDS, FILLERS]:
        rest = F.regexp_replace(rest, f"(?i:{pattern})", " ")
    told = F.length(F.regexp_replace(rest, r"[^\p{L}]", "")) >= LEAST_LETTERS
    cut = F.concat(F.rtrim(F.substring(clean, 1, LONGEST - 1)), F.lit("…"))
    return F.when((letters > 0) & (latin >= letters * LATIN_SHARE) & told, F.when(F.length(clean) > LONGEST, cut).otherwise(clean))


def title_markers(raw: Column) -> Column:
    """Labels of the marks in a title, the first of each family."""
    clean = F.coalesce(plain_title(raw), F.lit(""))
    found, families = [], {}
    for pattern, label, family in MARKERS:
        hit = clean.rlike(f"(?i:{pattern})")
        before = families.get(family, F.lit(False))
        found.append(F.when(hit & ~before, label))
        families[family] = before | hit
    return F.filter(F.array(*found), lambda x: x.isNotNull())
