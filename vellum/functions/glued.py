"""Words written in one piece, told apart again: ``TheLordoftheRings`` is *The Lord of the Rings*.

Capitals and digits tell most words apart. Function words in lower case stick to the word
before them and are peeled off its end, the longest first. Where what comes out doesn't look
like words, the piece stays as it was. All is Column functions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Function words, English and French, that may be glued to a word.
FUNCTION_WORDS = ["of", "the", "and", "to", "in", "on", "at", "for", "with", "from", "a", "an", "de", "des", "du", "la", "le", "les", "un", "une", "et", "au", "aux", "dans", "sur", "par"]
# The least length and the least number of inner capitals of a glued piece; the least length of a piece that is
# peeled, of what must be left, the most that may be left, and how many function words are peeled off one piece.
GLUED_LENGTH, GLUED_CAPITALS, PEELED_LENGTH, STEM_LENGTH, LONGEST_STEM, PEELS = 12, 2, 8, 3, 14, 4


def _peel(least: int) -> str:
    """A stem, as short as may be, with a function word of ``least`` letters or more behind it."""
    return rf"(?is)^(.{{{STEM_LENGTH},}}?)({'|'.join(w for w in FUNCTION_WORDS if len(w) >= least)})$"


def looks_glued(piece: Column) -> Column:
    """Whether a piece is long, without separators and with capitals inside."""
    capitals = F.length(F.regexp_replace(F.substring(piece, F.lit(2), F.length(piece)), "[^A-Z]", ""))
    return (F.length(piece) >= GLUED_LENGTH) & ~piece.rlike(r"[\s._]") & (capitals >= GLUED_CAPITALS)


def split_transitions(piece: Column) -> Column:
    """Pieces where letters change to capitals and digits, and back. A capital starts a word after capitals only if two small letters follow."""
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll}{2,})", r"(\p{L})([0-9])", r"([0-9])(\p{Lu})"):
        piece = F.regexp_replace(piece, pattern, "$1 $2")
    return F.filter(F.split(piece, " "), lambda x: x != "")


def peel_function_words(piece: Column) -> Column:
    """A piece as its stem and the function words at its end. The first one peeled has three letters or more, since
    shorter ones are common endings; once it is found, the others are believed."""
    start = F.struct(piece.alias("stem"), F.expr("cast(array() as array<string>)").alias("off"), F.lit(True).alias("on"))

    def step(acc, n):
        # a constant pattern for each place, so that none is compiled anew for a row; no function word is empty
        def taken(word):
            stem = F.when(n == 0, F.regexp_extract(acc["stem"], _peel(3), 1)).otherwise(F.regexp_extract(acc["stem"], _peel(2), 1))
            return F.when(word != "", F.struct(stem.alias("stem"), F.concat(F.array(word), acc["off"]).alias("off"), F.lit(True).alias("on"))).otherwise(F.struct(acc["stem"].alias("stem"), acc["off"].alias("off"), F.lit(False).alias("on")))

        found = once(taken, F.when(n == 0, F.regexp_extract(acc["stem"], _peel(3), 2)).otherwise(F.regexp_extract(acc["stem"], _peel(2), 2)))
        return F.when(acc["on"], found).otherwise(acc)

    peeled = F.aggregate(F.array(*map(F.lit, range(PEELS))), start, step, lambda acc: F.when((F.size(acc["off"]) > 0) & (F.length(acc["stem"]) <= LONGEST_STEM), F.concat(F.array(acc["stem"]), acc["off"])))
    return F.when(F.length(piece) >= PEELED_LENGTH, F.coalesce(peeled, F.array(piece))).otherwise(F.array(piece))


def looks_sane(pieces: Column) -> Column:
    """Whether no piece is a scrap: letters shorter than three are capitals or a function word."""
    return F.forall(pieces, lambda x: (F.length(x) > 2) | ~x.rlike(r"^\p{L}+$") | (x == F.upper(x)) | F.lower(x).isin(FUNCTION_WORDS))


def segment(name: Column) -> Column:
    """``name`` with glued pieces told apart and one space between all pieces; pieces that aren't glued stay as they are."""

    def of(piece):
        told = F.flatten(F.transform(split_transitions(piece), peel_function_words))
        kept = F.get(F.transform(F.array(told), lambda x: F.when(looks_sane(x), x)), F.lit(0))
        return F.when(looks_glued(piece), F.coalesce(kept, F.array(piece))).otherwise(F.array(piece))

    return F.array_join(F.flatten(F.transform(F.filter(F.split(name, r"[\s._]+"), lambda x: x != ""), of)), " ")
