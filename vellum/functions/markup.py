"""Markup of captions: style overrides of subtitle scripts as tags, and foreign tags cleared away.

Both read a text as tokens and fold over them; the open tags are a stack in the fold's
state. All is Column functions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# The tags that captions know, the colours they have as classes, and the styles that overrides switch.
CAPTION_TAGS = ["i", "b", "u", "ruby", "rt", "v", "lang", "c"]
CAPTION_COLOURS = ["white", "lime", "cyan", "red", "yellow", "magenta", "blue", "black"]
STYLES = r"^(?:[iu][01]|b\d+)$"

_STRINGS = "cast(array() as array<string>)"


def _tags(names: Column, form: str) -> Column:
    return F.array_join(F.transform(names, lambda x: F.format_string(form, x)), "")


def _override(state: Column, command: Column) -> Column:
    """``state`` (``out``, ``open``) after one command. A style that ends closes those above it, which open again."""
    made = lambda out, opened: F.struct(F.concat(state["out"], out).alias("out"), opened.alias("open"))

    def switched(style, on, at):
        below, above = F.slice(state["open"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(state["open"], at + 1, F.size(state["open"]))
        return (
            F.when(on & (at == 0), made(F.concat(F.lit("<"), style, F.lit(">")), F.array_append(state["open"], style)))
            .when(~on & (at > 0), made(F.concat(_tags(F.reverse(above), "</%s>"), F.lit("</"), style, F.lit(">"), _tags(above, "<%s>")), F.concat(below, above)))
            .otherwise(state)
        )

    style = F.left(command, F.lit(1))
    style_change = once(switched, style, ~F.substring(command, F.lit(2), F.length(command)).rlike("^0+$"), F.array_position(state["open"], style).cast("int"))
    return F.when(command.startswith("r"), made(_tags(F.reverse(state["open"]), "</%s>"), F.expr(_STRINGS))).when(command.rlike(STYLES), style_change).otherwise(state)


def overrides_to_tags(text: Column) -> Column:
    r"""The text of a cue with ``{\i1}``, ``{\u1}`` and ``{\b1}`` as tags, closed in order and at the end; null if nothing is
    left to show. Other overrides go, ``\N`` and ``\n`` end a line, ``\h`` is a space that doesn't break, markup
    characters are escaped, and drawings are no text. A brace that isn't closed is text."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tokens = F.regexp_extract_all(escaped, F.lit(r"(?s)\{[^}]*\}|[^{]+|\{.*"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.expr(_STRINGS).alias("open"))

    def step(state, token):
        block = token.rlike(r"(?s)^\{[^}]*\}$")
        commands = F.filter(F.split(F.substring(token, F.lit(2), F.length(token) - 2), r"\\"), lambda c: c != "")
        return F.when(block, F.aggregate(commands, state, _override)).otherwise(F.struct(F.concat(state["out"], token).alias("out"), state["open"].alias("open")))

    whole = F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], _tags(F.reverse(s["open"]), "</%s>")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\\[Nn]", "\n"), r"\\h", "\u00a0"), r"\\([{}])", "$1")
    blank = "[\\s\u00a0\ufeff]"
    lines = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, rf"^{blank}+|{blank}+$", ""))
    shown = F.regexp_replace(F.array_join(lines, "\n"), "^\\n+|\\n+$", "")
    return F.when(~text.rlike(r"\\p[1-9]"), once(lambda x: F.when(x != "", x), shown))


def clear_foreign_tags(text: Column) -> Column:
    r"""A caption's text without override blocks (``{\...}``) and without tags that captions don't know; fonts become
    classes, of their colour where captions have it. What the tags stood around stays."""

    def of(token):
        name = F.lower(F.regexp_extract(token, "^</?([a-zA-Z]+)[^>]*>$", 1))
        colour = F.lower(F.regexp_extract(F.regexp_extract(token, "^</?[a-zA-Z]+([^>]*)>$", 1), "color\\s*=\\s*[\"']?([a-zA-Z]+)[\"']?", 1))
        font = F.when(token.startswith("</"), "</c>").when(colour.isin(CAPTION_COLOURS), F.format_string("<c.%s>", colour)).otherwise("<c>")
        return F.when((name == "") | name.isin(CAPTION_TAGS), token).when(name == "font", font).otherwise("")

    plain = F.regexp_replace(text, r"\{\\[^}]*\}", "")
    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)</?[a-zA-Z]+[^>]*>|[^<]+|<"), F.lit(0)), of), "")


def clear_caption_document(document: Column) -> Column:
    """A caption document with all lines cleared but those of times."""
    lines = F.split(F.regexp_replace(F.regexp_replace(document, "^\ufeff", ""), r"\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("-->")), x).otherwise(clear_foreign_tags(x))), "\n")


def stamped_to_captions(document: Column) -> Column:
    """Numbered cues with times like ``00:01:02,500`` as a caption document; one that is one already stays so. Tags are cleared."""
    plain = F.regexp_replace(F.regexp_replace(document, "^\ufeff", ""), r"\r\n?", "\n")
    pointed = F.regexp_replace(F.regexp_replace(plain, r"(\d{1,3}:[0-5]\d:[0-5]\d),(\d{1,3})", "$1.$2"), r"^\s+", "")
    headed = F.when(plain.startswith("WEBVTT"), plain).otherwise(F.concat(F.lit("WEBVTT\n\n"), pointed))
    return clear_caption_document(headed)
