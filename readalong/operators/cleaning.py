"""Markup to speakable prose, as column functions: one pass over each document, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalong.functions.text import SPACE, let, lines, rstrip, sentence_end, strip, unix_lines
from readalong.operators.tables import speak_tables

#: Headings from which on a document is left out.  Fixed values.
SECTIONS = ("references?", "bibliography", r"works\s+cited", r"further\s+reading", "acknowledgements?", "appendix", "footnotes?")

#: (step, pattern, replacement) in the order of use.  Fixed values.
STEPS = (
    ("heading", r"(?Udm)^#{1,6}\s+", ""),
    ("rule", r"(?Udm)^[-*_]{3,}\s*$", ""),
    ("fence", r"```[\s\S]*?```", ""),
    ("code", r"`([^`\n]+)`", "$1"),
    ("image", r"(?d)!\[.*?\]\(.*?\)", ""),
    ("link", r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    ("star", r"\*{1,3}([^*\n]+)\*{1,3}", "$1"),
    ("underscore", r"_{1,3}([^_\n]+)_{1,3}", "$1"),
    ("br", r"(?Ui)<\s*br\s*/?\s*>", "\n"),
    ("tag", r"</?[^>]+>", ""),
)
#: Strings of which a text has one if a step changes it.
HINTS = {"heading": ("#",), "rule": ("---", "*", "_"), "fence": ("```",), "code": ("`",), "image": ("![",), "link": ("](",), "star": ("*",), "underscore": ("_",), "br": ("<",), "tag": ("<",)}
#: A list item, and how a text with one starts a line.  Fixed values.
ITEM = rf"(?d)^{SPACE}*(?:[-+*]|(?U)\d+(?-U)[.)]){SPACE}+(.+?){SPACE}*$"
ITEM_HINT = rf"(?dm)^{SPACE}*(?:[-+*]|(?U)\d+(?-U)[.)]){SPACE}"


def _changed(text: Column, hints: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` of a text that holds one of ``hints``; other texts as they are."""
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, [t.contains(h) for h in hints]), change(t)).otherwise(t))


def without_references(text: Column) -> Column:
    """Cut at the first line that holds nothing but a section word, which may be a heading."""
    return F.get(F.split(text, rf"(?Uimd)^(?:#{{1,6}}\s*)?(?:{'|'.join(SECTIONS)})\s*$", 2), F.lit(0))


def without_markup(text: Column, upto: str | None = None) -> Column:
    """Inline markup removed, step by step; ``upto`` names the last step."""
    for name, pattern, replacement in STEPS:
        text = _changed(text, HINTS[name], lambda t, p=pattern, r=replacement: F.regexp_replace(t, p, r))
        if name == upto:
            break
    return text


def speak_list_items(text: Column) -> Column:
    """List items lose their mark and end like a sentence; other lines stay as they are."""

    def line(raw: Column) -> Column:
        item = lambda r: F.when(r.rlike(ITEM), sentence_end(F.regexp_extract(r, ITEM, 1))).otherwise(raw)
        return F.when(raw.rlike(ITEM_HINT), let(rstrip(raw), item)).otherwise(raw)

    return let(unix_lines(text), lambda t: F.when(t.rlike(ITEM_HINT), F.array_join(F.transform(lines(t), line), "\n")).otherwise(t))


def normal_space(text: Column) -> Column:
    """At most one blank line, single spaces, no lines of white space, none at the ends."""
    text = _changed(text, ("\n\n\n",), lambda t: F.regexp_replace(t, "\n{3,}", "\n\n"))
    text = _changed(text, ("  ", "\t"), lambda t: F.regexp_replace(t, "[ \t]{2,}", " "))
    # white space after a line end; that at the very start goes with what is stripped
    blank = lambda t: F.when(t.rlike(rf"\n(?!\n){SPACE}"), F.regexp_replace(t, rf"(?dm)^{SPACE}+$", "")).otherwise(t)
    return strip(let(text, blank))


def clean(text: Column, remove_references: bool = True) -> Column:
    """The whole cleaner; empty where nothing speakable is left."""
    if remove_references:
        text = without_references(text)
    return normal_space(speak_list_items(speak_tables(without_markup(text))))


def clean_documents(docs: DataFrame, remove_references: bool = True) -> DataFrame:
    """``docs`` with ``clean_text`` and ``is_empty``; a null text is empty."""
    docs = docs.withColumn("clean_text", clean(F.coalesce("text", F.lit("")), remove_references))
    return docs.withColumn("is_empty", F.col("clean_text") == "")


def plain_html(html: Column) -> Column:
    """Line breaks kept, tags removed, white space normalised; contents of scripts and entities stay."""
    for name, pattern, replacement in STEPS[8:]:
        html = _changed(html, HINTS[name], lambda t, p=pattern, r=replacement: F.regexp_replace(t, p, r))
    return normal_space(html)
