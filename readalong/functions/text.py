"""Column functions on text, with the regex and white-space rules of Python's ``re`` and ``str``.

Java patterns get ``(?d)`` where ``.``, ``^`` or ``$`` must see only ``\\n`` as a line end, and ``(?U)`` where a
predefined class must be the Unicode one.  Whole texts are long and mostly plain: a function that rarely has
anything to do asks first whether it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's str.strip, as a character class.  Fixed values.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters one by one.
SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Line ends of Python's str.splitlines besides \r\n; those but \n.  Fixed values.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ODD_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    cut = lambda t: F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+\z", "")
    return let(text, lambda t: F.when(F.left(t, F.lit(1)).isin(SPACES) | F.right(t, F.lit(1)).isin(SPACES), cut(t)).otherwise(t))


def rstrip(text: Column) -> Column:
    """Without white space at the end."""
    return let(text, lambda t: F.when(F.right(t, F.lit(1)).isin(SPACES), F.regexp_replace(t, rf"{SPACE}+\z", "")).otherwise(t))


def lines(text: Column) -> Column:
    """The text's lines; a line end at the very end opens no further line, an empty text has none."""
    parts = let(text, lambda t: F.when(t.rlike(ODD_LINE_END), F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), LINE_END)).otherwise(F.split(t, "\n")))
    return let(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def unix_lines(text: Column) -> Column:
    """The text's lines joined by ``\\n``, without a line end at the very end."""
    plain = lambda t: F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t)
    return let(text, lambda t: F.when(t.rlike(ODD_LINE_END), F.array_join(lines(t), "\n")).otherwise(plain(t)))


def rounded(value: Column, places: int) -> Column:
    """Rounded half up, also where the binary value of a tie falls short of it."""
    return F.round(value + F.lit(1e-9), places)


def words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def sentence_end(text: Column) -> Column:
    """The stripped text with a full stop, unless it is empty or ends in ``. ! ? : ;``."""
    return let(strip(text), lambda t: F.when((t == "") | t.rlike(r"[.!?:;]\z"), t).otherwise(F.concat(t, F.lit("."))))


def normal_token(token: Column) -> Column:
    """Lower case, straight apostrophes, and nothing but a-z, 0-9 and apostrophes."""
    return F.regexp_replace(F.replace(F.lower(token), F.lit("’"), F.lit("'")), "[^a-z0-9']+", "")


def tokens(text: Column) -> Column:
    """Normalised ASCII word tokens, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9']+)"), F.lit(1)), normal_token), lambda t: t != "")


def fingerprint(text: Column) -> Column:
    """Lower case, digit runs and white space as single spaces, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\d+", " "), rf"{SPACE}+", " "))


def safe_filename(name: Column, fallback: Column) -> Column:
    """Runs of other characters than ``A-Za-z0-9._-`` as ``_``, no dots or underscores at the ends; ``fallback`` if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+\z", "")
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def metadata_path(path: Column) -> Column:
    """The companion path ``<stem>_meta.json``."""
    return F.regexp_replace(path, r"[.][^./]+\z", "_meta.json")


def is_pdf(mime: Column, name: Column) -> Column:
    """Accepted as PDF, by type or by name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def format_seconds(seconds: Column) -> Column:
    """``m:ss``; null, NaN and 0 are ``0:00``."""
    whole = F.when(seconds.isNull() | F.isnan(seconds), F.lit(0)).otherwise(F.floor(seconds))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """``value`` held between ``low`` and ``high``; ``low`` wins where they cross."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(as_column(high), value))
