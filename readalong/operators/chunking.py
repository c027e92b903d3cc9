"""Clean prose to chunks of bounded size: paragraphs, sentences, greedy packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalong.functions.text import LINE_END, SPACE, let, strip, words

#: Longest chunk: the chunk size and a fixed allowance.
CHUNK_SIZE, ALLOWANCE = 400, 200


#: Between two paragraphs.
BLANK = rf"\n{SPACE}*\n+"
#: Stands between sentences while they are told apart; a text that holds it is split the slow way.
MARK = "\x01"
#: Stands before a letter for a MARK, or for itself, in texts that hold one.
ESCAPE = "\x02"


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, stripped, none empty."""
    return F.filter(F.transform(F.split(text, BLANK), strip), lambda b: b != "")


def flat(block: Column) -> Column:
    """A block's stripped lines joined by single spaces."""
    return F.array_join(F.filter(F.transform(F.split(block, LINE_END), strip), lambda x: x != ""), " ")


def looks_like_heading(block: Column) -> Column:
    """At most 120 characters and 14 words, some, and no ``. ! ? :`` at the end."""
    short = (F.length(block) <= 120) & ~F.right(block, F.lit(1)).isin(".", "!", "?", ":")
    return short & F.size(words(block)).between(1, 14)


def _split_after(text: Column, marks: str) -> Column:
    """Parts that end in one of ``marks`` and white space, without that space."""
    fast = lambda t: F.split(F.regexp_replace(t, rf"([{marks}]){SPACE}+", f"$1{MARK}"), MARK)
    return let(text, lambda t: F.when(t.contains(MARK), F.split(t, rf"(?<=[{marks}]){SPACE}+")).otherwise(fast(t)))


def sentences(block: Column) -> Column:
    """Parts of a stripped block that end in ``. ! ?`` and white space, stripped; abbreviations are not known, unlike in a trained splitter."""
    return F.filter(_split_after(block, ".!?"), lambda s: s != "")


#: Parts that one inner fold goes over.
FOLD = 256


def _packed(parts: Column, most: int) -> Column:
    """Units of (text, n, long, first) parts, joined by single spaces, in order.

    Greedy: a unit is closed when the next part and a space would pass ``most``.  Clauses of a long sentence
    are ``long``, the first of them also ``first``: they are packed on their own.

    A fold's state is copied at every step, so it holds no texts: only a mark for each part, 1 where a unit
    starts, and the unit's size.  An inner fold goes over a few hundred parts, an outer one over those runs.
    """
    state = lambda bits, size, long: F.struct(bits.alias("bits"), size.alias("size"), long.alias("long"))

    def step(s: Column, part: Column) -> Column:
        n = part["n"]
        opens = (s["size"] < 0) | (s["long"] != part["long"]) | part["first"] | (s["size"] + n + 1 > most)
        return let(opens, lambda o: state(F.concat(s["bits"], F.when(o, "1").otherwise("0")), F.when(o, n + 1).otherwise(s["size"] + n + 1), part["long"]))

    def run(s: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(parts, at + 1, FOLD), state(F.lit(""), s["size"], s["long"]), step)
        return let(inner, lambda i: state(F.concat(s["bits"], i["bits"]), i["size"], i["long"]))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int")), lambda k: k * FOLD)
    bits = F.aggregate(runs, state(F.lit(""), F.lit(-1), F.lit(False)), run, lambda s: F.regexp_extract_all(s["bits"], F.lit("."), F.lit(0)))
    spaced = F.zip_with(parts, bits, lambda p, b: F.concat(F.when(b == "1", MARK).otherwise(" "), p["text"]))
    units = let(F.split(F.array_join(spaced, ""), MARK), lambda u: F.slice(u, F.lit(2), F.size(u) - 1))
    plain = lambda u: F.when(u.contains(ESCAPE), F.replace(F.replace(u, F.lit(f"{ESCAPE}a"), F.lit(MARK)), F.lit(f"{ESCAPE}b"), F.lit(ESCAPE))).otherwise(u)
    return F.when(F.size(parts) > 0, F.transform(units, plain)).otherwise(F.array().cast("array<string>"))


def _part(text: Column, long: bool, first: Column) -> Column:
    """A part whose text holds no MARK, its length before that, and where it comes from."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(MARK), F.lit(f"{ESCAPE}a"))
    marked = F.when(text.contains(MARK) | text.contains(ESCAPE), escaped).otherwise(text)
    return F.struct(marked.alias("text"), F.length(text).alias("n"), F.lit(long).alias("long"), first.alias("first"))


def _short_parts(texts: Column) -> Column:
    return F.transform(texts, lambda t: _part(t, False, F.lit(False)))


def clauses(sentence: Column, most: int) -> Column:
    """A long sentence's clauses, packed; a clause longer than ``most`` stays whole."""
    return let(_short_parts(_split_after(sentence, ";,")), lambda p: _packed(p, most))


def _parts(texts: Column, most: int) -> Column:
    """Sentences as parts; those longer than ``most`` as their clauses."""
    long = lambda t: F.transform(_split_after(t, ";,"), lambda c, k: _part(c, True, k == 0))
    return F.flatten(F.transform(texts, lambda t: F.when(F.length(t) > most, long(t)).otherwise(F.array(_part(t, False, F.lit(False))))))


def units(text: Column, most: int = CHUNK_SIZE + ALLOWANCE, split: Callable[[Column], Column] = sentences) -> Column:
    """Chunks of a text, in order; none spans two paragraphs.

    ``split`` makes sentences of a block; a trained splitter may stand in as a Pandas UDF.
    """

    def packed(f: Column) -> Column:
        headed = F.when(looks_like_heading(f), F.concat(f, F.lit("."))).otherwise(f)
        return let(headed, lambda h: F.when(F.length(h) < most, _short(h, split)).otherwise(let(_parts(split(h), most), lambda p: _packed(p, most))))

    # lines are stripped as they are joined, so blocks need not be; parts of stripped blocks are stripped
    return F.flatten(F.transform(F.split(text, BLANK), lambda b: let(flat(b), packed)))


def _short(block: Column, split: Callable[[Column], Column]) -> Column:
    """The chunk of a block that is shorter than the longest chunk: its sentences joined by single spaces."""
    return F.when(block == "", F.array().cast("array<string>")).otherwise(F.array(F.array_join(split(block), " ")))


def chunk_documents(docs: DataFrame, text: str = "text", most: int = CHUNK_SIZE + ALLOWANCE, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """(doc_id, chunk_index, text): one row for each chunk; texts without prose have none."""
    return docs.select("doc_id", F.posexplode(units(F.coalesce(text, F.lit("")), most, split)).alias("chunk_index", "text"))
