"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item may stand in a document with up to ``budget`` character edits.  Cut into budget + 1
pieces, at least one piece of it then stands there unchanged.  All pieces of a block of items go into one
Aho-Corasick automaton that reads each document once; around every hit, Myers' bit-parallel algorithm
finds the least edit distance between the whole item and any part of the neighbourhood.  Short items have
no edits and must stand as whole words.

Items are sent to the executors in blocks of a fixed size, so that a benchmark of any size takes more
passes and not more memory.  Documents never move.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from readalong.llm.common import arrow_map, slices, text_of

#: Characters of an item for each edit that it may have.
CHARS_PER_EDIT = 16
#: Items with fewer characters, after folding, count only unchanged and between word boundaries.
LEAST_CHARS = 24
#: Characters of scripts that write words without spaces or join particles to them (Thai to Myanmar, Khmer, Han, kana, Hangul): every place is a boundary.
UNSPACED = re.compile("[\u0e00-\u109f\u1100-\u11ff\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff]")
#: UTF-8 bytes of items in one block.
BLOCK_BYTES = 4 << 20


def folded(text: str) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split())


def budget(item: str) -> int:
    """Edits allowed in a folded item."""
    return max(0, len(item) // CHARS_PER_EDIT - 1)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(start, text) of edits + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def joined(one: str, two: str) -> bool:
    """Whether no word boundary is between two neighbours; either may be empty, at an end of the text."""
    return all(c.isalnum() and not UNSPACED.match(c) for c in (one, two))


def found(item: str, text: str) -> int:
    """Where ``item`` first stands in ``text``, a short item between word boundaries, or -1."""
    at = text.find(item)
    if len(item) < LEAST_CHARS:
        while at >= 0 and (joined(text[at - 1 : at], item[0]) or joined(item[-1], text[at + len(item) : at + len(item) + 1])):
            at = text.find(item, at + 1)
    return at


def distance(item: str, text: str) -> tuple[int, int]:
    """(least edit distance between ``item`` and any part of ``text``, the end of the first such part)."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, best, at = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up = mh | ~(xv | ph) & mask
        down = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds the items of one block in folded texts."""

    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick

        self.items = items
        self.edits = [budget(text) for _, text in items]
        ends: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for start, piece in pieces(text, self.edits[k]):
                ends.setdefault(piece, []).append((k, start + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in ends.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item number, edits, end in the folded text) of each item that stands in ``text``."""
        around: dict[int, list[list[int]]] = {}
        for last, uses in self.automaton.iter(text):
            for k, ended in uses:
                start, e = last + 1 - ended, self.edits[k]
                lo, hi = max(0, start - e), start + len(self.items[k][1]) + e
                spans = around.setdefault(k, [])
                if spans and lo <= spans[-1][1] and hi >= spans[-1][0]:  # one pass over neighbourhoods that meet
                    spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                else:
                    spans.append([lo, hi])
        for k in sorted(around):
            item, best = self.items[k][1], None
            at = found(item, text)
            if at >= 0:
                yield k, 0, at + len(item)
            if at >= 0 or len(item) < LEAST_CHARS:
                continue
            for lo, hi in around[k]:
                d, end = distance(item, text[lo:hi])
                if d <= self.edits[k] and (best is None or d < best[0]):
                    best = (d, lo + end)
            if best:
                yield k, *best


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Folded items that are not empty, block by block; each block is about BLOCK_BYTES."""
    items = items.select("item_id", text_of(items).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(total / BLOCK_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        block = sorted(((r["item_id"], folded(r["text"])) for r in rows), key=lambda x: (x[0] is not None, str(x[0]), x[1]))
        if block := [x for x in block if x[1]]:
            yield block


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, budget, item_chars, end_char): every benchmark item that stands in a document.

    ``end_char`` is where its best match ends in the folded text.  An item of fewer than LEAST_CHARS
    characters stands where it is unchanged between word boundaries.  Null and empty texts match nothing; a
    document row that repeats gives its rows again; an item that repeats gives one row.  Ids may be null and
    of any atomic type; items that share an id are matched each for itself.  Texts may have any length.
    Extra columns are ignored; an empty table gives no rows.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, budget int, item_chars int, end_char long"
    source = docs.select("doc_id", text_of(docs).alias("text"))
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in slices(batches):
                rows: list[list] = [[], [], [], [], [], []]
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for k, edits, end in matcher.matches(folded(text)):
                        for column, value in zip(rows, (key, block[k][0], edits, matcher.edits[k], len(block[k][1]), end), strict=True):
                            column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column("doc_id").type), pa.array(rows[1], item_type), *[pa.array(c, pa.int32()) for c in rows[2:5]], pa.array(rows[5], pa.int64())], ["doc_id", "item_id", "edits", "budget", "item_chars", "end_char"])

        out = out.unionAll(arrow_map(source, run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the rows in which a benchmark item stands; nulls as in ``matches``."""
    for block in _blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in slices(batches, "body for matching"):
                texts = batch.column("body for matching").to_pylist()
                keep = pa.array([next(matcher.matches(folded(t)), None) is None for t in texts], pa.bool_())
                yield batch.filter(keep).drop_columns(["body for matching"])

        docs = arrow_map(docs.withColumn("body for matching", text_of(docs)), run, docs.schema)
    return docs
