"""Substring deduplication on windows of words.

Every window of ``width`` consecutive words gets Rabin-Karp hashes of its words' digests.  In a first pass
short hashes of all windows meet, packed, and only windows whose hash occurs twice are looked at again:
these get a hash of two lanes modulo 2**61 - 1, Spark numbers the occurrences of each in the order of
documents and places, and each window that also starts earlier marks its words.  Neighbouring marked words
merge into maximal removal intervals.

The first pass can only let too much through.  What decides is the second hash, of 122 bits over 128-bit
BLAKE2 digests of the words: two given windows with different words agree in it with a chance of at most
(width / 2**61)**2, so over n windows any false match has a chance of n * n * 2**-114 at width 20 (1e-8 for the
1.4e13 windows of 100 TB), whatever the words are, unless they were made with the two bases in mind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, buffers, passes, staged
from readalong.llm.spans import PRIME, ROUTED_SQL, Layout, Verdicts, doc_table, exchanged, in_batches, judge, keyed, lanes, layout, settle_bits, verdict_rows, windows, with_verdicts

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of the runs of bytes that are no white space; no word spans two texts."""
    inner = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[:-1][off[:-1] < len(raw)]] = True
    begins, ends = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw):
        begins[0], ends[-1] = inner[0], inner[-1]
        begins[1:] = inner[1:] & (~inner[:-1] | edge[1:-1])
        ends[:-1] = inner[:-1] & (~inner[1:] | edge[1:-1])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each word's bytes, as two columns of numbers below the prime; distinct words are digested once."""
    size = ends - starts
    tail = np.cumsum(size)
    if not len(size):
        return np.zeros((0, 2), np.uint64)
    inner = raw[np.repeat(starts - tail + size, size) + np.arange(tail[-1])]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], tail]).astype(np.int64)), pa.py_buffer(inner)]).dictionary_encode()
    each = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist()), "<u8").reshape(-1, 2)
    return (each % np.uint64(PRIME))[coded.indices.to_numpy()]


def _windows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, word digests, first word of each text, windows in each text) of small runs of texts."""
    for before, raw, off in passes(batch):
        starts, ends, first = words(raw, off)
        yield before, word_digests(raw, starts, ends), first, np.maximum(0, np.diff(first) - width + 1)


def _short_key(hashes: np.ndarray) -> np.ndarray:
    """Key of the first pass, from one lane of the window hashes; windows that share it are only looked at again."""
    return settle_bits(hashes)


def _window_entries(width: int):
    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for before, digests, first, count in _windows_of(batch, width):
            key = _short_key(windows(digests[:, 0], width))
            doc = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            found.append((doc + before, at, key[first[doc] + at] if len(doc) else key[:0]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return entries


#: Rows of the second pass: a window's hash and its first place in this slice, or a place that is settled (``gone``, with a key of its document's own).
_OCCURRENCES = pa.schema([("l1", pa.int64()), ("l2", pa.int64()), ("id", pa.int64()), ("tk", pa.int64()), ("place", pa.int32()), ("gone", pa.bool_())])
_OCCURRENCES_SQL = "l1 long, l2 long, id long, tk long, place int, gone boolean"


def _occurrences(batch: pa.RecordBatch, known: Verdicts, width: int) -> Iterator[pa.RecordBatch]:
    """The windows of a slice that may occur twice; of equal ones the earliest travels, the others are settled here."""
    docs = doc_table(batch)
    named, start, size = known.of(batch)
    if not len(named):
        return
    doc = np.repeat(named, size)
    code = np.unique(doc << 32 | np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(doc)))
    doc, place = code >> 32, code & (2**32 - 1)
    key = np.empty((len(doc), 2), np.uint64)
    for before, digests, first, count in _windows_of(batch, width):
        lo, hi = np.searchsorted(doc, [before, before + len(count)])
        if hi > lo:
            key[lo:hi] = lanes(digests, width)[first[doc[lo:hi] - before] + place[lo:hi]]
    order = np.lexsort((key[:, 1], key[:, 0]))
    number = np.empty(len(order), np.uint64)
    number[order] = np.cumsum(np.concatenate([[0], (key[order[1:]] != key[order[:-1]]).any(1)]))
    _, first_here = judge(docs, doc, place, number, "twice")
    l1, l2 = key[:, 0].astype(np.int64), key[:, 1].astype(np.int64)
    own = docs[doc]
    # settled places are told apart from hashes, which are not negative
    l1 = np.where(first_here, l1, own["tk"] | np.int64(_SIGN))
    l2 = np.where(first_here, l2, own["id"])
    yield pa.RecordBatch.from_arrays([pa.array(l1), pa.array(l2), pa.array(own["id"]), pa.array(own["tk"]), pa.array(place.astype(np.int32)), pa.array(~first_here)], schema=_OCCURRENCES)


_SIGN = -(2**63)
#: Places that are packed into verdict rows at once.
_PACKED = 1_000_000


def _verdicts(source: DataFrame, where: Layout, width: int) -> DataFrame:
    """Stored verdict rows: starts of windows that also start earlier."""
    twice, _ = staged(exchanged(source, _window_entries(width), where, "twice", 6), "windows")
    found = with_verdicts(source, twice, where, lambda batch, known: _occurrences(batch, known, width), _OCCURRENCES_SQL)
    # ranks count the occurrences; rows that repeat a document tie
    order = Window.partitionBy("l1", "l2").orderBy("id", "tk", "place")
    later = found.withColumn("rank", F.rank().over(order)).filter("gone or rank > 1").select("id", "tk", F.pmod(F.xxhash64("id", "tk"), F.lit(where.buckets)).cast("int").alias("db"), "place")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            docs, doc = np.unique(doc_table(table), return_inverse=True)
            place = table.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
            yield from in_batches(verdict_rows(docs, doc.ravel(), place, np.ones(len(place), np.int64), where))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _PACKED:
                yield from rows()
        if held:
            yield from rows()

    return staged(arrow_map(later, packed, ROUTED_SQL), "repeats")[0]


def _marked(doc: np.ndarray, start: np.ndarray, size: np.ndarray, base: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of ``total`` items stand in a window; verdicts name window starts within a document that begins at base."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, base[doc] + start, 1)
    np.add.at(step, base[doc] + start + size + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


def intervals(marked: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Maximal runs of marked items of each document, as lists of (start, end)."""
    edge = np.zeros(len(marked) + 1, bool)
    edge[first[:-1][first[:-1] < len(marked)]] = True
    begins = marked.copy()
    begins[1:] &= ~marked[:-1] | edge[1:-1]
    ends = marked.copy()
    ends[:-1] &= ~marked[1:] | edge[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    cuts = np.searchsorted(a, first)
    base = np.repeat(first[:-1], np.diff(cuts))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], ["start", "end"]))


def dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row: removal intervals in words, and the kept words joined by one space.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
    return.  A null or empty text has no words and keeps the empty string; texts shorter than a window lose
    nothing.  Rows that repeat doc_id and text are one document and get one result each; rows that share a
    doc_id alone are ordered by a hash of their text; null ids come first.  Extra columns are ignored.
    """
    where = layout(docs)
    source = keyed(docs, where)
    verdicts = _verdicts(source, where, width)

    def use(batch: pa.RecordBatch, known: Verdicts) -> Iterator[pa.RecordBatch]:
        raw, off = buffers(batch.column("text"))
        starts, ends, first = words(raw, off)
        marked = _marked(*known.of(batch), first[:-1], len(starts), width)
        kept = np.flatnonzero(~marked)
        # each kept word with one byte behind it, which becomes the space
        size = ends[kept] - starts[kept] + 1
        tail = np.cumsum(size)
        at = np.repeat(starts[kept] - tail + size, size) + np.arange(tail[-1] if len(tail) else 0)
        out = np.append(raw, np.uint8(32))[at]
        out[tail - 1] = 32
        cuts = np.searchsorted(kept, first)
        edges = np.concatenate([[0], tail])[cuts]
        body = out.tobytes()
        texts = [body[a : max(a, b - 1)] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
        count = np.diff(first)
        ids = [None if i == -(2**63) else i for i in batch.column("id").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(count - np.diff(cuts), pa.int64()), intervals(marked, first), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return with_verdicts(source, verdicts, where, use, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
