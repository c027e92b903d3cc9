"""Suffix-array deduplication on bytes.

A byte goes if it is covered by a string of ``width`` bytes that also starts in an earlier document.  Such
strings are the prefixes that neighbours in a suffix array share, but a suffix array over all positions of
a large corpus can't be held or moved.  Three passes make it sparse without losing a match:

1. Each string of ``width`` bytes has an anchor, the smallest hash of a short gram inside it (a minimizer),
   so equal strings have equal anchors at the same place.  Anchors of all documents meet by their hash;
   those that stand in one document only are dropped.
2. Around each anchor that remains, the run of strings that it serves is cut out and meets the runs of the
   same anchor.  Equal runs are settled by their bytes; the suffixes of the others are sorted deep-shallow,
   and neighbours with ``width`` bytes in common fall into classes, in each of which the earliest document
   keeps its bytes.
3. The strings that go meet their documents, and their bytes are cut out.

Only bytes decide in the second pass; hashes never do.

An anchor inside a passage that a large share of all documents holds would bring as many runs together as
there are surroundings of the passage.  The most frequent anchors (``MOST_FREQUENT`` at most, so their list
is small; each further one has at most a share of 1 / MOST_FREQUENT of all entries) are therefore not met as
runs: each of their strings goes by a hash of its own, so that surroundings part and only equal strings meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readalong.llm.common import arrow_map, buffers, drop_folder, passes, staged
from readalong.llm.spans import ENTRY, FREQUENT, ROUTED_SQL, VERDICT, Layout, Verdicts, doc_table, exchanged, in_batches, keyed, layout, mixed, ranks, settle_bits, unzip_arrays, unzip_docs, verdict_rows, windows, with_verdicts, zip_arrays, zip_docs
from readalong.llm.substring_dedup import _marked, intervals

#: Bytes of an anchor's gram.
GRAM = 18
#: Suffixes are sorted by so many bytes with multikey quicksort; blind tries order what is still equal.
SHALLOW = 48
_BYTE = mixed(5, 256)
#: An anchor is frequent if a slice of documents holds it ``OFTEN`` times, or if so many slices hold it, or so many times
#: those that hold it ``COUNTED`` times at least, that it counts ``OFTEN_IN_ALL``.  Below that its runs are at most about
#: 60,000, less than a bucket has anyway, and a frequent anchor's strings take many times the bytes of its runs.
COUNTED, OFTEN, OFTEN_IN_ALL = 16, 256, 4096
MOST_FREQUENT = 10_000
#: Texts of more bytes are read for anchors in parts of so many; two strings' parts overlap, so none is cut.
LONG = 1 << 22
#: Packs the texts of runs, which are most of what moves.
_PACK = zstandard.ZstdCompressor(level=3)
#: Low bits of a sort value that hold the place in the slice, which breaks ties to the left.
_PLACE = 28


def anchors(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, anchor's hash, first and last start of the strings that it serves, its number in the document)."""
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, np.zeros(0, np.uint64), none, none, none
    gram = settle_bits(windows(_BYTE[raw], GRAM))
    value = gram >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, have = width - GRAM + 1, 1
    while have * 2 <= span:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if span > have:
        value = np.minimum(value[: len(value) - (span - have)], value[span - have :])
    at = (value & np.uint64((1 << _PLACE) - 1)).astype(np.int64)  # of each string, by its start
    size = np.diff(off)
    count = np.maximum(0, size - width + 1)
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(doc)) + np.repeat(off[:-1] - (np.cumsum(count) - count), count)
    at = at[start]
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    owner = doc[new]
    number = np.arange(len(new)) - np.searchsorted(owner, owner)
    # minima crowd at the low end; mix them anew, as buckets go by the high bits
    return owner, settle_bits(gram[at[new]] * np.uint64(0xC2B2AE3D27D4EB4F)), start[new], start[last], number


class BlindTrie:
    """A trie on the bytes at which suffixes branch; only a suffix found by them is compared in full."""

    def __init__(self, text: bytes, depth: int):
        self.text, self.depth = text, depth
        self.root: list | None = None  # a leaf is a list of equal suffixes; a branch is (depth, {byte: child})

    def add(self, suffix: int) -> None:
        if self.root is None:
            self.root = [suffix]
            return
        text, node = self.text, self.root
        while isinstance(node, tuple):
            at, children = node
            node = children.get(text[suffix + at]) or next(iter(children.values()))
        other = node[0]
        a, b = text[suffix : suffix + self.depth], text[other : other + self.depth]
        if a == b:
            node.append(suffix)
            return
        differ = int.from_bytes(a) ^ int.from_bytes(b)
        common = self.depth - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, node = node, node[1][text[suffix + node[0]]]
        if isinstance(node, tuple) and node[0] == common:
            node[1][text[suffix + common]] = [suffix]
            return
        branch = (common, {text[other + common]: node, text[suffix + common]: [suffix]})
        if parent is None:
            self.root = branch
        else:
            parent[1][text[suffix + parent[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Lists of equal suffixes, in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [child for _, child in sorted(node[1].items(), key=lambda x: -x[0])]
            else:
                yield node


def deep_shallow(text: bytes, suffixes: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` bytes, class of each): one class for each prefix of that length.

    Every suffix has ``depth`` bytes.  The shallow part is a multikey quicksort whose keys are eight bytes
    and whose groups are split all at once; the groups that still share ``shallow`` bytes go through a
    blind trie, unless all of a group's suffixes are equal to the end.
    """
    if not len(suffixes):
        return suffixes, suffixes
    raw = np.frombuffer(text + bytes(8 + depth), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(raw, 8)

    def word(at: np.ndarray, skip: int) -> np.ndarray:
        w = np.ascontiguousarray(view[at + skip]).view(">u8").ravel().astype(np.uint64)
        return w >> np.uint64(8 * max(0, skip + 8 - depth))  # not beyond the depth

    order = np.asarray(suffixes)
    group = np.zeros(len(order), np.int64)
    for skip in range(0, min(shallow, depth), 8):
        key = word(order, skip)
        by = np.lexsort((key, group)) if skip else np.argsort(key, kind="stable")
        order, group, key = order[by], group[by], key[by]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    head = begins[group]
    same = np.ones(len(order), bool)
    for skip in range(shallow, depth, 8):
        w = word(order, skip)
        same &= w == w[head]
    mixed_groups = np.unique(group[~same])
    classes = group * 0
    classes[begins] = 1
    ends = np.append(begins[1:], len(order))
    for g in mixed_groups.tolist():
        lo, hi = int(begins[g]), int(ends[g])
        trie = BlindTrie(text, depth)
        for s in order[lo:hi].tolist():
            trie.add(s)
        at = lo
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            classes[at] = 1
            at += len(leaf)
    return order, np.cumsum(classes) - 1


def _anchors_of(batch: pa.RecordBatch, width: int, long: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of a whole batch, in small passes; starts count from the beginning of their document."""
    parts = []
    for before, raw, off in passes(batch):
        if len(off) == 2 and len(raw) > long:
            number = 0
            for lo in range(0, max(1, len(raw) - width + 1), long):
                part = raw[lo : lo + long + width - 1]
                doc, key, first, last, own = anchors(part, np.array([0, len(part)]), width)
                parts.append((doc + before, key, first + lo, last + lo, own + number))
                number += len(own)
            continue
        doc, key, first, last, number = anchors(raw, off, width)
        parts.append((doc + before, key, first - off[doc], last - off[doc], number))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_entries(width: int):
    long = LONG

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, key, _, _, number = _anchors_of(batch, width, long)
        return doc, number, key

    return entries


def _runs(batch: pa.RecordBatch, known: Verdicts, width: int, where: Layout, frequent: np.ndarray, long: int) -> list[tuple]:
    """Rows that carry the runs of a slice's shared anchors to the anchors' buckets, and verdicts on those settled here."""
    docs = doc_table(batch)
    doc, key, first, last, _ = _anchors_of(batch, width, long)
    named, number, size = known.of(batch)
    begins = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    wanted = np.zeros(len(doc) + 1, np.int64)
    np.add.at(wanted, begins[named] + number, 1)
    np.add.at(wanted, begins[named] + number + size, -1)
    chosen = np.cumsum(wanted[:-1]) > 0
    if not chosen.any():
        return []
    raw, off = buffers(batch.column("text"))
    body, rank = raw.tobytes(), ranks(docs)
    often = chosen & np.isin(key & KEY_MASK, frequent)
    if often.any():  # one run for each string, which goes by its own hash
        strings = (last - first + 1)[often]
        each = np.repeat(first[often] - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
        owner = np.repeat(doc[often], strings)
        view = np.lib.stride_tricks.sliding_window_view(raw, width)[off[owner] + each]
        own = settle_bits(windows(_BYTE[view].T, width)[0]) if len(view) else np.zeros(0, np.uint64)
        rest = chosen & ~often
        doc, key, first, last = (np.concatenate(x) for x in ((doc[rest], owner), (key[rest], own), (first[rest], each), (last[rest], each)))
    else:
        doc, key, first, last = doc[chosen], key[chosen], first[chosen], last[chosen]
    held: dict[bytes, int] = {}
    at = off[doc] + first
    alike = np.array([held.setdefault(body[a:b], len(held)) for a, b in zip(at.tolist(), (at + last - first + width).tolist(), strict=True)], np.int64)
    low = np.full(len(held), len(rank))
    np.minimum.at(low, alike, rank[doc])
    del held
    later = rank[doc] > low[alike]
    settled, travel = np.flatnonzero(later), np.flatnonzero(~later)
    rows = verdict_rows(docs, doc[settled], first[settled], last[settled] - first[settled] + 1, where)
    route, sub = where.routes(key[travel])
    order = np.lexsort((sub, route))
    for k in np.split(order, np.flatnonzero(np.diff(route[order]) | np.diff(sub[order])) + 1):
        part = travel[k]
        owners, own = np.unique(doc[part], return_inverse=True)
        size = last[part] - first[part] + width
        text = b"".join(body[a : a + s] for a, s in zip(at[part].tolist(), size.tolist(), strict=True))
        rows.append((int(route[k[0]]), int(sub[k[0]]), ENTRY, zip_docs(docs[owners]), zip_arrays(own, first[part], size), key[part].astype("<u8").tobytes() + _PACK.compress(text)))
    return rows


def _settle_runs(batches: Iterator[pa.RecordBatch], width: int, where: Layout) -> Iterator[pa.RecordBatch]:
    """Verdicts on the runs of each bucket of anchors of a partition; rows come bucket by bucket."""
    import pyarrow.compute as pc

    held, bucket = [], None
    for batch in batches:
        own = pc.equal(batch.column("kind"), VERDICT)
        if len(settled := batch.filter(own)):
            yield settled
        others = batch.filter(pc.invert(own))
        for sub, *packed in zip(*(others.column(c).to_pylist() for c in ("sub", "docs", "places", "keys")), strict=True):
            if sub != bucket and held:
                yield from _settle_bucket(held, width, where)
                held = []
            bucket = sub
            held.append(packed)
    if held:
        yield from _settle_bucket(held, width, where)


def _settle_bucket(rows: list[list[bytes]], width: int, where: Layout) -> Iterator[pa.RecordBatch]:
    """Verdicts on the runs of one bucket of anchors."""
    tables, columns, base = [], [], 0
    known: dict[tuple[int, bytes], int] = {}
    alike: list[int] = []
    for packed, places, keys in rows:
        tables.append(unzip_docs(packed))
        own, start, size = unzip_arrays(places, 3)
        key = np.frombuffer(keys[: 8 * len(own)], "<u8").tolist()
        text = zstandard.decompress(keys[8 * len(own) :])
        ends = np.cumsum(size)
        alike += [known.setdefault((k, text[a:b]), len(known)) for k, a, b in zip(key, (ends - size).tolist(), ends.tolist(), strict=True)]
        columns.append((own + base, start, size))
        base += len(tables[-1])
    docs = np.concatenate(tables)
    doc, start, size = (np.concatenate(x) for x in zip(*columns, strict=True))
    group = np.array(alike, np.int64)
    rank = ranks(docs)[doc]
    low = np.full(len(known), len(docs))
    np.minimum.at(low, group, rank)
    later = rank > low[group]
    out = [(doc[later], start[later], size[later] - width + 1)]
    # runs of one anchor whose earliest documents differ
    by = np.argsort(key := np.fromiter((k for k, _ in known), np.uint64, len(known)), kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
    differ = np.minimum.reduceat(low[by], cuts) != np.maximum.reduceat(low[by], cuts)
    several = np.sort(by[np.repeat(differ, np.diff(np.append(cuts, len(by))))])
    if len(several):
        texts = [t for _, t in known]
        texts = [texts[i] for i in several.tolist()]
        del known
        text = b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        begins, strings = np.cumsum(sizes) - sizes, sizes - width + 1
        run = np.repeat(np.arange(len(several)), strings)
        within = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
        place = begins[run] + within
        order, classes = deep_shallow(text, place, width)
        number = np.empty(len(text), np.int64)
        number[place] = np.arange(len(place))
        number = number[order]
        r = low[several][run[number]]
        cuts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        least = np.minimum.reduceat(r, cuts)[classes]
        gone = np.zeros(len(run), bool)
        gone[number] = r > least
        joined = gone[1:] & gone[:-1] & (run[1:] == run[:-1])
        lo = np.flatnonzero(gone & ~np.concatenate([[False], joined]))
        hi = np.flatnonzero(gone & ~np.concatenate([joined, [False]])) + 1
        # to each document that holds the run and is its earliest
        first = np.flatnonzero(~later)
        first = first[np.argsort(group[first], kind="stable")]
        own = several[run[lo]]
        from_, to = np.searchsorted(group[first], own), np.searchsorted(group[first], own, "right")
        count = to - from_
        member = first[np.repeat(from_ - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        out.append((doc[member], start[member] + np.repeat(within[lo], count), np.repeat(hi - lo, count)))
    yield from in_batches(verdict_rows(docs, *(np.concatenate(x) for x in zip(*out, strict=True)), where))


#: The bits of an anchor's hash that meet in the first pass.
KEY_MASK = np.uint64(2**48 - 1)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("places", "keys"))
        yield pa.RecordBatch.from_arrays([pa.array(keys & int(KEY_MASK)), pa.array(counts)], ["key", "count"])


def _verdicts(source: DataFrame, where: Layout, width: int) -> DataFrame:
    """Stored verdict rows: starts of strings that also start in an earlier document."""
    long = LONG
    shared, path = staged(exchanged(source, _anchor_entries(width), where, "shared", 6, (COUNTED, OFTEN_IN_ALL)), "anchors")
    counts = arrow_map(shared.filter(F.col("kind") == FREQUENT).select("places", "keys"), _frequent, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"), F.max("count").alias("most")).filter((F.col("most") >= OFTEN) | (F.col("count") >= OFTEN_IN_ALL))
    frequent = np.array([r["key"] for r in counts.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()], np.uint64)

    def send(batch: pa.RecordBatch, known: Verdicts) -> Iterator[pa.RecordBatch]:
        yield from in_batches(_runs(batch, known, width, where, frequent, long))

    runs = with_verdicts(source.select("id", "tk", "db", "text"), shared, where, send, ROUTED_SQL).repartitionById(where.partitions, "route")
    if where.fan > 1:
        runs = runs.sortWithinPartitions("sub")
    found, _ = staged(arrow_map(runs, lambda batches: _settle_runs(batches, width, where), ROUTED_SQL), "runs")
    drop_folder(source.sparkSession, path)
    return found


def _cut(batch: pa.RecordBatch, known: Verdicts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, off = buffers(batch.column("text"))
    return raw, off, _marked(*known.of(batch), off[:-1], len(raw), width)


def _parts(raw: np.ndarray, off: np.ndarray, marked: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bytes that stay of each text, and how many go."""
    kept = raw[~marked].tobytes()
    gone = np.concatenate([[0], np.cumsum(marked)])[off]
    edges = off - gone
    return [kept[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)], np.diff(gone)


def dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) of every row: removed byte ranges and the bytes that stay.

    Null texts are empty; texts shorter than ``width`` bytes lose nothing.  Rows that repeat doc_id and
    text are one document and get one result each; rows that share a doc_id alone are ordered by a hash of
    their text; null ids come first.  Extra columns are ignored; an empty table gives no rows.
    """
    where = layout(docs)
    source = keyed(docs, where)

    def use(batch: pa.RecordBatch, known: Verdicts) -> Iterator[pa.RecordBatch]:
        raw, off, marked = _cut(batch, known, width)
        kept, gone = _parts(raw, off, marked)
        ids = [None if i == -(2**63) else i for i in batch.column("id").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(gone, pa.int64()), intervals(marked, off), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return with_verdicts(source, _verdicts(source, where, width), where, use, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def rewritten(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with their columns, the repeated ranges cut out of ``text``; ``n_chars`` follows the new text.

    A character of which only some bytes would go stays whole.  Rows that lose all of their text go; null
    and empty texts stay as they are.  Rows are treated as by ``dedup``.
    """
    where = layout(docs)
    others = [c for c in docs.columns if c != "text"]
    source = keyed(docs, where, rest=True)
    schema = T.StructType([T.StructField("text", T.StringType()), source.schema["rest"]])

    def use(batch: pa.RecordBatch, known: Verdicts) -> Iterator[pa.RecordBatch]:
        raw, off, marked = _cut(batch, known, width)
        # a character goes only with all of its bytes
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(lead):
            marked = np.repeat(np.minimum.reduceat(marked.astype(np.uint8), lead).astype(bool), np.diff(np.append(lead, len(raw))))
        kept, gone = _parts(raw, off, marked)
        null = batch.column("rest").field(len(others)).to_pylist()
        texts = pa.array([None if x else t for t, x in zip(kept, null, strict=True)], pa.binary()).cast(pa.string())
        left = pa.array((gone == 0) | (gone < np.diff(off)), pa.bool_())
        yield pa.RecordBatch.from_arrays([texts, batch.column("rest")], ["text", "rest"]).filter(left)

    out = with_verdicts(source, _verdicts(source, where, width), where, use, schema)
    columns = {c: F.col("rest")[c].alias(c) for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("rest")["n_chars"]).alias("n_chars")
    return out.select(*[F.col("text") if c == "text" else columns[c] for c in docs.columns])
