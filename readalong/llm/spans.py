"""Exchange of hashed windows between documents, shared by the two span deduplicators.

Workers turn a slice of documents into entries (key, document, place).  Entries are packed into one row
for each bucket of keys, judged there with the entries of all other slices, and the verdicts go back as
one row for each bucket of documents, where they meet the documents' texts again.

Before anything is sent, each slice judges its own entries: of the entries of a key that the rule
settles inside the slice only the earliest travels, so that a key held by a third of all documents costs
one entry for each slice.  The number of buckets follows the size of the input, and one bucket is all that
a task holds at a time; beyond ``MOST_PARTITIONS`` buckets a partition has several, which Spark's own sort
(it spills) brings up one after the other.

A document is a row's (doc_id, hash of its text); null ids come first.  Rows that repeat both are one
document, and each gets the verdicts.  Where no doc_id repeats, the ids alone tell documents apart.

The more buckets, the fewer entries of a row share a document, so that beyond some gigabytes the
documents' names are most of what moves.  They are therefore packed by their bytes in use and by steps.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, partitions, slices, text_of

#: Stored bytes of input for each bucket.
BUCKET_BYTES = 10 << 20
#: Partitions of an exchange at most, so that the blocks of a shuffle stay few; beyond, each holds several buckets.
MOST_PARTITIONS = 20_000
NULL_ID = -(2**63)
ROUTED = pa.schema([("route", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("keys", pa.binary())])
ROUTED_SQL = "route int, sub int, kind int, docs binary, places binary, keys binary"
ENTRY, VERDICT, DOCUMENT, FREQUENT = 0, 1, 2, 3

#: One row for each document of a slice: id, text hash and bucket of documents.
DOC = np.dtype([("id", "<i8"), ("tk", "<i8"), ("db", "<i4")])


class Layout(NamedTuple):
    """Buckets, the partitions that hold them, and the buckets in each partition."""

    buckets: int
    partitions: int
    fan: int

    def routes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(partition by the high bits, bucket in it by the low bits) of each key."""
        scaled = lambda half, n: (half * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        return scaled(key >> np.uint64(32), self.partitions), scaled(key & np.uint64(2**32 - 1), self.fan)


def layout(docs: DataFrame) -> Layout:
    """By the stored size that Spark knows of, and at least the session's shuffle partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(partitions(docs), math.ceil(size / BUCKET_BYTES) if size < 2**52 else 0)
    p = min(n, MOST_PARTITIONS)
    return Layout(n, p, math.ceil(n / p))


def keyed(docs: DataFrame, where: Layout, rest: bool = False) -> DataFrame:
    """(id, tk, db, text[, rest]) of every row; ``rest`` is a struct of all columns but text, and of whether the text is null.

    The hash ``tk`` is 0 throughout where no id repeats, which takes a count of the ids.
    """
    text = text_of(docs)
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id")
    most = docs.select(own).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    columns = [own, (F.xxhash64(text) if most > 1 else F.lit(0).cast("long")).alias("tk"), text.alias("text")]
    if rest:
        columns.append(F.struct(*[docs[c] for c in docs.columns if c != "text"], docs["text"].isNull().alias("text is null")).alias("rest"))
    return docs.select(*columns).withColumn("db", F.pmod(F.xxhash64("id", "tk"), F.lit(where.buckets)).cast("int"))


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, all lowest ones first."""
    return values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T.tobytes()


def _from_planes(body: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(body) // max(1, n)] = body.reshape(-1, n).T if n else 0
    return wide.view("<i8").ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences from one number to the next, small ones of either sign as small numbers."""
    step = np.diff(a.astype(np.int64), prepend=0)
    return (step << 1 ^ step >> 63).view(np.uint64)


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum((steps.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(steps & 1))


def zip_arrays(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays of one length as a packed string of four bytes each, the first by its steps."""
    return _PACK.compress(b"".join(_planes(a, 4) for a in (_steps(arrays[0]), *arrays[1:])))


def unzip_arrays(packed: bytes, count: int) -> list[np.ndarray]:
    body = np.frombuffer(_UNPACK.decompress(packed), np.uint8)
    out = [_from_planes(part, len(part) // 4) for part in np.split(body, count)]
    return [_from_steps(out[0]), *out[1:]]


def zip_docs(docs: np.ndarray) -> bytes:
    """The names of documents as a packed string: ids by their steps, and of each column the bytes in use."""
    columns = [_steps(docs["id"]), np.ascontiguousarray(docs["tk"]).view(np.uint64), docs["db"].astype(np.uint64)]
    widths = [-(-int(c.max()).bit_length() // 8) if len(c) else 0 for c in columns]
    return len(docs).to_bytes(4, "little") + bytes(widths) + _PACK.compress(b"".join(map(_planes, columns, widths)))


def unzip_docs(packed: bytes) -> np.ndarray:
    n, widths = int.from_bytes(packed[:4], "little"), packed[4:7]
    body = np.frombuffer(_UNPACK.decompress(packed[7:]), np.uint8)
    docs = np.empty(n, DOC)
    ids, docs["tk"], docs["db"] = (_from_planes(part, n) for part in np.split(body, np.cumsum(np.array(list(widths)) * n)[:-1]))
    docs["id"] = _from_steps(ids)
    return docs


def doc_table(batch: pa.RecordBatch) -> np.ndarray:
    table = np.empty(batch.num_rows, DOC)
    for name in ("id", "tk", "db"):
        table[name] = batch.column(name).to_numpy(zero_copy_only=False)
    return table


def ranks(docs: np.ndarray) -> np.ndarray:
    """Place of each document in the order of (id, tk); the same for the same document."""
    order = np.lexsort((docs["tk"], docs["id"]))
    s = docs[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["id"][1:] != s["id"][:-1]) | (s["tk"][1:] != s["tk"][:-1])
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def judge(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(entries with a verdict, entries that still have to be judged against others).

    ``twice``: an entry gets a verdict if its key has another entry; then the first travels on, else all.
    ``shared``: an entry gets a verdict if its key stands in two documents; then the first travels on, else all.
    """
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    rank = ranks(docs)[doc]
    code = rank << 32 | place
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    c = code[order]
    first = np.repeat(np.minimum.reduceat(c, starts), sizes)
    verdict, travel = np.empty(len(k), bool), np.empty(len(k), bool)
    settled = sizes > 1 if rule == "twice" else (np.maximum.reduceat(c, starts) >> 32) != (np.minimum.reduceat(c, starts) >> 32)
    settled = np.repeat(settled, sizes)
    verdict[order] = settled
    travel[order] = ~settled | (c == first)
    return verdict, travel


def verdict_rows(docs: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, where: Layout) -> list[tuple]:
    """Rows for the buckets of the documents that are named; entry i is the places start[i] .. start[i] + size[i] - 1."""
    rows = []
    db = docs["db"][doc]
    order = np.lexsort((start, doc, db))
    db, doc, start, size = db[order], doc[order], start[order], size[order]
    for part in np.split(np.arange(len(db)), np.flatnonzero(np.diff(db)) + 1):
        if len(part):
            named, own = np.unique(doc[part], return_inverse=True)
            bucket = int(db[part[0]])
            rows.append((bucket // where.fan, bucket, VERDICT, zip_docs(docs[named]), zip_arrays(own, start[part], size[part]), None))
    return rows


def entry_rows(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, bucket: np.ndarray, key_bytes: int, route: int | None = None) -> list[tuple]:
    """Rows for the partitions ``bucket`` of the keys, or for buckets inside the partition ``route``; entries come ordered by document and place."""
    rows = []
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            named, own = np.unique(doc[part], return_inverse=True)
            low = key[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :key_bytes]
            to = int(bucket[part[0]])
            rows.append((to if route is None else route, 0 if route is None else to, ENTRY, zip_docs(docs[named]), zip_arrays(own, place[part]), low.tobytes()))
    return rows


class Entries:
    """Entries of many rows, put together."""

    def __init__(self, key_bytes: int) -> None:
        self.key_bytes, self.size = key_bytes, 0
        self.tables, self.owners, self.places, self.keys = [], [], [], []
        self.base = 0

    def add(self, docs: bytes, places: bytes, low: bytes) -> None:
        table = unzip_docs(docs)
        count = len(low) // self.key_bytes
        own, at = unzip_arrays(places, 2)
        wide = np.zeros((count, 8), np.uint8)
        wide[:, : self.key_bytes] = np.frombuffer(low, np.uint8).reshape(-1, self.key_bytes)
        self.tables.append(table)
        self.owners.append(own + self.base)
        self.places.append(at)
        self.keys.append(wide.view("<u8").ravel())
        self.base += len(table)
        self.size += count

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, document number, place, key) of all; nothing is held any more."""
        out = tuple(np.concatenate(x) for x in (self.tables, self.owners, self.places, self.keys))
        self.__init__(self.key_bytes)
        return out


def as_batch(rows: list[tuple], schema: pa.Schema = ROUTED) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def in_batches(rows: list[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield as_batch(part)
            part, size = [], 0
    if part:
        yield as_batch(part)


#: Entries that a task deals out to the buckets of its partition at once.
SPLIT_ENTRIES = 4_000_000


def exchanged(source: DataFrame, entries: Callable[[pa.RecordBatch], tuple], where: Layout, rule: str, key_bytes: int, often: tuple[int, int] | None = None) -> DataFrame:
    """Verdict rows of ``rule`` over all entries; ``entries`` gives (document number, place, key) of a slice.

    With ``often``, rows of kind FREQUENT hold the keys (eight bytes each) that a slice has so many times,
    or that so many slices sent (then only ``key_bytes`` of them are right), and how many.
    """

    def frequent(key: np.ndarray, least: int) -> list[tuple]:
        keys, count = np.unique(key, return_counts=True)
        many = count >= least
        if not many.any():
            return []
        keys, count = keys[many], count[many]  # any partition will do, but not the same for all slices
        return [(int(where.routes(keys[:1])[0][0]), 0, FREQUENT, None, count.astype("<i8").tobytes(), keys.astype("<u8").tobytes())]
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs = doc_table(batch)
            doc, place, key = entries(batch)
            verdict, travel = judge(docs, doc, place, key, rule)
            one = np.ones(int(verdict.sum()), np.int64)
            sent = key[travel]
            yield from in_batches(verdict_rows(docs, doc[verdict], place[verdict], one, where) + entry_rows(docs, doc[travel], place[travel], sent, where.routes(sent)[0], key_bytes) + (frequent(key, often[0]) if often else []))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Each batch's rows that are no entries, as they only pass, and its entries."""
        import pyarrow.compute as pc

        for batch in batches:
            own = pc.equal(batch.column("kind"), ENTRY)
            others = batch.filter(own)
            yield batch.filter(pc.invert(own)), list(zip(*(others.column(c).to_pylist() for c in ("route", "sub", "docs", "places", "keys")), strict=True))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, route = Entries(key_bytes), 0

        def dealt() -> Iterator[pa.RecordBatch]:
            docs, doc, place, key = held.taken()
            yield from in_batches(entry_rows(docs, doc, place, key, where.routes(key)[1], key_bytes, route))

        for settled, rows in parted(batches):
            yield settled
            for own, _, *packed in rows:
                route = own
                held.add(*packed)
                if held.size >= SPLIT_ENTRIES:
                    yield from dealt()
        if held.size:
            yield from dealt()

    def judged(held: Entries) -> Iterator[pa.RecordBatch]:
        docs, doc, place, key = held.taken()
        verdict, _ = judge(docs, doc, place, key, rule)
        out = verdict_rows(docs, doc[verdict], place[verdict], np.ones(int(verdict.sum()), np.int64), where)
        yield from in_batches(out + (frequent(key, often[1]) if often else []))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = Entries(key_bytes), None
        for settled, rows in parted(batches):
            if len(settled):
                yield settled
            for _, sub, *packed in rows:
                if sub != bucket and held.size:
                    yield from judged(held)
                bucket = sub
                held.add(*packed)
        if held.size:
            yield from judged(held)

    sent = arrow_map(source, send, ROUTED_SQL).repartitionById(where.partitions, "route")
    if where.fan > 1:
        sent = arrow_map(sent, split, ROUTED_SQL).sortWithinPartitions("sub")
    return arrow_map(sent, settle, ROUTED_SQL)


class Verdicts:
    """The verdicts of a bucket of documents."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.number: dict[tuple[int, int], int] | None = None

    def add(self, docs: bytes, places: bytes) -> None:
        self.held.append((unzip_docs(docs), *unzip_arrays(places, 3)))
        self.number = None

    def _ordered(self) -> None:
        """Put all verdicts in order of documents."""
        tables, owners, starts, sizes = zip(*self.held, strict=True)
        docs = np.concatenate(tables)
        base = np.cumsum([0, *map(len, tables)])
        rank = ranks(docs)
        owner, start, size = np.concatenate([own + b for own, b in zip(owners, base, strict=False)]), np.concatenate(starts), np.concatenate(sizes)
        self.held = [(docs, owner, start, size)]
        doc = rank[owner]
        order = np.argsort(doc, kind="stable")
        self.start, self.size = start[order], size[order]
        self.cuts = np.searchsorted(doc[order], np.arange(int(rank.max()) + 2))
        self.number = dict(zip(zip(docs["id"].tolist(), docs["tk"].tolist(), strict=True), rank.tolist(), strict=True))

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, start, size) of the verdicts on a slice's documents."""
        none = np.zeros(0, np.int64)
        if not self.held:
            return none, none, none
        if self.number is None:
            self._ordered()
        number = np.array([self.number.get(key, -1) for key in zip(batch.column("id").to_pylist(), batch.column("tk").to_pylist(), strict=True)], np.int64)
        named = np.flatnonzero(number >= 0)
        first = self.cuts[number[named]]
        count = self.cuts[number[named] + 1] - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(named, count), self.start[at], self.size[at]


def with_verdicts(source: DataFrame, verdicts: DataFrame, where: Layout, use: Callable[[pa.RecordBatch, Verdicts], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Bring documents and verdicts together by bucket of documents, and call ``use`` on each slice of documents."""
    columns = [c for c in source.columns if c != "db"]
    docs = source.select((F.col("db") / where.fan).cast("int").alias("route"), F.col("db").alias("sub"), F.lit(DOCUMENT).alias("kind"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("places"), *columns)
    said = verdicts.filter(F.col("kind") == VERDICT).select("route", "sub", "kind", "docs", "places", *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bucket = Verdicts(), None

        def of_one_bucket() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                subs = batch.column("sub").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(subs)) + 1).tolist(), len(subs)]
                yield from (batch.slice(a, b - a) for a, b in itertools.pairwise(cuts) if b > a)

        for batch in of_one_bucket():
            sub = batch.column("sub")[0].as_py()
            if sub != bucket:
                known, bucket = Verdicts(), sub
            said = int((batch.column("kind").to_numpy(zero_copy_only=False) == VERDICT).sum())  # they come first
            for docs, places in zip(batch.column("docs").slice(0, said).to_pylist(), batch.column("places").slice(0, said).to_pylist(), strict=True):
                known.add(docs, places)
            for part in slices(iter([batch.slice(said).select(["sub", *columns])])):
                yield from use(part.rename_columns(["db", *columns]), known)

    return arrow_map(said.unionByName(docs).repartitionById(where.partitions, "route").sortWithinPartitions("sub", "kind", "id"), run, schema)


def mixed(seed: int, count: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers that look random."""
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


#: Base of the rolling hashes of bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(symbols: np.ndarray, width: int, base: int = int(BASE), times: Callable[[np.ndarray, int], np.ndarray] | None = None, modulus: int = 2**64) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` symbols, by doubling; the last width - 1 entries are cut off.

    Modulo 2**64 by numpy's own products, or modulo another number with ``times``.
    """
    if len(symbols) < width:
        return np.zeros(0, np.uint64)
    times = times or (lambda h, f: h * np.uint64(f))
    add = (lambda a, b: a + b) if modulus == 2**64 else _add
    factor, h, size = base, symbols, 1
    out, have, done = None, 0, width
    while True:
        if done & 1:  # the low bits' blocks stand behind those of the higher ones
            if out is None:
                out = h
            else:
                m = len(symbols) - have - size + 1
                out = add(times(h[:m], pow(base, have, modulus)), out[size : size + m])
            have += size
        done >>= 1
        if not done:
            return out[: len(symbols) - width + 1]
        h = add(times(h[: len(h) - size], factor), h[size:])
        factor = factor * factor % modulus
        size *= 2


#: A Mersenne prime: two different windows of w symbols have equal hashes for at most w - 1 of its bases.
PRIME = 2**61 - 1
#: Bases of the two lanes of a window hash; any two numbers drawn at random below the prime.
LANES = (0x0D6E8FEB86659FD9, 0x1A3F84D5B5B54709)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(total >= np.uint64(PRIME), total - np.uint64(PRIME), total)


def _times(a: np.ndarray, factor: int) -> np.ndarray:
    """a * factor modulo the prime, from 32-bit halves."""
    u, p = np.uint64, np.uint64(PRIME)
    f_hi, f_lo = u(factor >> 32), u(factor & (2**32 - 1))
    hi, lo = a >> u(32), a & u(2**32 - 1)
    middle, low = hi * f_lo + lo * f_hi, lo * f_lo
    total = (hi * f_hi << u(3)) + (middle >> u(29)) + ((middle & u(2**29 - 1)) << u(32)) + (low >> u(61)) + (low & p)
    total = (total & p) + (total >> u(61))
    return np.where(total >= p, total - p, total)


def lanes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Two independent Rabin-Karp hashes (columns) of every run of ``width`` symbols; a symbol is two numbers below the prime."""
    return np.stack([windows(symbols[:, k], width, base, _times, PRIME) for k, base in enumerate(LANES)], 1)


def settle_bits(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
