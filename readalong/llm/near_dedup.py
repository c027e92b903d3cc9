"""Near-duplicate documents by b-bit MinHash, with exact links.

Documents are sets of word shingles.  A shingle is 122 bits: two Rabin-Karp lanes modulo 2**61 - 1 over
128-bit BLAKE2 digests of its words, so that two given shingles agree by chance with 2**-116 at most, and
any two of n with n * n * 2**-117.  Equal sets are one node, found by a 128-bit BLAKE2 digest.  Each node
gets ``BANDS * ROWS`` minima; the nodes of a band bucket are candidates.  Of every minimum the low ``BITS``
bits are kept, packed; equal packed values, counted by bits and corrected for chance collisions, estimate
the similarity of candidates, and pairs far below the threshold are dropped.  What remains falls into
candidate groups, and inside these links are confirmed on the full sets.

A true link at the threshold shares no band with a chance of (1 - t**ROWS)**BANDS (2e-8 at 0.85), and is
dropped by the estimate with less.

No step holds an unbounded group or emits all its pairs.  Buckets of more than ``BUCKET`` nodes are not
estimated: all their nodes join one candidate group.  Groups are handled in blocks of at most about
``BLOCK`` nodes or ``BLOCK_BYTES``.  A block reports a spanning forest of its links.  Groups of several
blocks then go on in rounds: nodes outside their group's largest component meet every block that holds one
of the rarest shingles of which two linked sets must share one, until each of them has (two nodes of one
component need no comparison).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, passes, passing, slices, staged, text_of
from readalong.llm.spans import NULL_ID, lanes, mixed, settle_bits
from readalong.llm.substring_dedup import word_digests, words

BANDS, ROWS, BITS = 24, 4, 4
#: The estimate may fall so far below the threshold: six standard deviations of a 96-fold sample at 0.85.
MARGIN = 0.22
BUCKET = 2000
BLOCK = 1500
BLOCK_BYTES = 64 << 20
#: Nodes of a group that one round compares with all its blocks, at first; each round takes four times more.
QUERIES = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLY = mixed(9, BANDS * ROWS).astype(np.uint32) | np.uint32(1)
_FLIP = (mixed(10, BANDS * ROWS) >> np.uint64(32)).astype(np.uint32)


#: Bytes of a shingle in a stored set.
WIDTH = 16


def _sorted(shingles: np.ndarray) -> np.ndarray:
    """Distinct rows, in order."""
    own = shingles[np.lexsort((shingles[:, 1], shingles[:, 0]))]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(1)
    return own[new]


def _hashed(digests: np.ndarray, size: int) -> np.ndarray:
    return lanes(digests, size)


def shingle_sets(batch: pa.RecordBatch, size: int, hashed: Callable[[np.ndarray, int], np.ndarray]) -> list[np.ndarray]:
    """Each text's distinct shingles in order, two numbers each; a text with fewer words has one, one without words none."""
    out = []
    for _, raw, off in passes(batch):
        raw = _LOWER[raw]
        starts, ends, first = words(raw, off)
        word = word_digests(raw, starts, ends)
        full = hashed(word, size)
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            if b - a >= size:
                out.append(_sorted(full[a : b - size + 1]))
            elif b > a:  # no hash of ``size`` words comes with its number of words
                out.append(hashed(word[a:b], b - a) ^ np.array([0, min(b - a, 7) << 61], np.uint64))
            else:
                out.append(np.zeros((0, 2), np.uint64))
    return out


def packed_set(shingles: np.ndarray) -> bytes:
    """A set as it is stored."""
    return shingles.astype("<u8").tobytes()


def _unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u8").reshape(-1, 2)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(packed_set(shingles), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of sets that are not empty."""
    flat = (settle_bits(np.concatenate(sets)[:, 0]) >> np.uint64(32)).astype(np.uint32)
    cuts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.stack([np.minimum.reduceat((flat ^ f) * m, cuts) for m, f in zip(_MULTIPLY, _FLIP, strict=True)], 1)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    rows = least.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        bands = settle_bits((bands ^ rows[:, :, r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
    bands = settle_bits(bands ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint8)
    return bands, low[:, ::2] | low[:, 1::2] << np.uint8(BITS)


def estimate(packed: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature to each of several."""
    differ = packed.view(np.uint64) ^ one.view(np.uint64)
    for shift in (1, 2):  # fold the bits of each value onto its lowest
        differ |= differ >> np.uint64(shift)
    unequal = np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(1)
    equal = 1 - unequal / (BANDS * ROWS)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


class Forest:
    """Union-find over node numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = up[up[v]]
            v = int(up[v])
        return v

    def flat(self) -> np.ndarray:
        """The root of every node."""
        up = self.up
        while (up != up[up]).any():
            up = up[up]
        self.up = up
        return up


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch, size, _hashed)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, packed = signatures([sets[i] for i in full]) if full else (None, None)
            columns: list[list] = [[None] * len(sets) for _ in range(3)]
            for k, i in enumerate(full):
                columns[0][i] = _digest(sets[i])
                columns[1][i] = bands[k].astype("<i8").tolist()
                columns[2][i] = packed[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.binary())], ["id", "n_shingles", "digest", "bands", "packed"])

    return run


def _bucket_edges(threshold: float):
    """Rows sorted by key: a spanning forest of each bucket's pairs whose estimate is not far below the threshold."""

    def forest(v: np.ndarray, n: np.ndarray, packed: np.ndarray) -> Iterator[tuple[int, int]]:
        trees = Forest(len(v))
        for i in range(len(v) - 1):
            near = estimate(packed[i + 1 :], packed[i : i + 1]) >= threshold - MARGIN
            least, most = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
            for j in (np.flatnonzero(near & (least >= threshold * most - 1e-9)) + i + 1).tolist():
                a, b = trees.root(i), trees.root(j)
                if a != b:
                    trees.up[b] = a
                    yield int(v[i]), int(v[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            pairs = []
            begin = 0
            while begin < len(rows):
                end = begin
                while end < len(rows) and rows[end][0] == rows[begin][0]:
                    end += 1
                if end - begin > 1:
                    part = rows[begin:end]
                    pairs += forest(np.array([r[1] for r in part]), np.array([r[2] for r in part]), np.frombuffer(b"".join(r[3] for r in part), np.uint8).reshape(len(part), -1))
                begin = end
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())}) if pairs else None

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "v", "n", "packed")), strict=True)
            last = held[-1][0]
            cut = len(held)
            while cut and held[cut - 1][0] == last:
                cut -= 1
            if found := flush(held[:cut]):
                yield found
            held = held[cut:]
        if found := flush(held):
            yield found

    return run


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(v, label) of every node of ``edges`` (a, b): the smallest node that it reaches; ``rows`` is about their number.

    Large-star and small-star steps in turn until only stars are left; every step is stored, so a lost
    executor costs one step.  A node with very many edges is joined by its key with a stored table of one
    row for each node, which Spark can split.
    """
    edges, _ = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges", rows)
    rows = edges.count()
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("w")))
        least, _ = staged(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows)
        large = both.filter("w > u").join(least, "u").select(F.col("m").alias("a"), F.col("w").alias("b")).filter("a <> b").distinct()
        large, _ = staged(large, "large", rows)
        # small star: u and its smaller neighbours go to the smallest of them
        least, _ = staged(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least", rows)
        small = large.select(F.col("b").alias("u"), F.col("a").alias("w")).join(least, "u")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("u", "w")).alias("b")).filter("a <> b").distinct()
        edges, _ = staged(small, "small", rows)
        # done when all are stars: no node has two centers, no center has one
        n, leaves = edges.agg(F.count("*"), F.count_distinct("b")).first()
        if n == leaves and not edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
    stars = edges.select(F.col("b").alias("v"), F.col("a").alias("label"))
    return stars.unionAll(edges.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct())


class Shingles:
    """The shingles of a block's sets, numbered."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        flat = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]).any(1)
        self.table = flat[new]
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.first = np.append(np.flatnonzero(new), len(flat))  # of each number's owners
        numbers = np.empty(len(flat), np.int64)
        numbers[order] = np.cumsum(new) - 1
        self.of = np.split(numbers, np.cumsum(self.sizes)[:-1])

    def numbers(self, own: np.ndarray) -> np.ndarray:
        """Numbers of those of a set's shingles that the block has."""
        lo, hi = np.searchsorted(self.table[:, 0], own[:, 0]), np.searchsorted(self.table[:, 0], own[:, 0], "right")
        out, at, todo = [], lo, hi > lo
        while todo.any():  # more than once only where two shingles share the first lane
            k = np.flatnonzero(todo)
            out.append(at[k][self.table[at[k], 1] == own[k, 1]])
            at = at + 1
            todo = at < hi
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def linked(self, numbers: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Sets that a set of ``size`` shingles links to; one count over the lists of their owners gives all intersections."""
        lo, n = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        tail = np.cumsum(n)
        at = np.repeat(lo - tail + n, n) + np.arange(tail[-1] if len(tail) else 0)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + size - both)))


def _block_edges(percent: int):
    """Spanning forests of the links of whole blocks; rows are sorted by block."""

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        block, v = Shingles([_unpacked(r[2]) for r in rows]), [r[1] for r in rows]
        trees, out, done = Forest(len(rows)), [], np.zeros(len(rows), bool)
        # sets of many shared shingles first: they join most nodes, which then need no turn of their own
        shared = np.log2(np.diff(block.first))
        weight = np.array([shared[own].mean() for own in block.of])
        for i in np.argsort(-weight, kind="stable").tolist():
            roots = trees.flat()
            others = roots != roots[i]
            others[done] = False  # a set that had its turn has met all others
            if not others.any():
                if (roots == roots[0]).all():
                    break
                done[i] = True
                continue
            for j in block.linked(block.of[i], len(block.of[i]), percent).tolist():
                a, b = trees.root(i), trees.root(j)
                if a != b:
                    trees.up[max(a, b)] = min(a, b)
                    out.append((min(v[i], v[j]), max(v[i], v[j])))
            done[i] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "v", "shingles")), strict=True):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1 and (found := edges(held)):
                        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
                    held = []
                held.append(row)
        if len(held) > 1 and (found := edges(held)):
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _query_edges(percent: int):
    """Links between a block's nodes and the queries sent to it; rows are sorted by block, its nodes first.

    For each query one link into each component of the block's nodes is enough.
    """

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        members = [r for r in rows if not r[1]]
        if not members:
            return []
        block, out = Shingles([_unpacked(r[3]) for r in members]), []
        for _, is_query, v, shingles, label in rows:
            if not is_query:
                continue
            met, own = {label}, _unpacked(shingles)
            for j in block.linked(block.numbers(own), len(own), percent).tolist():
                if members[j][4] not in met:
                    met.add(members[j][4])
                    out.append((min(v, members[j][2]), max(v, members[j][2])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "query", "v", "shingles", "label")), strict=True):
                if held and held[-1][0] != row[0]:
                    if found := edges(held):
                        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
                    held = []
                held.append(row)
        if held and (found := edges(held)):
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def classes(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that it reaches by links.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets.  A null or empty
    text, or one without words, has an empty set and is linked with nothing; a very long text is one large
    set, and a block of its own where need be.  Rows that share a doc_id are
    one node of the graph; rows with a null id share one too, whose component_id is null where it is the
    smallest.  Extra columns are ignored; an empty table gives no rows.
    """
    threshold = percent / 100
    body = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), text_of(docs).alias("text"))
    profile, _ = staged(arrow_map(body, _profile(shingle), "id long, n_shingles long, digest binary, bands array<long>, packed binary"), "profiles")
    nodes = profile.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("v"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    total = profile.count()
    nodes, _ = staged(nodes, "nodes", total)

    # candidate groups
    banded = nodes.select("v", F.explode("bands").alias("key"))
    shared, _ = staged(banded.groupBy("key").agg(F.count("*").alias("size"), F.min("v").alias("center")).filter("size > 1"), "buckets", total)
    met, _ = staged(banded.join(shared, "key"), "met", 2 * total)
    small = met.filter(F.col("size") <= BUCKET).select("key", "v").join(nodes.select("v", "n", "packed"), "v")
    near = arrow_map(small.repartition("key").sortWithinPartitions("key", "v").select("key", "v", "n", "packed"), _bucket_edges(threshold), "a long, b long")
    star = met.filter(F.col("size") > BUCKET).select(F.col("center").alias("a"), F.col("v").alias("b"))
    groups, _ = staged(components(near.unionAll(star), 2 * total), "groups", total)

    # blocks of a group, and the sets of its nodes
    grouped = groups.withColumnRenamed("label", "g").join(nodes.select("v", "digest", "n"), "v")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * WIDTH / BLOCK_BYTES)).cast("int")
    sizes, _ = staged(grouped.groupBy("g").agg(blocks.alias("blocks")), "sizes", total)
    wanted = grouped.join(sizes, "g").withColumn("block", F.xxhash64("g", F.pmod(F.xxhash64("v"), F.col("blocks")))).select("g", "blocks", "block", "v", "digest")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shingle_sets(batch, shingle, _hashed)
            # an id may stand on several rows: take those with the node's set
            keep = [_digest(s) == d for s, d in zip(found, batch.column("digest").to_pylist(), strict=True)]
            rows = [packed_set(s) for s, k in zip(found, keep, strict=True) if k]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("g", "blocks", "block", "v")], pa.array(rows, pa.binary())], ["g", "blocks", "block", "v", "shingles"])

    texts = body.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("v")).select("g", "blocks", "block", "v", "digest", "text")
    members, _ = staged(arrow_map(texts, sets, "g long, blocks int, block long, v long, shingles binary"), "members")

    # links inside blocks, then of what is left with all blocks of its group
    by_block = members.select("block", "v", "shingles").repartition("block").sortWithinPartitions("block")
    edges, _ = staged(arrow_map(by_block, _block_edges(percent), "a long, b long"), "links")
    held = members.count()
    label, _ = staged(components(edges, held), "components", held)
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        label = _rounds(large, edges, label, percent, held)
    leader = profile.join(nodes.select("digest", "v"), "digest", "left").select("id", "n_shingles", F.coalesce("v", "id").alias("v"))
    # rows that share an id are one node, whichever of their sets was linked
    reached = leader.join(label, "v", "left").select("id", "n_shingles", F.coalesce("label", "v").alias("component"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return reached.select(back("id").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def _prefixes(percent: int):
    """Rows (g, block, v, shingles, counts): the shingles of each set that are rarest in its group, one row each.

    Two sets that share ``percent`` of their union share one of the n - ceil(n * percent / 100) + 1 rarest of
    either, in any order that both follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for g, block, v, own, counts in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "v", "shingles", "counts")), strict=True):
                n = len(own)
                first = sorted(zip(counts, own, strict=True))[: n - -(-n * percent // 100) + 1]
                rows += [(g, block, v, s) for _, s in first]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["g", "block", "v", "s"])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, v, shingles) as one row for each shingle."""
    for batch in batches:
        stored = batch.column("shingles").to_pylist()
        sizes = np.array([len(x) // WIDTH for x in stored], np.int64)
        at = pa.array(np.repeat(np.arange(len(stored)), sizes))
        each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), int(sizes.sum()), [None, pa.py_buffer(b"".join(stored))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("g", "block", "v")], each], ["g", "block", "v", "s"])


def _rounds(large: DataFrame, edges: DataFrame, label: DataFrame, percent: int, rows: int) -> DataFrame:
    """Components of ``edges``, which have ``label`` so far, and of the links between blocks of one group."""
    single = arrow_map(large.select("g", "block", "v", "shingles"), _single, "g long, block long, v long, s binary")
    counts, _ = staged(single.groupBy("g", "s").agg(F.count("*").alias("count")).filter("count > 1"), "shingle-counts")
    # a shingle of one set alone is as rare as can be; it links nothing, but takes its place in the prefix
    each = single.join(counts, ["g", "s"], "left").groupBy("g", "block", "v").agg(F.collect_list("s").alias("shingles"), F.collect_list(F.coalesce("count", F.lit(1))).alias("counts"))
    prefix, _ = staged(arrow_map(each, _prefixes(percent), "g long, block long, v long, s binary"), "prefixes")
    holders, _ = staged(prefix.join(counts.select("g", "s"), ["g", "s"], "left_semi").select("g", "s", "block").distinct(), "holders")
    meets, _ = staged(prefix.select("g", "s", "v").join(holders, ["g", "s"]).select("v", "block").distinct(), "meets")
    tested = None
    queries, turn = QUERIES, 0
    while True:
        now = large.select("g", "blocks", "block", "v").join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
        now, _ = staged(now, "state", rows)
        sizes = now.groupBy("g", "label").agg(F.count("*").alias("size"))
        main = sizes.groupBy("g").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        left = now.join(main, "g").filter("label <> main").select("g", "v")
        if tested is not None:
            left = left.join(tested, "v", "left_anti")
        left, _ = staged(left, "left", rows)
        if not left.limit(1).count():
            return label
        # about ``queries`` nodes of each group, drawn by a hash, so that no group is put in order
        share = left.groupBy("g").agg((F.lit(float(queries)) / F.count("*")).alias("share"))
        draw = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2**31)) / F.lit(float(2**31))
        chosen, _ = staged(left.join(share, "g").filter(draw < F.col("share")).select("g", "v"), "queries", rows)
        sent = chosen.join(large.select("v", "shingles"), "v").join(now.select("v", "label"), "v").join(meets, "v")
        sent = sent.select("block", F.lit(True).alias("query"), "v", "shingles", "label")
        home = large.join(now.select("v", "label"), "v").join(chosen.select("g").distinct(), "g", "left_semi").select("block", F.lit(False).alias("query"), "v", "shingles", "label")
        both = sent.unionAll(home).repartition("block").sortWithinPartitions("block", "query")
        found, _ = staged(arrow_map(both, _query_edges(percent), "a long, b long"), "round")
        if found.limit(1).count():
            edges = edges.unionAll(found)
            label, _ = staged(components(edges, rows), "components", rows)
        tested = chosen.select("v") if tested is None else tested.unionAll(chosen.select("v"))
        queries, turn = queries * 4, turn + 1


def kept(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """``docs``, with all their columns, without the rows that reach a smaller doc_id.

    Rows with a null id stay.  Rows that repeat one doc_id stay or go together.
    """
    with passing(docs.sparkSession) as folders:
        gone = classes(docs, percent, shingle).filter("doc_id <> component_id or component_id is null and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
        gone, path = staged(gone, "gone")
        folders.remove(path)
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col("_gone"), "left_anti")
