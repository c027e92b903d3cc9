"""Chunks matched to page words, highlights, and the alignment of spoken with printed words."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a token may skip, window of 3 m but at least 24 words, least score and matched tokens.
LOOKAHEAD, SPREAD, LEAST_WINDOW, LEAST_SCORE, LEAST_TOKENS = 6, 3, 24, 0.33, 4
#: UTF-8 bytes of passages that one pass over the documents takes.
BLOCK_BYTES = 4 << 20
#: Passages that are looked up at once, and uses of their tokens in documents that one pass holds.
GROUP, MOST_USES = 256, 1 << 20
#: Runs of places in which chains are counted at once.
RUNS = 1024
#: Chunks that one row brings to a worker.
CHUNKS_PER_ROW = 1024
#: Words of a document up to which all starts are tried at once.
FEW_WORDS = 2048
MATCHES = "doc_id long, chunk_index long, score double, span int, matched array<int>, n_matched int, n_tokens int"


def _best(chunk: list[str], places: dict[str, np.ndarray], n: int, lookahead: int, starts: np.ndarray | None = None) -> tuple[int, int, list[int]] | None:
    """(start, span, matched places) of the best start, or None if no start matches enough.

    From each start every token takes its first place among the next words before the window's end, or
    none.  Most tokens matched wins, then the shortest span, then the first start.

    A start that matches k of m tokens misses m - k, so of any m - k + 1 tokens it matches one, whose place
    stands in its window.  Starts are tried around the places of the rarest tokens, of one, two, four and so
    on, until these are more than a start that is at least as good as the best can miss; in a short document
    around all of them at once.  With ``starts``, which hold all that match enough, only these are tried.
    """
    m = len(chunk)
    window = max(SPREAD * m, LEAST_WINDOW)
    least = max(min(LEAST_TOKENS, m), math.ceil(LEAST_SCORE * m))
    none = np.zeros(0, int)
    best = _best_of(starts, chunk, places, n, lookahead, window) if starts is not None else None
    rarest = sorted(chunk, key=lambda w: len(places.get(w, none))) if starts is None else []
    tried = np.zeros(n, bool)
    k, used = 0, 0
    while starts is None and k < (most := m - max(least, -best[0] if best else 0) + 1):
        k = most if n <= FEW_WORDS else min(max(1, 2 * k), most)
        around = np.zeros(n + 1, int)
        for token in dict.fromkeys(rarest[used:k]):
            own = places.get(token, none)
            np.add.at(around, np.maximum(0, own - window + 1), 1)
            np.add.at(around, own + 1, -1)
        used = k
        start = np.flatnonzero((np.cumsum(around[:-1]) > 0) & ~tried)
        tried[start] = True
        if found := _best_of(start, chunk, places, n, lookahead, window):
            best = min(best, found) if best else found
    if best is None or -best[0] < least:
        return None
    return best[2], best[1], _matched(best[2], chunk, places, n, lookahead, window)


def _best_of(start: np.ndarray, chunk: list[str], places: dict[str, np.ndarray], n: int, lookahead: int, window: int) -> tuple[int, int, int] | None:
    """(minus tokens matched, span, start) of the best of some starts, all advanced together."""
    limit = np.minimum(n, start + window)
    at, first, count = start.copy(), np.full(len(start), -1), np.zeros(len(start), int)
    for token in chunk:
        own = places.get(token)
        if own is None:
            continue
        k = own.searchsorted(at)
        p = own.take(k, mode="clip")
        hit = (p >= at) & (p <= at + lookahead) & (p < limit)
        np.copyto(first, p, where=hit & (first < 0))
        np.copyto(at, p + 1, where=hit)
        count += hit
    if not count.any():
        return None
    span = np.where(count > 0, at - first, n + 1)
    s = int(np.lexsort((start, span, -count))[0])
    return -int(count[s]), int(span[s]), int(start[s])


def _matched(start: int, chunk: list[str], places: dict[str, np.ndarray], n: int, lookahead: int, window: int) -> list[int]:
    """The places that one start matches."""
    matched, j, limit = [], start, min(n, start + window)
    for token in chunk:
        own = places.get(token)
        k = np.searchsorted(own, j) if own is not None else 0
        if own is not None and k < len(own) and own[k] <= j + lookahead and own[k] < limit:
            matched.append(int(own[k]))
            j = int(own[k]) + 1
    return matched


def _places(said: list[str]) -> dict[str, np.ndarray]:
    """Where each word stands."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(said):
        places.setdefault(w, []).append(i)
    return {w: np.array(p) for w, p in places.items()}


def _row(doc: int, index: int, chunk: list[str], places: dict[str, np.ndarray], n: int, lookahead: int, starts: np.ndarray | None = None) -> list[tuple]:
    """The row of a chunk that matches, or none."""
    m = len(chunk)
    found = _best(chunk, places, n, lookahead, starts) if m and n else None
    if found:
        return [(doc, index, len(found[2]) / m, found[1], found[2], len(found[2]), m)]
    return []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32())
    names = ["doc_id", "chunk_index", "score", "span", "matched", "n_matched", "n_tokens"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def match_chunks(chunks: DataFrame, words: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """(doc_id, chunk_index, score, span, matched, n_matched, n_tokens): the best match of each chunk's tokens.

    ``chunks`` has tokens ``chunk``, ``words`` one array ``words`` for each document.  Every word is a
    possible start.  An Arrow worker gets a document's words with up to ``CHUNKS_PER_ROW`` of its chunks, so
    that a long document is the work of several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, parts, said in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "chunks", "words")), strict=True):
                places = _places(said)
                for part in parts:
                    rows += _row(doc, part["chunk_index"], part["chunk"], places, len(said), lookahead)
            yield _batch(rows)

    own = F.struct(F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
    parts = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / CHUNKS_PER_ROW).alias("part")).agg(F.collect_list(own).alias("chunks"))
    return bounded(parts.join(words.select("doc_id", "words"), "doc_id").select("doc_id", "chunks", "words")).mapInArrow(run, MATCHES)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends at most so many rows or bytes to a Python worker at once, as a row may hold a whole document."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))):
        df.sparkSession.conf.set(key, value)
    return df


def word_arrays(printed: DataFrame) -> DataFrame:
    """(doc_id, words): each document's words (word_idx, norm) in order."""
    return printed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "norm"))), lambda x: x["norm"]).alias("words"))


class Passages:
    """A group of passages (index, tokens), indexed by token, that says which documents may match which of them.

    What a start matches stands at places of a passage's tokens that are at most ``lookahead`` + 1 apart.  So
    a document's places of those tokens are cut where they are farther apart, and a passage may match only
    where one run of places holds as many of its tokens as the least match has, and a chain of so many
    in their order.  Runs longer than two windows are cut into ones that overlap by a window.
    """

    def __init__(self, passages: list[tuple[int, list[str]]], lookahead: int) -> None:
        self.passages, self.reach = passages, lookahead + 1
        self.least = np.array([max(min(LEAST_TOKENS, len(c)), math.ceil(LEAST_SCORE * len(c))) for _, c in passages], int)
        self.window = np.array([max(SPREAD * len(c), LEAST_WINDOW) for _, c in passages], int)
        held: dict[str, dict[int, list[int]]] = {}
        for p, (_, chunk) in enumerate(passages):
            for i, token in enumerate(chunk):
                held.setdefault(token, {}).setdefault(p, []).append(i)
        self.tokens = pa.array(held, pa.string())
        self.count = np.array([len(x) for x in held.values()], int)
        self.first = np.cumsum(self.count) - self.count
        uses = [(p, at) for x in held.values() for p, at in x.items()]
        self.passage = np.array([p for p, _ in uses], np.int16)
        self.bits = np.zeros((-(-max(len(c) for _, c in passages) // 64), len(uses)), np.uint64)
        for u, (_, at) in enumerate(uses):
            for i in at:
                self.bits[i >> 6, u] |= np.uint64(1 << (i & 63))

    def candidates(self, words: pa.Array, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, passage, starts) of those that may match, with all starts that may; document d has words off[d] to off[d + 1]."""
        import pyarrow.compute as pc

        coded = words.dictionary_encode("encode")
        token = pc.index_in(coded.dictionary, self.tokens).fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        uses = np.concatenate([[0], np.cumsum(np.where(token >= 0, self.count[token], 0))])[off]
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(uses, uses[lo] + MOST_USES, "right")) - 1)
            for d, p, starts in self._runs(token[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                yield lo + d, p, starts
            lo = hi

    def _runs(self, token: np.ndarray, off: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        place = np.flatnonzero(token >= 0)
        token = token[place]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[place]
        count = self.count[token]
        use = np.repeat(self.first[token] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if not len(use):
            return []
        order = np.argsort(self.passage[use], kind="stable")
        use = use[order]
        at = np.repeat(place + doc * self.reach, count)[order]  # documents stand apart
        passage = self.passage[use]
        begins = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (at[1:] - at[:-1] > self.reach)]))
        size = np.diff(np.append(begins, len(use)))
        window = self.window[passage[begins]]
        parts = np.maximum(1, -(-size // window) - 1)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        before = part * np.repeat(window, parts)
        begins, size = np.repeat(begins, parts) + before, np.minimum(np.repeat(size, parts) - before, 2 * np.repeat(window, parts))
        long = size >= self.least[passage[begins]]
        begins, size = begins[long], size[long]
        if not len(begins):
            return []
        inner = np.cumsum(size) - size
        rows = np.repeat(begins - inner, size) + np.arange(size.sum())
        found = sum(np.bitwise_count(np.bitwise_or.reduceat(bits[use[rows]], inner)).astype(int) for bits in self.bits)
        enough = found >= self.least[passage[begins]]
        begins, size = begins[enough], size[enough]
        if len(self.bits) == 1:
            chained = self._chained(begins, size, self.bits[0][use], at, self.least[passage[begins]])
            begins, size = begins[chained], size[chained]
        owner = np.repeat(doc, count)[order[begins]]
        shift = owner * self.reach + off[owner]
        found = {}
        for d, p, lo, hi in zip(owner.tolist(), passage[begins].tolist(), (at[begins] - shift).tolist(), (at[begins + size - 1] - shift).tolist(), strict=True):
            found.setdefault((d, p), []).append(np.arange(max(0, lo - self.reach + 1), hi + 1))
        return [(d, p, np.unique(np.concatenate(starts))) for (d, p), starts in found.items()]

    def _chained(self, begins: np.ndarray, size: np.ndarray, bits: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each run has a chain of ``least`` tokens in their order, each near the one before.

        For each place and length the tokens that may follow a chain that ends there: those behind the earliest last one.
        """
        done = np.zeros(len(begins), bool)
        by = np.argsort(-size, kind="stable")
        one = np.uint64(1)
        for lo in range(0, len(by), RUNS):
            own = by[lo : lo + RUNS]
            need = least[own] - 1
            n, most = len(own), int(least[own].max())
            near = deque([(np.zeros(n, int) - 2 * self.reach, np.zeros((most, n), np.uint64))], self.reach)
            ends = np.searchsorted(-size[own], -np.arange(int(size[own[0]])), "left")
            for step, n in enumerate(ends.tolist()):  # the runs that are longer than the step
                row = begins[own[:n]] + step
                here = at[row]
                follow = np.zeros((most, n), np.uint64)  # by the length of the chain before
                for there, after in near:
                    close = (here - there[:n] <= self.reach).astype(np.uint64)
                    follow |= after[:, :n] & (~close + one)
                follow[0] = ~np.uint64(0)
                follow &= bits[row]
                done[own[:n]] |= follow[need[:n], np.arange(n)] != 0
                low = follow & (~follow + one)
                low |= low - one
                after = np.zeros((most, n), np.uint64)
                np.invert(low[:-1], out=after[1:])
                near.append((here, after))
        return done


def match_passages(passages: DataFrame, words: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """As ``match_chunks``, of every passage (chunk_index, chunk) with every document (doc_id, words).

    No document moves: passages go to the workers in blocks of a fixed size.  A passage is scanned for in
    a document only where enough of its tokens stand close enough together (``Passages``).
    """
    passages = passages.select(F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
    total = passages.agg(F.sum(F.octet_length(F.array_join("chunk", " ")))).first()[0] or 0
    n = math.ceil(total / BLOCK_BYTES)
    out = words.sparkSession.createDataFrame([], MATCHES)
    for k in range(n):
        block = [(r["chunk_index"], r["chunk"]) for r in passages.filter(F.pmod(F.xxhash64("chunk_index", "chunk"), F.lit(n)) == k).collect() if r["chunk"]]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            groups = [Passages(block[i : i + GROUP], lookahead) for i in range(0, len(block), GROUP)]
            for batch in batches:
                docs, column = batch.column("doc_id").to_pylist(), batch.column("words")
                sizes = [x or 0 for x in column.value_lengths().to_pylist()]
                off, said = np.concatenate([[0], np.cumsum(sizes)]), column.flatten()
                places: dict[int, dict[str, np.ndarray]] = {}
                rows: list[tuple] = []
                for group in groups:
                    for d, p, starts in group.candidates(said, off):
                        if d not in places:
                            places[d] = _places(said.slice(off[d], sizes[d]).to_pylist())
                        rows += _row(docs[d], *group.passages[p], places[d], sizes[d], lookahead, starts)
                yield _batch(rows)

        out = out.unionAll(bounded(words.select(F.col("doc_id").cast("long").alias("doc_id"), "words")).mapInArrow(run, MATCHES))
    return out


def highlights(matches: DataFrame, words: DataFrame) -> DataFrame:
    """One box for each match whose words stand on one page; ``words`` has word_idx, page_index and a normalised box."""
    placed = matches.select("doc_id", "chunk_index", "score", "n_matched", "n_tokens", F.explode("matched").alias("word_idx")).join(words, ["doc_id", "word_idx"])
    boxes = placed.groupBy("doc_id", "chunk_index").agg(
        F.min("page_index").alias("page_index"), F.count_distinct("page_index").alias("n_pages"), F.min("nx0").alias("nx0"), F.min("ny0").alias("ny0"), F.max("nx1").alias("nx1"), F.max("ny1").alias("ny1"),
        F.round(F.max("score"), 4).alias("match_score"), F.max("n_matched").alias("matched_tokens"), F.max("n_tokens").alias("query_tokens"),
    )
    return boxes.filter("n_pages = 1").drop("n_pages")


def polygon(box: Column) -> Column:
    """The four corners of a box x0, y0, x1, y1."""
    return F.array(*[F.array(box[a], box[b]) for a, b in ((0, 1), (2, 1), (2, 3), (0, 3))])


def coverage(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_mapped, coverage): share of all chunks that have a highlight, in percent."""
    totals = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    mapped = found.groupBy("doc_id").agg(F.count("*").alias("n_mapped"))
    both = totals.join(mapped, "doc_id", "left").withColumn("n_mapped", F.coalesce("n_mapped", F.lit(0)))
    return both.withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("n_mapped") * 100.0, F.col("n_chunks")), 2), F.lit(0.0)))


def align_words(spoken: DataFrame, printed: DataFrame, lookahead: int = 8) -> DataFrame:
    """(doc_id, spoken_idx, printed_idx) of words that two pointers bring together.

    Both inputs have one array ``tokens`` for each document.  The pointers are a sequential automaton, so
    each document is one step of an Arrow worker; nothing is grouped.  A document without one side has no
    rows.
    """

    def pairs(one: list[str], two: list[str]) -> Iterator[tuple[int, int]]:
        i = j = 0
        while i < len(one) and j < len(two):
            if one[i] == two[j]:
                yield i, j
                i, j = i + 1, j + 1
                continue
            ahead = next((k for k in range(j + 1, min(j + 1 + lookahead, len(two))) if two[k] == one[i]), None)
            if ahead is not None:
                j = ahead
                continue
            ahead = next((k for k in range(i + 1, min(i + 1 + lookahead, len(one))) if one[k] == two[j]), None)
            if ahead is not None:
                i = ahead
                continue
            i, j = i + 1, j + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for doc, one, two in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "spoken", "printed")), strict=True):
                for i, j in pairs(one or [], two or []):
                    for column, value in zip(rows, (doc, i, j), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32())], ["doc_id", "spoken_idx", "printed_idx"])

    both = spoken.select("doc_id", F.col("tokens").alias("spoken")).join(printed.select("doc_id", F.col("tokens").alias("printed")), "doc_id")
    return bounded(both).mapInArrow(run, "doc_id long, spoken_idx int, printed_idx int")


def spoken_words(recognised: DataFrame, estimated: DataFrame) -> DataFrame:
    """Words (doc_id, word_idx, norm, start, end) of each document from the recogniser, or estimated ones where it gave none, with ``timing_source``."""
    heard = recognised.select("doc_id").distinct()
    columns = ["doc_id", "word_idx", "norm", "start", "end"]
    first = recognised.select(*columns).withColumn("timing_source", F.lit("forced-whisper"))
    return first.unionByName(estimated.join(heard, "doc_id", "left_anti").select(*columns).withColumn("timing_source", F.lit("estimated-chunk")))


def page_words(from_metadata: DataFrame, scanned: DataFrame) -> DataFrame:
    """Words (doc_id, word_idx, norm) of each document from its metadata, or from a scan where that gave none, with ``word_source``."""
    there = from_metadata.select("doc_id").distinct()
    columns = ["doc_id", "word_idx", "norm"]
    first = from_metadata.select(*columns).withColumn("word_source", F.lit("metadata"))
    return first.unionByName(scanned.join(there, "doc_id", "left_anti").select(*columns).withColumn("word_source", F.lit("scan")))
