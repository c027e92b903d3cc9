"""Packing of tokenised documents into fixed-length sequences by vector best-fit.

Every piece of a document asks a bin for tokens, a document place and attention cost (length squared);
a bin has a capacity of each.  Pieces are taken longest first, and each goes into the open bin that fits
it under every constraint and leaves the least weighted residual norm (or has the greatest weighted dot
product of residual and demand); a new bin opens only where none fits.

Lengths are whole numbers up to the capacity, so all pieces of a length are alike: the choice is made on
counts per length, for ranges of like bins at once.  The driver sees at most ``capacity`` counts and
makes a plan whose size follows the number of lengths, not of documents; executors number the pieces of
each length (salted, so that a length held by a third of all rows is numbered by many tasks) and look up
their place in the plan.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, partitions, slices, staged, text_of

PIECES = "piece int, start long, length long, ids binary"
#: Distinct words a worker remembers before it starts anew.
MEMORY = 500_000


class Encoder:
    """Token ids of whole texts, as a ``tokenizers`` file gives them, with a memory of the words met.

    A byte-level pre-tokenizer always breaks before a space that stands between two other characters, so
    the parts between such spaces are encoded once each and their ids are joined.  A part's merges are
    done by ``tiktoken`` with ranks taken from the same file, where its merges are in the order of their
    ids, as then both libraries give the same ids (the tests hold them against each other).  Texts in
    which a space meets other white space, or with characters that don't print or a special token's
    string, and all texts under another kind of tokenizer, are encoded whole by ``tokenizers``.
    """

    def __init__(self, path: str, end: int):
        import json
        import os

        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path) as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.merge, self.widths = _merger(made)
        self.end = end
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.full(1, self.end, np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)  # entry 0 is the end mark

    def _plain(self, text: str) -> bool:
        if self.merge is None or "  " in text or " \n" in text or "\n " in text or any(s in text for s in self.special):
            return False
        return text.isprintable() or text.replace("\n", " ").isprintable()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end mark, as unsigned 32-bit numbers."""
        import pyarrow.compute as pc

        if len(self.place) > MEMORY:
            self._forget()
        whole = {k: self.model.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if t and not self._plain(t)}
        plain = pa.array(["" if k in whole else t for k, t in enumerate(texts)], pa.large_string())
        # every part but the first has its space in front; the empty parts of an empty text or before a leading space have no ids
        parts = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        counts = np.diff(parts.offsets.to_numpy())
        coded = pc.dictionary_encode(parts.flatten())
        distinct = coded.dictionary.to_pylist()
        entry = np.fromiter(map(self.place.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            entry[missing] = self._learn([distinct[i] for i in missing.tolist()])
        at = np.insert(entry[coded.indices.to_numpy()], np.cumsum(counts), 0)  # the end mark of each text
        size = self.sizes[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        out = np.split(ids, ends[np.cumsum(counts + 1) - 1][:-1]) if len(counts) else []
        for k, found in whole.items():
            out[k] = np.array([*found, self.end], np.uint32)
        return out

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Encode parts that are new; their entries.  Parts with a space in front are encoded in one run, which breaks before each of them."""
        after = [p for p in parts if p[:1] == " "]
        firsts = [p for p in parts if p[:1] != " "]
        ids = [np.array(self.merge("".join(after)), np.uint32)]
        wide = np.cumsum([len(p.encode()) for p in after])
        sizes = np.diff(np.searchsorted(np.cumsum(self.widths[ids[0]]), wide, "right"), prepend=0) if after else np.zeros(0, np.int64)
        more = [np.array(self.merge(p), np.uint32) for p in firsts]
        sizes = np.concatenate([sizes, np.array([len(x) for x in more], np.int64)])
        entries = len(self.place) + 1 + np.arange(len(parts))
        self.place.update(zip([*after, *firsts], entries.tolist(), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *ids, *more])
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """This worker process's encoder of a file, with what it remembers from earlier tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _merger(made: dict):
    """A function from a text to its ids, and the bytes of each id; None where the file is not plain byte-level BPE in id order."""
    splitter, model = made["pre_tokenizer"] or {}, made["model"]
    if made["normalizer"] is not None or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or splitter.get("add_prefix_space"):
        return None, None
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None, None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in made["added_tokens"]}
    shown = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})  # bytes that byte-level BPE shows as themselves; the rest follow from U+0100 on
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in special}
    if merged != sorted(merged) or len(set(merged)) != len(merged) or set(ranks.values()) != set(range(len(ranks))):
        return None, None
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level pre-tokenizer's
    return tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary, np.array([len(t) for t, _ in sorted(ranks.items(), key=lambda x: x[1])])


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int = 2, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids) of every row: the ids of each piece as little-endian unsigned 32-bit numbers.

    A document is its ids and the end mark; only longer ones than ``capacity`` are cut, into pieces of
    ``capacity``, of which the first takes what is left over.  A null or empty text is the end mark alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, end)
        for batch in slices(batches):
            rows: dict[str, list] = {"id": [], "piece": [], "start": [], "length": [], "ids": []}
            for key, ids in zip(batch.column("id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                first = (len(ids) - 1) % capacity + 1
                for k, hi in enumerate(range(first, len(ids) + 1, capacity)):
                    lo = max(0, hi - capacity) if k else 0
                    rows["id"].append(key)
                    rows["piece"].append(k)
                    rows["start"].append(lo)
                    rows["length"].append(hi - lo)
                    rows["ids"].append(ids[lo:hi].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("id", batch.column("id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_map(docs.select(docs[id_column].alias("id"), text_of(docs, text).alias("text")), run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_column)


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weight of each residual.

    By default only the tokens can bind: 1024 tokens hold at most 1024 pieces, and the sum of the squared
    lengths is at most the square of their sum.  The other two then only choose among bins that fit.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"  # or "dot"


def plan(counts: dict[int, int], limits: Limits) -> np.ndarray:
    """Rows (length, first rank, ranks, first bin, pieces of the length in each bin, offset) that place all pieces.

    Bins are numbered from 0.  Ranges of bins with the same contents are handled as one.
    """
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    left = np.zeros((0, 3))  # residual capacities of each range of bins
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        todo, rank, need = counts[length], 0, np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while todo:
            fits = np.flatnonzero((left >= need).all(1) & (many > 0))
            if len(fits):
                after = (left[fits] - need) / caps
                value = -(weights * after**2).sum(1) if limits.rule == "norm" else ((left[fits] / caps) * (need / caps) * weights).sum(1)
                k = int(fits[value.argmax()])
                n = int(min(todo, many[k]))
                rows.append((length, rank, n, first[k], 1, limits.tokens - int(left[k, 0])))
                if n < many[k]:  # the rest of the range keeps its residual
                    left, first, many = np.vstack([left, left[k]]), np.append(first, first[k] + n), np.append(many, many[k] - n)
                    many[k] = n
                left[k] = left[k] - need
                todo, rank = todo - n, rank + n
                continue
            each = int((caps // need).min())
            n, rest = divmod(todo, each)
            for width, size in ((each, n), (rest, 1)):
                if width and size:
                    rows.append((length, rank, size * width, bins, width, 0))
                    left, first, many = np.vstack([left, caps - width * need]), np.append(first, bins), np.append(many, size)
                    bins, rank = bins + size, rank + size * width
            todo = 0
        open_ = left[:, 0] > 0
        left, first, many = left[open_], first[open_], many[open_]
    return np.array(rows, np.int64).reshape(len(rows), 6)


def pack(pieces: DataFrame, limits: Limits = Limits(), order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:  # noqa: B008
    """``pieces`` (any columns, with ``length``) and their ``sequence_id`` and ``offset``.

    ``pieces`` is read three times, so it should be a stored table.  ``order`` numbers the pieces of a
    length; ties may stand in any order.  No pieces: no rows.  Columns named like the added ones clash.
    """
    tune_partitions = max(16, partitions(pieces))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(tune_partitions)).cast("int"))
    cells = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = Counter({r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    placed = plan(counts, limits)
    # at most capacity * salts cells, whatever the input
    before = cells.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = pieces.withColumn("_rank", F.row_number().over(own)).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_salt", "_before")
    key = placed[:, 0] * 2**44 + placed[:, 1]
    by = np.argsort(key)
    key, placed = key[by], placed[by]
    names = [c for c in ranked.columns if c != "_rank"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            row = placed[np.searchsorted(key, length * 2**44 + rank, "right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(row[:, 3] + k // np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + k % np.maximum(row[:, 4], 1) * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(ranked, look_up, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end: int = 2, keep_ids: bool = False) -> DataFrame:  # noqa: B008
    """Tokenise ``docs`` (doc_id, text) once and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``keep_ids`` also ``ids``, the piece's ids as little-endian unsigned 32-bit numbers.  Null texts are
    empty, rows and ids may repeat or be null, texts may have any length, extra columns are ignored; an empty
    table gives an empty result.
    """
    pieces = tokenised(docs, tokenizer_path, limits.tokens, end).withColumn("ids_crc32", F.crc32("ids"))
    pieces, _ = staged(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, limits, ("doc_id", "piece", "start", "ids_crc32"))
