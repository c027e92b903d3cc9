"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature's effect is a lookup table over its bins, and each chosen pair of features has a table over
both bins.  Tables are learned by cyclic boosting: in turn, each feature (then each pair) gets a shallow
tree fitted to what the others leave unexplained, and the tree's leaves are added into its table.  A
score is the sigmoid of a sum of table entries, looked up for a whole batch at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, buffers, slices, text_of, tune

#: Labelled rows to learn from, about; drawn by a hash of doc_id.  This bounds what reaches the driver.
SAMPLE_ROWS = 20_000
FEATURES = ("log_bytes", "word_length", "upper", "digit", "symbol", "stop", "comma", "shout", "bar", "beyond_ascii", "space", "newline", "other", "distinct_words", "distinct_pairs", "distinct_lines", "longest_word")
#: Byte classes that are counted: each is a feature as a share of the text.
CLASSES = (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("symbol", b"#$%&*+=@^~\\"), ("stop", b".?"), ("comma", b",;:"), ("shout", b"!"), ("bar", b"|<>{}[]_/"), ("space", b" \t"), ("newline", b"\n\r"))
BINS = 32
COARSE = 8
PAIRS = 8


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, (_, members) in enumerate(CLASSES, 1):
        table[list(members)] = k
    table[128:] = len(CLASSES) + 1
    table[97:123] = len(CLASSES) + 2
    return table


_CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text; all zero for an empty text."""
    raw, off = buffers(texts)
    n = np.diff(off)
    size = np.maximum(n, 1)
    width = len(CLASSES) + 3
    cell = _CLASS[raw] + np.repeat(np.arange(len(n)) * width, n)
    share = np.bincount(cell, minlength=len(n) * width).reshape(len(n), width) / size[:, None]
    named = {name: share[:, k] for k, (name, _) in enumerate(CLASSES, 1)}
    named |= {"beyond_ascii": share[:, len(CLASSES) + 1], "other": share[:, 0], "log_bytes": np.log1p(n)}
    words = np.zeros((len(n), 5))
    for i, text in enumerate(texts.to_pylist()):
        w = text.split()
        if w:
            lines = text.split("\n")
            sizes = list(map(len, w))
            words[i] = (sum(sizes) / len(w), len(set(w)) / len(w), len(set(zip(w, w[1:], strict=False))) / max(1, len(w) - 1), len(set(lines)) / len(lines), np.log1p(max(sizes)))
    named |= {name: words[:, k] for k, name in enumerate(("word_length", "distinct_words", "distinct_pairs", "distinct_lines", "longest_word"))}
    return np.stack([named[f] for f in FEATURES], 1)


def _cut(gradient: np.ndarray, weight: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best gain of a split of bins lo..hi, and the first bin of its right side."""
    g, h = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
    if hi - lo < 2:
        return 0.0, lo
    left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
    gain = left + right - g[-1] ** 2 / (h[-1] + 1)
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of a few leaves over the bins of one feature: the value of each bin."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        gain, k, at = max((*_cut(gradient, weight, *p)[:1], i, _cut(gradient, weight, *p)[1]) for i, p in enumerate(parts))
        if gain <= 1e-6:
            break
        lo, hi = parts.pop(k)
        parts += [(lo, at), (at, hi)]
    out = np.zeros(len(gradient))
    for lo, hi in parts:
        out[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + 1)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table: gain and the value of each cell."""
    g, h = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (gradient, weight))
    best, at = -1.0, (1, 1)
    for r in range(1, COARSE):
        for c in range(1, COARSE):
            gain = 0.0
            for r0, r1 in ((0, r), (r, COARSE)):
                for c0, c1 in ((0, c), (c, COARSE)):
                    s = g[r1, c1] - g[r0, c1] - g[r1, c0] + g[r0, c0]
                    gain += s * s / (h[r1, c1] - h[r0, c1] - h[r1, c0] + h[r0, c0] + 1)
            if gain > best:
                best, at = gain, (r, c)
    out = np.zeros_like(gradient)
    for rows in (slice(0, at[0]), slice(at[0], COARSE)):
        for cols in (slice(0, at[1]), slice(at[1], COARSE)):
            out[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + 1)
    return best, out


class Model:
    """Cuts and tables; ``score`` adds up the entries of a batch."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 12, rate: float = 0.2):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        bins = self._bins(x)
        total = np.full(len(y), self.base)
        chance = lambda: 1 / (1 + np.exp(-total))
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                p = chance()
                step = rate * _shallow(np.bincount(bins[j], y - p, len(table)), np.bincount(bins[j], p * (1 - p), len(table)))
                table += step
                total += step[bins[j]]
        coarse = self._coarse(bins)
        found = []
        for a, b in itertools.combinations(range(x.shape[1]), 2):
            found.append((self._grid(coarse, a, b, y, chance())[0], a, b))
        self.pairs = [(a, b) for _, a, b in sorted(found, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((COARSE, COARSE)) for _ in self.pairs]
        for _ in range(pair_rounds):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                step = rate * self._grid(coarse, a, b, y, chance())[1]
                table += step
                total += step[coarse[a], coarse[b]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]

    def _coarse(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [b * COARSE // (len(c) + 1) for b, c in zip(bins, self.cuts, strict=True)]

    def _grid(self, coarse: list[np.ndarray], a: int, b: int, y: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
        cell = coarse[a] * COARSE + coarse[b]
        return _quadrants(*(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        bins = self._bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        coarse = self._coarse(bins)
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); None without labels.

    About ``sample_rows`` labels are drawn by a hash of doc_id; the drawn labels, bounded by that as a label
    that repeats counts once, are sent to every executor.  Of the documents that share an id and a text one
    is learned from.  Null ids or labels are left out; a label without document is ignored; a null text is an
    empty one; texts may have any length.
    """
    tune(docs.sparkSession)
    labels = labels.filter("doc_id is not null and label is not null").select(F.col("doc_id").alias("labelled"), F.col("label").cast("int").alias("label")).distinct()
    n = max(1, labels.count())
    sample = labels.filter(F.pmod(F.xxhash64("labelled", F.lit(11)), F.lit(2**53)) < F.lit(min(1.0, sample_rows / n) * 2.0**53))
    joined = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    joined = joined.withColumn("tk", F.xxhash64("text")).dropDuplicates(["doc_id", "label", "tk"])
    rows = arrow_map(joined.select("label", "text"), _feature_rows, "label int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], r["x"]))  # the same model whatever order the tasks ended in
    return Model(np.stack([np.frombuffer(r["x"], "<f8") for r in rows]), np.array([float(r["label"]) for r in rows]))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and its score in 0 to 1; 0.5 if nothing was learned.

    A null text is an empty one, which has a score too.  Rows may repeat, and equal texts have equal scores;
    texts may have any length; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body for scoring"):
            texts = batch.column("body for scoring")
            s = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(s)], [*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return arrow_map(docs.select(*keep, text_of(docs).alias("body for scoring")), run, f"{schema}, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.7) -> DataFrame:
    """``docs``, with all their columns, without the rows that score less than ``least``; all rows if nothing was learned."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body for scoring"):
            good = model.score(features(batch.column("body for scoring"))) >= least
            yield batch.filter(pa.array(good)).drop_columns(["body for scoring"])

    return arrow_map(docs.withColumn("body for scoring", text_of(docs)), run, docs.schema)
