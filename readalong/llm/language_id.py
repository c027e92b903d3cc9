"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family, one against the rest, picks the family; inside
it, one-versus-one machines separate the closely related languages by votes.  Features are hashed
three- and four-byte grams of the lower-cased text with everything but letters folded to one space,
taken as shares of the text, so that a machine's decision over a whole text is a mean of table entries:
prediction reads each text once, at any length, without building a vector for it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, buffers, slices, text_of, tune

#: Language families by ISO 639-1 code; any other label is a family of its own.  Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
#: Rows of training text for each language, about; the sample is drawn by a hash of doc_id and text.
SAMPLE_PER_LANG = 500
#: Languages that are learned, the most frequent ones: this bounds the machines and what reaches the driver.
MOST_LANGS = 200
#: Size of the feature tables, a power of two.
BUCKETS = 4096
#: Shares are small; this factor brings them to the scale of the bias.
SCALE = 32.0
LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    """The family of a label."""
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def _table() -> np.ndarray:
    """Byte to folded byte: letters and bytes beyond ASCII stay, others become a space."""
    table = np.full(256, 32, np.uint8)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = np.arange(lo, hi)
    return table


_FOLD = _table()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of three-byte grams, of four-byte grams, gram offsets of each text).

    Each text is framed by a space; runs of other characters count as one space.
    """
    import pyarrow.compute as pc

    lowered = pc.utf8_lower(texts)
    framed = pc.binary_join_element_wise(pa.scalar("    ", lowered.type), lowered, pa.scalar(" ", lowered.type), pa.scalar("", lowered.type))
    raw, off = buffers(framed)
    folded = _FOLD[raw]
    # four spaces in front of each text: its grams start at the last of them, so none reaches into the text before
    space = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = off[:-1]
    for k in range(4):
        keep[starts + k] = True
    kept = np.flatnonzero(keep)
    new_off = np.searchsorted(kept, off)
    x = folded[kept].astype(np.uint32)
    three = x.copy()
    three[1:] += x[:-1] << 8
    three[2:] += x[:-2] << 16
    four = three.copy()
    four[3:] += x[:-3] << 24
    shift = np.uint32(32 - (BUCKETS // 2).bit_length() + 1)
    a = (three * np.uint32(2654435769)) >> shift
    b = ((four * np.uint32(2246822519)) >> shift) + np.uint32(BUCKETS // 2)
    own = np.ones(len(a), bool)
    for k in range(3):
        own[new_off[:-1] + k] = False
    return a[own], b[own], new_off - 3 * np.arange(len(new_off))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum between neighbouring offsets; every text has some grams, as it is framed."""
    return np.add.reduceat(values, off[:-1], dtype=np.float64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, b, off = grams(batch.column("text"))
        rows = []
        for i in range(batch.num_rows):
            n = off[i + 1] - off[i]
            rows.append(np.bincount(np.concatenate([a[off[i] : off[i + 1]], b[off[i] : off[i + 1]]]), minlength=BUCKETS).astype(np.float32) / n)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["lang", "vector"])


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps; y is 1 or -1.

    Both classes weigh the same in total.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.random.default_rng(0).normal(size=z.shape[1])
    for _ in range(8):  # the largest curvature, by power iteration
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    top = 2 * c * float(np.linalg.norm(z.T @ (weight * (z @ v)))) + 1e-3
    w = np.zeros(z.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        g = 1e-3 * ahead - 2 * c * (z.T @ (weight * y * slack))
        nxt = ahead - g / top
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return w[:-1], float(w[-1])


class Model:
    """Family machines, then the machines of each pair of languages of a family."""

    def __init__(self, langs: list[str], x: np.ndarray):
        names = sorted(set(langs))
        label = np.array(langs)
        family = np.array([family_of(v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: [v for v in names if family_of(v) == f] for f in self.families}
        machines = []
        self.first: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], int] = {}
        if len(self.families) > 1:
            for f in self.families if len(self.families) > 2 else self.families[:1]:
                self.first[f] = len(machines)
                machines.append(svm(x, np.where(family == f, 1.0, -1.0)))
        for f in self.families:
            for one, two in itertools.combinations(self.members[f], 2):
                rows = (label == one) | (label == two)
                self.pairs[one, two] = len(machines)
                machines.append(svm(x[rows], np.where(label[rows] == one, 1.0, -1.0)))
        self.weights = np.array([w for w, _ in machines], np.float32).reshape(len(machines), BUCKETS)
        self.bias = np.array([b for _, b in machines])

    def margins(self, texts: pa.Array) -> np.ndarray:
        """One row for each text, one column for each machine."""
        a, b, off = grams(texts)
        n = np.diff(off)
        out = np.empty((len(n), len(self.bias)))
        for k, w in enumerate(self.weights):
            out[:, k] = (_sums(w[a], off) + _sums(w[b], off)) / n * SCALE + self.bias[k]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages, and the product of both levels' certainty as a score in (0, 1)."""
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        m = self.margins(texts)
        n = len(texts)
        if not self.first:
            chosen, score = np.zeros(n, int), np.ones(n)
        elif len(self.first) == 1:
            p = sure(m[:, 0])
            chosen, score = np.where(p >= 0.5, 0, 1), np.maximum(p, 1 - p)
        else:
            each = sure(np.stack([m[:, self.first[f]] for f in self.families], 1))
            chosen, score = each.argmax(1), each.max(1) / np.maximum(each.sum(1), 1e-9)
        out = np.empty(n, object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            votes = np.zeros((len(rows), len(self.members[f])))
            games = max(1, len(self.members[f]) - 1)
            for (one, two), machine in self.pairs.items():
                if one in self.members[f]:
                    p = sure(m[rows, machine])
                    votes[:, self.members[f].index(one)] += p
                    votes[:, self.members[f].index(two)] += 1 - p
            best = votes.argmax(1) if len(rows) else np.zeros(0, int)
            out[rows] = np.array(self.members[f], object)[best]
            if len(self.members[f]) > 1 and len(rows):
                score[rows] *= votes.max(1) / games
        return list(out), np.clip(score, 0, 1)


def drawn(most: int, n, *columns: str):
    """Whether a row is among about ``most`` of ``n``, by a hash of ``columns``; exact for any n below 2**53."""
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(2**53)) < F.lit(float(most)) / n * F.lit(float(2**53))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, most_langs: int = MOST_LANGS) -> Model | None:
    """Learn from (doc_id, text, lang); None if no row has a language.

    About ``per_lang`` rows of each of the ``most_langs`` most frequent languages are drawn by a hash, or all
    where there are fewer, and a row that repeats is drawn once; that is the bound on what reaches the driver
    (BUCKETS floats a row).  A language of which nothing was drawn, as its rows repeat so often, gives its
    least row by that hash.  Null texts are empty, texts may have any length, and ties of counts go by name.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", text_of(docs).alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and doc_id is not null").withColumn("tk", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    n = F.create_map(*[F.lit(v) for lang, rows in counts.items() for v in (lang, float(rows))])[F.col("lang")]

    def vectors(sample: DataFrame) -> list[tuple[str, bytes]]:
        rows = arrow_map(sample.dropDuplicates(["lang", "doc_id", "tk"]).select("lang", "text"), _vectors, "lang string, vector binary").collect()
        return [(r["lang"], r["vector"]) for r in rows]

    rows = vectors(docs.filter(n.isNotNull() & drawn(per_lang, n, "doc_id", "tk")))
    if missing := sorted(set(counts) - {lang for lang, _ in rows}):
        own = docs.filter(F.col("lang").isin(missing))
        least = own.groupBy("lang").agg(F.min_by(F.struct("doc_id", "tk"), F.xxhash64("doc_id", "tk", F.lit(7))).alias("k")).collect()
        same = reduce(lambda a, b: a | b, [(F.col("lang") == r["lang"]) & (F.col("doc_id") == r["k"]["doc_id"]) & (F.col("tk") == r["k"]["tk"]) for r in least])
        rows += vectors(own.filter(same))
    rows.sort()  # the same model whatever order the tasks ended in
    x = np.stack([np.frombuffer(v, "<f4") for _, v in rows]).astype(np.float64) * SCALE
    return Model([lang for lang, _ in rows], x)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: ``und`` and 0 where the text is null or has no letter, or nothing was learned.

    Rows may repeat and ids may be null; texts may have any length; extra columns are ignored; an empty
    table gives no rows.  Of languages with equal votes the first by name is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            if model is None:
                langs, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                langs, score = model.predict(texts)
            for i, text in enumerate(texts.to_pylist()):
                if not LETTER.search(text):
                    langs[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", text_of(docs).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
