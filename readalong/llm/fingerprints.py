"""Document fingerprints: a canonical exact digest.

A text is brought to a canonical form (Unicode NFKC, case folding, white space as single spaces) and gets a
128-bit xxhash of its UTF-8 bytes.  Documents with equal digests form a bucket, and inside a bucket the
canonical bytes are compared; a bucket that holds different bytes gets longer fingerprints.  Edited texts,
which are not kept, are compared with the documents and with each other by the SHA-256 of their canonical
bytes.  Fingerprints are exact: the likeness of two is 1 if the canonical bytes are equal, else 0.

Documents are also compared with the next one by doc_id.  Range partitions are sorted and read in one pass;
the few rows at their ends, two for each partition, are matched afterwards.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, slices, staged, text_of
from readalong.llm.spans import NULL_ID, layout

PAIRED, LAST, FIRST = 0, 1, 2
#: A digest is heavy if more than one row in so many has it; fewer digests than this can be.
HEAVY = 1000
_ROWS = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("id", pa.int64()), ("tk", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("wide", pa.binary()), ("edited_digest", pa.string()), ("edited_wide", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_SQL = "kind int, pid int, id long, tk long, n_chars long, edited_sha256 string, digest string, wide binary, edited_digest string, edited_wide binary, near_edited double, near_next double, text string"


def canonical(text: str) -> bytes:
    """The canonical form's UTF-8 bytes."""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter of code points is replaced by as many of the next text's first, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _digest(form: bytes) -> tuple[str, bytes]:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form), hashlib.sha256(form).digest()


def _pair(row: tuple, following: tuple) -> tuple:
    """Result of a document (id, tk, text, canonical form) and the next one."""
    key, tk, text, form = row
    new = edited(text, following[2])
    new_form = canonical(new)
    return (PAIRED, None, key, tk, len(text), hashlib.sha256(new.encode()).hexdigest(), *_digest(form), *_digest(new_form), float(new_form == form), float(following[3] == form), None)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but the last; its first and last rows with their texts."""
    pid, before = TaskContext.get().partitionId(), None
    for batch in slices(batches):
        rows = []
        for key, tk, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "text")), strict=True):
            row = (key, tk, text, canonical(text))
            if before is None:
                rows.append((FIRST, pid, key, tk, *[None] * 8, text))
            else:
                rows.append(_pair(before, row))
            before = row
        yield _as_batch(rows)
    if before is not None:
        yield _as_batch([(LAST, pid, before[0], before[1], *[None] * 8, before[2])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, tk, text, following in zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "text", "following")), strict=True):
            rows.append(_pair((key, tk, text, canonical(text)), (None, None, following, canonical(following))))
        yield _as_batch(rows)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed canonical bytes: equal exactly where the bytes are."""
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([zstandard.compress(canonical(t), 1) for t in batch.column("text").to_pylist()], pa.binary())], ["digest", "form"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next row by doc_id, then by a hash of the text; null ids come first, and the
    last row is followed by the first (a single row by itself); rows that repeat both follow each other.  Null texts are empty; all texts without
    anything but white space share one fingerprint.  Extra columns are ignored; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    n = layout(docs).partitions
    text = text_of(docs)
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    found, _ = staged(arrow_map(rows.repartitionByRange(n, "id", "tk").sortWithinPartitions("id", "tk"), _neighbours, _SQL), "neighbours")
    # one number for each partition, of which there are MOST_PARTITIONS at most
    used = sorted(r["pid"] for r in found.filter(F.col("kind") == FIRST).select("pid").collect())
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "pid int, next_pid int")
    last = found.filter(F.col("kind") == LAST).join(after, "pid").select("id", "tk", "text", "next_pid")
    first = found.filter(F.col("kind") == FIRST).select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    done = found.filter(F.col("kind") == PAIRED).unionAll(arrow_map(last.join(first, "next_pid").select("id", "tk", "text", "following"), _ends, _SQL)).drop("kind", "pid", "text")
    done, _ = staged(done, "digests")

    # byte comparison inside buckets of equal digests; those of heavy ones are found where they are, the others meet by digest
    total = done.count()
    shared, _ = staged(done.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    heavy = F.broadcast(shared.filter(F.col("n") * HEAVY > total).select("digest"))
    light = shared.filter(F.col("n") * HEAVY <= total).select("digest")
    narrow = done.select("id", "tk", "digest")
    members = narrow.join(heavy, "digest", "left_semi").unionAll(narrow.join(heavy, "digest", "left_anti").join(light, "digest", "left_semi"))
    members = members.select(F.col("id").alias("m_id"), F.col("tk").alias("m_tk"), "digest").distinct()
    texts = rows.join(members.hint("shuffle_hash"), (F.col("id") == F.col("m_id")) & (F.col("tk") == F.col("m_tk"))).select("digest", "text")
    forms = arrow_map(texts, _forms, "digest string, form binary")
    wide = done.select("digest", F.col("wide").alias("form")).unionAll(done.select("edited_digest", "edited_wide"))
    differing = [x.groupBy("digest").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).filter("lo <> hi").select("digest") for x in (forms, wide)]
    mixed, _ = staged(differing[0].unionAll(differing[1]).distinct(), "collisions")
    fingerprint, other = F.col("digest"), F.col("edited_digest")
    if mixed.limit(1).count():
        done = done.join(mixed.withColumn("c1", F.lit(True)), "digest", "left").join(mixed.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("c2")), "edited_digest", "left")
        fingerprint = F.when(F.col("c1"), F.concat("digest", F.lit("-"), F.lower(F.hex("wide")))).otherwise(F.col("digest"))
        other = F.when(F.col("c2"), F.concat("edited_digest", F.lit("-"), F.lower(F.hex("edited_wide")))).otherwise(F.col("edited_digest"))
    return done.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), other.alias("edited_fingerprint"), "near_edited", "near_next")
