"""Different texts stay different: patterns that defeat rolling hashes, and hashes narrowed until they collide."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from brute import bytes_gone, collected, near_classes, windows_gone
from readalong.llm import near_dedup, spans, substring_dedup, suffix_dedup


def thue_morse(n, flip=False):
    return "".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(n))


@pytest.fixture(scope="module")
def patterned(spark):
    """Texts that differ in words of 1024 and 2048 bytes only, and texts of two words in such an order."""
    rows = []
    for n in (1024, 2048):
        for flip in (False, True):
            rows.append((len(rows), " ".join(f"w{k} {thue_morse(n, flip)}" for k in range(15))))
            rows.append((len(rows), " ".join(thue_morse(16, flip)) + " tail of it"))
            rows.append((len(rows), f"{thue_morse(n, flip)} alone"))
    rows += [(20, " ".join(thue_morse(64))), (21, " ".join(thue_morse(64, True)))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_patterned_words(patterned):
    rows, docs = patterned
    expected = windows_gone(rows)
    assert collected(substring_dedup.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept") == sorted(expected.values())
    expected = near_classes(rows, 85, 3)
    assert collected(near_dedup.classes(docs, 85, 3), "doc_id", "n_shingles", "component_id") == sorted(expected.values())


def test_colliding_first_pass_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_short_key", lambda h: spans.settle_bits(h & np.uint64(255)))
    expected = windows_gone(rows)
    assert collected(substring_dedup.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept") == sorted(expected[i] for i, _ in rows)


@pytest.mark.parametrize("block", [1500, 3])
def test_colliding_first_lanes(docs, rows, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "_hashed", lambda d, size: near_dedup.lanes(d, size) & np.array([255, 2**61 - 1], np.uint64))
    expected = near_classes(rows, 85, 3)
    found = collected(near_dedup.classes(docs, 85, 3), "doc_id", "n_shingles", "component_id")
    assert [r[:2] for r in found] == sorted(expected[i][:2] for i, _ in rows)
    # one node's candidates may go astray where minima say so little, but no false link is made
    for i, _, c in found:
        assert expected[i][2] == expected[c][2]


def test_several_buckets_in_a_partition(docs, rows, monkeypatch):
    monkeypatch.setattr(spans, "MOST_PARTITIONS", 2)
    expected = windows_gone(rows)
    assert collected(substring_dedup.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept") == sorted(expected[i] for i, _ in rows)


def test_suffix_dedup_with_several_buckets_and_long_texts(docs, rows, monkeypatch):
    monkeypatch.setattr(spans, "MOST_PARTITIONS", 2)
    monkeypatch.setattr(suffix_dedup, "LONG", 700)
    check_bytes(docs, rows)


def check_bytes(docs, rows):
    expected = bytes_gone(rows)
    found = suffix_dedup.dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in found) == sorted(expected[i] for i, _ in rows)


@pytest.fixture(scope="module")
def footers(spark):
    r = random.Random(3)
    footer = "This page is part of a collection, and its owner likes you to read it."
    rows = [(k, f"{r.randbytes(60).hex()} {footer} {r.randbytes(40).hex()}") for k in range(1500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_a_footer_of_all_documents(footers):
    check_bytes(footers[1], footers[0])


def test_a_footer_does_not_meet_in_one_bucket(footers, monkeypatch):
    kept = []
    monkeypatch.setattr(suffix_dedup, "with_verdicts", lambda *a: kept.append(spans.with_verdicts(*a)) or kept[-1])
    monkeypatch.setattr(suffix_dedup, "drop_folder", lambda *a: None)
    suffix_dedup.dedup(footers[1]).count()
    entries, buckets = Counter(), Counter()
    for row in kept[0].filter(f"kind = {spans.ENTRY}").collect():  # the runs on their way to the anchors' buckets
        n = len(zstandard.decompress(bytes(row["places"]))) // 12
        entries.update(np.frombuffer(bytes(row["keys"])[: 8 * n], "<u8").tolist())
        buckets[row["route"], row["sub"]] += n
    assert len(entries) > 10_000
    assert max(entries.values()) <= 2 * suffix_dedup.OFTEN  # 1500 without parting
    assert max(buckets.values()) <= 2 * np.median(list(buckets.values()))


def test_an_anchor_of_many_slices_is_not_parted(spark, monkeypatch):
    r = random.Random(4)
    passage = "an ordinary part of sentences, shared by"  # shorter than a string
    rows = [(k, f"{r.randbytes(40).hex()} {passage} {r.randbytes(40).hex()}") for k in range(300)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 300), "doc_id long, text string")  # each a slice
    kept = []
    monkeypatch.setattr(suffix_dedup, "with_verdicts", lambda *a: kept.append(spans.with_verdicts(*a)) or kept[-1])
    monkeypatch.setattr(suffix_dedup, "drop_folder", lambda *a: None)
    assert suffix_dedup.dedup(docs).filter("n_removed > 0").count() == 0
    sizes = [len(zstandard.decompress(bytes(x["places"]))) // 12 for x in kept[0].filter(f"kind = {spans.ENTRY}").collect()]
    assert 300 <= sum(sizes) <= 300 * 8  # runs; otherwise each of their strings is one


def test_near_dedup_keeps_only_the_folder_that_it_still_reads(spark, docs):
    staged, taken = [], near_dedup.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "staged", lambda *a, **b: staged.append(taken(*a, **b)) or staged[-1])
        left = near_dedup.kept(docs, 80, 5)
    there = [path for _, path in staged if os.path.isdir(path.removeprefix("file:"))]
    assert len(staged) > 5 and there == [staged[-1][1]] and 0 < left.count() < docs.count()


def test_lanes_are_polynomials():
    x = np.random.default_rng(0).integers(0, spans.PRIME, (60, 2), dtype=np.uint64)
    for width in (1, 3, 7, 20):
        found = spans.lanes(x, width)
        for k, base in enumerate(spans.LANES):
            for i in range(len(found)):
                assert int(found[i, k]) == sum(int(x[i + j, k]) * pow(base, width - 1 - j, spans.PRIME) for j in range(width)) % spans.PRIME


def test_names_of_documents_are_packed_small():
    r = np.random.default_rng(2)
    ids = np.sort(r.choice(3_000_000, 400, replace=False))
    docs = np.empty(400, spans.DOC)
    docs["id"], docs["tk"], docs["db"] = ids, 0, r.integers(0, 600, 400)
    packed = spans.zip_docs(docs)
    assert (spans.unzip_docs(packed) == docs).all() and len(packed) < 5 * len(docs)
    odd = np.array([(spans.NULL_ID, -1, 0), (2**63 - 1, spans.NULL_ID, 2**31 - 1), (-5, 2**63 - 1, 7), (0, 0, 0)], spans.DOC)
    for table in (odd, odd[:1], odd[:0], odd[3:]):
        assert (spans.unzip_docs(spans.zip_docs(table)) == table).all()


def test_verdicts_of_documents_from_many_rows():
    r = random.Random(6)
    known, plain = spans.Verdicts(), {}
    where = spans.Layout(1, 1, 1)
    for _ in range(30):
        docs = np.array(r.sample([(i, t, 0) for i in range(12) for t in (0, 5)], 6), dtype="i8")
        docs = np.array([tuple(d) for d in docs.tolist()], spans.DOC)
        doc, start, size = (np.array([r.randrange(n) for _ in range(9)]) for n in (6, 1000, 40))
        for row in spans.verdict_rows(docs, doc, start, size, where):
            known.add(row[3], row[4])
        for d, a, b in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
            plain.setdefault((int(docs["id"][d]), int(docs["tk"][d])), []).append((a, b))
    keys = [(i, t) for i in range(14) for t in (0, 5)] + [(3, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])], ["id", "tk"])
    named, start, size = known.of(batch)
    expected = sorted((n, a, b) for n, key in enumerate(keys) for a, b in plain.get(key, ()))
    assert sorted(zip(named.tolist(), start.tolist(), size.tolist(), strict=True)) == expected
    assert not len(spans.Verdicts().of(batch)[0])


def test_ids_alone_name_documents_where_none_repeats(spark):
    named = lambda rows: {r["tk"] for r in spans.keyed(spark.createDataFrame(rows, "doc_id long, text string"), spans.Layout(3, 3, 1)).collect()}
    assert named([(1, "a"), (2, "b"), (None, "c")]) == {0}
    assert len(named([(1, "a"), (1, "b")])) == 2 and len(named([(None, "a"), (None, "b")])) == 2
    assert named([]) == set()
