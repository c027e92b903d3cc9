"""Fingerprints against brute force."""

import hashlib

import pytest

from readalong.llm import fingerprints as fp

TEXTS = [(5, "Hello  World"), (1, None), (9, "hello\nworld"), (3, ""), (7, "ﬁne STRASSE"), (8, "fine straße"), (12, "Äb" * 500), (11, "日本語テキスト"), (20, "x" * 100_000), (9, "hello\nworld"), (30, " \t ")]


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), float(fp.canonical(new) == fp.canonical(t)), float(fp.canonical(following) == fp.canonical(t))))
    return sorted(out)


@pytest.mark.parametrize(("rows", "heavy"), [(TEXTS, 1000), (TEXTS * 3, 4), (TEXTS[:1], 1), (TEXTS[:2], 1000), ([], 1)])
def test_fingerprints(spark, rows, heavy, monkeypatch):
    monkeypatch.setattr(fp, "HEAVY", heavy)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string").repartition(3)
    found = fp.fingerprints(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found) == expected(rows)
    by = {r["doc_id"]: r["fingerprint"] for r in found}
    for i, t in rows:
        for j, u in rows:
            assert (by[i] == by[j]) == (fp.canonical(t or "") == fp.canonical(u or ""))


def test_colliding_digests_keep_apart_by_their_wide_digest():
    one, two = fp._digest(b"aaaa"), fp._digest(b"bbbb")
    assert one[0] != two[0]
    assert one[1] != two[1]
    assert len(one[0]) == 32


def test_packed_forms_are_equal_where_bytes_are():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"digest": ["a", "a", "a"], "text": ["Ab  c", "ab c", "ab d"]})
    forms = next(fp._forms(iter([batch]))).column("form").to_pylist()
    assert forms[0] == forms[1] != forms[2]
