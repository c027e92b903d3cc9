"""Each operator against brute force on a small table with nulls, ties, repeated rows, copies and extra columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brute import bytes_gone, collected, levenshtein_in, near_classes, plain_score, windows_gone
from readalong.llm import decontamination, language_id, license_scan, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts

def test_substring_dedup(docs, rows):
    expected = windows_gone(rows)
    assert collected(substring_dedup.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept") == sorted(expected[i] for i, _ in rows)


def test_suffix_dedup(docs, rows):
    expected = bytes_gone(rows)
    found = suffix_dedup.dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in found) == sorted(expected[i] for i, _ in rows)


def test_suffix_dedup_rewrites_texts(docs, rows):
    expected = bytes_gone(rows)
    found = suffix_dedup.rewritten(docs)
    assert found.columns == docs.columns
    kept = {r["doc_id"]: r for r in found.collect()}
    for i, t in rows:
        _, n, gone, _, rest = expected[i]
        if n and gone == n:
            assert i not in kept
        elif not gone:
            assert kept[i]["text"] == t
        else:
            assert len(kept[i]["text"].encode()) >= len(rest)
            assert kept[i]["n_chars"] == len(kept[i]["text"])


@pytest.mark.parametrize("shallow", [8, 16, 32])
def test_deep_shallow_order(shallow):
    r = random.Random(shallow)
    text = bytes(r.choice(b"ab") for _ in range(400)) * 2 + bytes(r.choice(b"abc") for _ in range(300))
    places = np.array(r.sample(range(len(text) - 50), 600))
    order, classes = suffix_dedup.deep_shallow(text, places, 50, shallow)
    prefix = [text[s : s + 50] for s in order.tolist()]
    assert prefix == sorted(prefix)
    assert [a == b for a, b in zip(prefix, prefix[1:], strict=False)] == [a == b for a, b in zip(classes, classes[1:], strict=False)]
    assert sorted(order.tolist()) == sorted(places.tolist())


@pytest.mark.parametrize(("block", "bucket", "queries"), [(1500, 2000, 512), (3, 4, 2)])
def test_near_dedup(docs, rows, monkeypatch, block, bucket, queries):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "QUERIES", queries)
    expected = near_classes(rows, 85, 3)
    assert collected(near_dedup.classes(docs, 85, 3), "doc_id", "n_shingles", "component_id") == sorted(expected[i] for i, _ in rows)


def test_near_dedup_keeps_one_of_each(docs, rows):
    expected = near_classes(rows, 80, 5)
    kept = near_dedup.kept(docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id") == sorted((i,) for i, _ in rows if expected[i][2] == i)


def test_signature_estimate():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**61, (4000, 2), dtype=np.uint64) for _ in range(2)]
    near = np.concatenate([sets[0][:3800], sets[1][:200]])
    _, packed = near_dedup.signatures([sets[0], near, sets[1]])
    to_first = near_dedup.estimate(packed, packed[:1])
    assert to_first[0] == 1
    assert abs(to_first[1] - 3800 / 4200) < 0.15
    assert to_first[2] < 0.2


def test_packing(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    pieces = packing.packed_documents(docs, path).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        copies = sum(j == i for j, _ in rows)
        for k in range(len(own) // copies):
            part = [p for p in own if p["piece"] == k]
            assert len(part) == copies
            p = part[0]
            chunk = ids[i][p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(chunk, "<u4").tobytes())
            assert p["length"] == len(chunk) == (1024 if k else (len(ids[i]) - 1) % 1024 + 1)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(p["length"] for p in pieces)
    assert len(sequences) <= -(-total // 1024) + 2


def test_packing_constraints():
    r = random.Random(2)
    counts = {n: r.randint(1, 30) for n in r.sample(range(1, 65), 40)}
    for rule in ("norm", "dot"):
        limits = packing.Limits(64, 3, 64 * 64, rule=rule)
        bins = {}
        for length, _, n, first, each, offset in packing.plan(counts, limits).tolist():
            for k in range(n):
                bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(len(b) for b in bins.values()) == sum(counts.values())
        for own in bins.values():
            assert len(own) <= 3
            assert sum(n for _, n in own) <= 64
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_packing_weights_choose_bins():
    r = random.Random(1)
    lengths = [r.randint(20, 700) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    least = -(-sum(lengths) // 1024)
    plans = []
    for weights in ((1.0, 0.0, 0.0), packing.Limits().weights, (1.0, 5.0, 5.0)):
        found = packing.plan(counts, packing.Limits(weights=weights))
        plans.append(found.tolist())
        assert int((found[:, 3] + (found[:, 2] - 1) // np.maximum(found[:, 4], 1)).max()) + 1 <= least + 2
    assert plans[0] != plans[1]
    few = packing.plan(counts, packing.Limits(documents=2))
    assert int((few[:, 3] + (few[:, 2] - 1) // np.maximum(few[:, 4], 1)).max()) + 1 >= 200


def test_ids_equal_the_library_on_whole_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), packing.Encoder(path, 2)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*model.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), packing.Encoder(path, 2)
    r = random.Random(4)
    parts = ["a", "b ", " ", "\n", "é", "#", "12", "'s", ".", "\t", "<|endoftext|>", " ", "x y", "  ", "日本", "'ll ", " ", "word,", " Word."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*model.encode(text, add_special_tokens=False).ids, 2], text


@pytest.mark.parametrize("few", [50_000, 0])
def test_token_counts(docs, rows, tmp_path, monkeypatch, few):
    import sentencepiece

    monkeypatch.setattr(token_counts, "FEW", few)
    monkeypatch.setattr(token_counts, "HEAVY", 20)  # the text that stands most often counts as heavy
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert collected(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == expected
    assert len(list((tmp_path / "cache").iterdir())) == 1  # the second time all counts are stored: nothing is encoded
    stored = docs.sparkSession.read.parquet(f"{cache}/run-*")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})


def test_warm_token_counts_move_no_text(spark, docs, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    token_counts.count_tokens(docs, path, cache).count()
    plan = token_counts.count_tokens(docs, path, cache)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("text" in line for line in exchanged)


def test_decontamination(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(r.randint(8, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "too short")]
    items.append(items[0])
    texts = [None, "", prose(2000)]
    for k, item in items[:12]:
        for edits in (0, 2, 6, 40):
            changed = list(item)
            for _ in range(edits):
                changed[r.randrange(len(changed))] = r.choice("xyz")
            texts.append(f"{prose(15)}\n{''.join(changed).upper() if k % 2 else ''.join(changed)}  {prose(15)}")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for k, text in enumerate(texts):
        for number, item in set(items):
            f = decontamination.folded(item or "")
            if len(f) >= decontamination.LEAST_CHARS:
                d = levenshtein_in(f, decontamination.folded(text or ""))
                if d <= decontamination.budget(f):
                    expected.add((k, number, d))
    assert set(collected(decontamination.matches(table, bench), "doc_id", "item_id", "edits")) == expected
    left = {k for k, _ in enumerate(texts)} - {k for k, _, _ in expected}
    assert {r[0] for r in collected(decontamination.clean(table, bench), "doc_id")} == left


def test_decontamination_by_short_items(spark):
    items = [(0, "Who  wrote Emma?"), (1, "x = 2"), (2, "首都は"), (3, "Yes"), (4, "\n"), (5, None), (6, "23 characters long text"), (7, "été")]
    texts = ["so: who wrote\nEMMA? Austen", "who wrote emma", "max = 25, x = 2", "max = 25", "日本の首都は東京", "yesterday, YES", "yesterday eyes", "", None, "a 23 characters long text.", "a 23 characters long texts", "L'ÉTÉ", "étés"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {(0, 0, 0, 0, 19), (2, 1, 0, 0, 15), (4, 2, 0, 0, 6), (5, 3, 0, 0, 14), (9, 6, 0, 0, 25), (11, 7, 0, 0, 5)}
    assert set(collected(decontamination.matches(table, bench), "doc_id", "item_id", "edits", "budget", "end_char")) == expected
    assert {r[0] for r in collected(decontamination.clean(table, bench), "doc_id")} == set(range(len(texts))) - {r[0] for r in expected}


def test_license_scan(spark, docs, rows):
    notes = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "cc-by CC BY, all  rights\nreserved", "cc bye all rights", "General public licenses", "CCé by cc by", "Licensed under the Apache License, Version 2.0. cc by", "mit license"]
    more = [(1000 + k, n) for k, n in enumerate(notes)] + [(2000 + k, f"{t or ''} {n}") for k, ((_, t), n) in enumerate(zip(rows, notes * 3, strict=False))]
    table = docs.select("doc_id", "text", "label").unionAll(spark.createDataFrame([(i, t, "z") for i, t in more], "doc_id long, text string, label string"))
    found = {r["doc_id"]: r for r in license_scan.scan(table).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in [*rows, *more]:
        words = word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES:
            parts = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        own = found[i]
        assert (own["n_words"], own["n_base"], own["first_word"], own["last_word"], own["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(own["labels"].split(",")) | {""}
        for label, _, phrases in license_scan.TEMPLATES:
            if label in own["labels"].split(",") and label not in labels:
                assert any(all(f" {p} " in f" {' '.join(words)} " for p in ps) for lab, _, ps in license_scan.TEMPLATES if lab == label)
        assert 0 <= own["score"] <= 1
    assert "mit" in found[1000]["labels"] and "gpl-3.0" in found[1001]["labels"] and "apache-2.0" in found[1006]["labels"]


def test_license_scan_finds_every_template_of_a_file(spark):
    templates = [template for _, template, _ in license_scan.TEMPLATES]
    own = sorted({w for t in templates for w in t.split()} - license_scan.COMMON)
    joined = [". ".join(templates), " ... ".join(reversed(templates)) * 2, " ".join(phrases[0] for _, _, phrases in license_scan.TEMPLATES)]
    for order in (own, own[::-1]):  # each word in as many files as its place says, so that all have IDFs of their own
        texts = joined + [" ".join(order[k:]) for k in range(len(order))]
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in license_scan.scan(table).collect():
            words = re.findall(license_scan.WORD, texts[r["doc_id"]])
            stands = lambda p, at, words=words: at >= 0 and words[at : at + len(p)] == p
            expected = set()
            for label, template, phrases in license_scan.TEMPLATES:
                parts, phrase = template.split(), phrases[0].split()
                i = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
                expected |= {(label, at - i) for at in range(len(words)) if stands(phrase, at)}
            labels = {label for phrase, label in license_scan.BASE_PHRASES if any(stands(phrase.split(), at) for at in range(len(words)))}
            assert {(p["label"], p["first_word"]) for p in r["places"]} == expected
            assert r["labels"] == ",".join(sorted(labels | {label for label, _ in expected}))
            if r["doc_id"] < 2:
                assert r["score"] == 1 and {label for label, _ in expected} == {label for label, _, _ in license_scan.TEMPLATES}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 5 <> 0"))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id % 5 = 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_without_letters(spark, docs, rows, empty):
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    said = {r["doc_id"]: r["lang_pred"] for r in found}
    assert len(found) == len(rows)
    for i, t in rows:
        assert said[i] == ("en" if any(c.isalpha() for c in t or "") else "und")
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def plain_margins(model, text):
    """Decisions of a language model's machines, by a walk over the text's bytes."""
    low = text.lower().encode()
    letters = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in low)
    body = re.sub(" +", " ", letters).strip(" ").encode("latin-1")
    framed = b"    " + body + b" " if body else b"    "
    size = language_id.BUCKETS // 2
    bits = 32 - size.bit_length() + 1
    table = np.zeros(language_id.BUCKETS)
    for k in range(3, len(framed)):
        three = sum(framed[k - j] << 8 * j for j in range(3))
        four = three + (framed[k - 3] << 24)
        table[(three * 2654435769 & 0xFFFFFFFF) >> bits] += 1
        table[size + ((four * 2246822519 & 0xFFFFFFFF) >> bits)] += 1
    return model.weights.astype(float) @ table / (len(framed) - 3) * language_id.SCALE + model.bias


def test_language_margins_by_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    texts = [r["text"] for r in docs.limit(40).collect() if r["text"]]
    import pyarrow as pa

    found = model.margins(pa.array(texts, pa.string()))
    for text, own in zip(texts, found, strict=True):
        assert np.allclose(own, plain_margins(model, text), atol=1e-3)


def test_language_rates_of_any_size(spark):
    ids = spark.range(400_000)
    for n in (1e3, 8e7, 1e13):  # 500 of so many
        found = ids.filter(language_id.drawn(500, F.lit(n), "id")).count()
        expected = 400_000 * min(1.0, 500 / n)
        assert abs(found - expected) <= 5 * expected**0.5 + 1e-3 * 400_000 * (n < 1e4)
    row = spark.createDataFrame([(1, "das ist ein Text", "de")] * 50 + [(2, "this is a text", "en")] * 70, "doc_id long, text string, lang string")
    model = language_id.fit(row, per_lang=0)  # nothing is drawn, as of rows that repeat without end
    assert {r["lang_pred"] for r in language_id.predict(row, model).collect()} == {"de", "en"}
    assert language_id.fit(row, most_langs=1).members == {"germanic": ["en"]}


def test_quality_scores_by_a_plain_walk(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 2"))
    held = quality.score(docs, model).join(labels, "doc_id").filter("doc_id % 4 = 2").collect()
    assert sum((r["score"] >= 0.7) == (r["label"] == 1) for r in held) >= 0.98 * len(held)


def test_quality_tables_add_up():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.Model(x, y, rounds=10, pair_rounds=30)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_edge_cases(spark, docs, rows, empty):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert quality.fit(docs, labels.limit(0)) is None
    kept = quality.accepted(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["score"] >= 0.5 for r in found)


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.rewritten(empty).count() == 0
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.kept(empty).count() == 0
    assert packing.packed_documents(empty, path).count() == 0
    assert token_counts.count_tokens(empty, path).count() == 0
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.clean(empty, bench).count() == 0
    assert license_scan.scan(empty).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f " * 30), (4, "a b c d e f " * 30), (None, None)], "doc_id long, text string")
    assert [r["n_removed"] > 0 for r in substring_dedup.dedup(docs).collect() if r["doc_id"] == 4] == [True]
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup(docs).collect()) == [0, 0, 360]
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in near_dedup.classes(docs).collect()) == [(False, None), (True, None), (True, None)]
    assert packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 3
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 3
