"""The registered queries and the pipeline's stages over one table of odd rows, against brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import bytes_gone, held_in, licences, near_classes, plain_score, windows_gone
from pyspark.sql import functions as F
from test_fingerprints import expected as next_documents

import corpus_pipeline
from readalong.llm import queries, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, label string, score double"
NOTES = ["Released under the MIT License.", "licensed under the GNU General Public License, version 3. All rights reserved", "CC BY", "cc by nc 4 0"]


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def items(rows):
    r = random.Random(11)
    long = [(k, t[20:140]) for k, (_, t) in enumerate(rows) if t and len(t) > 200][:6]
    edited = [(50 + k, t[:30] + "x" + t[31:]) for k, t in long[:2]]
    return [*long, *edited, (70, "Two words"), (71, None), (72, ""), (73, "not there at all"), (74, r.randbytes(40).hex()), long[0]]


@pytest.fixture(scope="module")
def table(spark, rows, items, tmp_path_factory):
    """The odd rows, some with licence notes, as tables in a folder."""
    folder = tmp_path_factory.mktemp("tables")
    own = [(i, f"{t} {NOTES[k % 4]}" if k % 9 == 4 and t else t) for k, (i, t) in enumerate(rows)]
    docs = [(i, t, ("xx" if crc(i) % 5 == 0 else "de" if k % 2 else "en") if k % 7 else None, "s", len(t or ""), "c", "c", "c", 0.5) for k, (i, t) in enumerate(own)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(len(t or "") > 300), 0) for k, (i, t) in enumerate(own) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), own, labels


def of(spark, table, name, *columns):
    found = queries.queries()[name](spark, table[0])
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


def test_op1(spark, table):
    gone = bytes_gone(table[1])
    expected = [(i, gone[i][1], gone[i][2], len(gone[i][3]), hashlib.sha256(gone[i][4]).hexdigest()) for i, _ in table[1]]
    assert of(spark, table, "op1_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_op2(spark, table):
    found = near_classes(table[1], 85, 3)
    assert of(spark, table, "op2_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == sorted(((*found[i], found[i][2] == i) for i, _ in table[1]), key=repr)


def test_op3(spark, table):
    gone = windows_gone(table[1])
    expected = [(*gone[i][:3], hashlib.sha256(gone[i][3].encode()).hexdigest()) for i, _ in table[1]]
    assert of(spark, table, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)


def test_op4(spark, table):
    assert of(spark, table, "op4_canonical_digest", "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == sorted(next_documents(table[1]), key=repr)


def test_op5(spark, table):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, total = [], 0
    for i, t in table[1]:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = of(spark, table, "op5_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert sorted(r[:5] for r in found) == sorted(expected)
    bins = {}
    for r in found:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    assert len(bins) <= -(-total // 1024) + 1


def test_op6(spark, table):
    found = of(spark, table, "op6_language_id", "doc_id", "held_out", "lang_pred", "score")
    texts = dict(table[1])
    assert sorted(r[0] for r in found) == sorted(i for i, _ in table[1])
    for i, held_out, lang, score in found:
        assert held_out == (crc(i) % 5 == 0)
        assert (lang == "und") == (not any(c.isalpha() for c in texts[i] or ""))
        assert lang != "xx"  # a label of held-out rows only
        assert 0 <= score <= 1


def test_op7(spark, table, items):
    expected = sorted((i, *hit) for i, t in table[1] for hit in held_in(items, t))
    assert len(expected) > 8
    assert of(spark, table, "op7_benchmark_decontamination", "doc_id", "item_id", "edits") == sorted(expected, key=repr)


def test_op8(spark, table):
    walked = licences([t for _, t in table[1]])
    expected = []
    for (i, _), (n, places, base, labels, score) in zip(table[1], walked, strict=True):
        expected.append((i, n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 5)))
    found = of(spark, table, "op8_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(((*r[:7], round(r[7], 5)) for r in found), key=repr) == sorted(expected, key=repr)


def test_op9(spark, table, tmp_path):
    found = of(spark, table, "op9_quality_classifier", "doc_id", "held_out", "score", "predicted")
    assert sorted(r[0] for r in found) == sorted(i for i, _ in table[1])
    for i, held_out, score, predicted in found:
        assert held_out == (crc(i) % 4 == 2)
        assert predicted == (score >= 0.7)
    # labels of held-out rows don't matter
    other = str(tmp_path)
    spark.read.parquet(f"{table[0]}/documents.parquet").write.parquet(f"{other}/documents.parquet")
    flipped = [(i, 1 - q if crc(i) % 4 == 2 else q, t) for i, q, t in table[2]]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{other}/labels.parquet")
    assert of(spark, (other,), "op9_quality_classifier", "doc_id", "held_out", "score", "predicted") == found


def test_op10(spark, table, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in table[1]]
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert of(spark, table, "op10_token_counts", *columns) == sorted(expected, key=repr)
    spark.conf.set(queries.TOKEN_CACHE, f"file://{tmp_path}/counts")
    try:
        for _ in range(2):  # the second time nothing is encoded, and no run is added to the cache
            assert of(spark, table, "op10_token_counts", *columns) == sorted(expected, key=repr)
            assert len(list((tmp_path / "counts").iterdir())) == 1
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name, tmp_path, table):
    folder = str(tmp_path)
    spark.read.parquet(f"{table[0]}/documents.parquet").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = queries.queries()[name](spark, folder)
    columns = sorted(found.columns)
    twin = connection.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(twin)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_and_null_ids(spark, name, tmp_path):
    for k, docs in enumerate(([], [(None, "some text of no id", None, None, None, "c", "c", "c", 0.5), (3, None, None, None, None, "c", "c", "c", 0.5)])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "some text of no id")] * k, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert queries.queries()[name](spark, folder).count() == (k if name.startswith("op7") else len(docs))


@pytest.fixture(scope="module")
def documents(spark, table):
    return spark.read.parquet(f"{table[0]}/documents.parquet")


def test_stage_quality(spark, table, documents):
    model = quality.fit(documents, spark.read.parquet(f"{table[0]}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    kept = corpus_pipeline.quality_filter(spark, documents, table[0])
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in table[1] if plain_score(model, t or "") >= 0.7)


def test_stage_near_dedup(spark, table, documents):
    found = near_classes(table[1], 80, 5)
    kept = corpus_pipeline.near_dedup(spark, documents, table[0])
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in table[1] if found[i][2] == i)


def test_stage_suffix_dedup(spark, table, documents):
    gone = bytes_gone(table[1])
    kept = corpus_pipeline.suffix_dedup(spark, documents, table[0])
    assert kept.columns == documents.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for i, t in table[1]:
        _, n, removed, spans, rest = gone[i]
        if n and removed == n:
            assert i not in texts
        elif not removed or (t or "").isascii():
            assert texts[i] == (rest.decode() if t is not None else None)
        else:  # characters of which only some bytes would go stay whole
            assert len(rest) <= len(texts[i].encode()) <= len(rest) + 6 * len(spans)


def test_stage_decontaminate(spark, table, documents, items):
    kept = corpus_pipeline.decontaminate(spark, documents, table[0])
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in table[1] if not held_in(items, t))


def test_stage_pack(spark, table, documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, own = dict(table[1]), {}
    for r in corpus_pipeline.pack(spark, documents, table[0]).collect():
        own.setdefault(r["doc_id"], {})[r["piece"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(own[r["doc_id"]][r["piece"]]) == r["length"]
    for i, pieces in own.items():
        assert sum((pieces[k] for k in sorted(pieces)), []) == [*model.encode(texts[i] or "", add_special_tokens=False).ids, 2]
    assert set(own) == set(texts)


def test_run_is_its_stages(spark, table, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, table[0])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, table[0]).select(columns).collect()))


def test_stages_of_an_empty_table(spark, documents, table):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), table[0]).count() == 0
