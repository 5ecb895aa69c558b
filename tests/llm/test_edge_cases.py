"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripwire.llm import decontaminate, fingerprints, language_id, licenses, minhash, mixing, pii, registry, substrings

BODY = " ".join(f"word{i} the of and" for i in range(60))
LONG = "The quick brown fox. " * 30_000
DOCS = [
    (1, "Plain words of the document one, written in a line. " + BODY, "en", "a", 10),
    (2, "Plain words of the document one, written in a line. " + BODY, "en", "a", 10),
    (2, "Plain words of the document one, written in a line. " + BODY, "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "", "de", "b", 0),
    (None, "No id, mail me at x.y@mail.example.com or +1 (212) 555-0199.", "en", None, 1),
    (6, "123 456 !!! ???", "fr", "b", 3),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Der Hund und die Katze sind im Garten", "de", "b", 5),
    (9, "a" * 50_000, "en", "b", 50_000),
    (10, "1" * 30_000, None, "b", 30_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["epoch", "score", "th", "node", "spans", "mix_key", "_tokens", "_block", "_language", "_text_hash", "hash", "m"]


def write(spark, folder, docs):
    docs = spark.createDataFrame(docs, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    some = bool(docs.count())
    spark.createDataFrame([(1, "Question of seven words and no more"), (None, None), (2, ""), (2, "")][:4 if some else 0],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (8, None, None)][:4 if some else 0],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    same = "<p>" + "y" * 1200
    pages = [(1, "http://a b\r\n", same), (2, None, same), (2, "u", same), (None, "u", same), (3, "u", None),
             (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 2_000_000)]
    spark.createDataFrame(pages if some else [], "page_id long, url string, html string").withColumn("payload", F.lit(1)) \
        .write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", "Hi."), (1, None, None, None), (None, 2, "assistant", ""), (1, 0, "user", "Hi.")]
    spark.createDataFrame(turns if some else [], "conv_id long, turn long, role string, text string") \
        .withColumn("fault", F.lit("x")).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), DOCS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


def rows(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_language(spark, edge):
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in rows(spark, "op1_language_id", edge)}
    assert {(3, "und", False), (4, "und", False), (6, "und", False), (8, "de", True)} <= got
    assert len(rows(spark, "op1_language_id", edge)) == len(DOCS)


def test_fingerprints(spark, edge):
    got = rows(spark, "op2_fingerprints", edge)
    assert len(got) == len(DOCS)
    order = sorted(DOCS, key=lambda d: (-(d[0] if d[0] is not None else -1), d[1] or ""))
    want = []
    for k, d in enumerate(order):
        t, n = d[1] or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want.append((d[0], len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert len({r.fingerprint for r in got}) == len({d[1] or "" for d in DOCS})
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_near_dedup(spark, edge):
    got = [(r.doc_id, r.class_id) for r in rows(spark, "op3_near_dedup", edge)]
    assert len(got) == len(DOCS)
    assert got.count((1, 1)) == 1 and got.count((2, 1)) == 2
    assert {(3, 3), (4, 3), (5, 3), (7, 7), (None, None)} <= set(got)
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    kept = [r.doc_id for r in minhash.dedup_stage(spark, docs, edge).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, None, 6, 7, 8, 9, 10]))


def test_decontamination(spark, edge):
    assert rows(spark, "op4_decontamination", edge) == []


def test_licenses(spark, edge):
    got = rows(spark, "op5_licenses", edge)
    assert len(got) == len(DOCS) and all(r.labels == "" and r.score == 0 and r.first_word is None for r in got)


def test_pii(spark, edge):
    got = {r.doc_id: r for r in rows(spark, "op6_pii", edge)}
    assert got[None].n_email == 1 and got[None].n_phone == 1
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[10].n_card == 0
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    text = {r.doc_id: r.text for r in pii.pii_stage(spark, docs, edge).collect()}
    assert text[None] == "No id, mail me at [EMAIL] or [PHONE]." and text[3] is None


def test_lm(spark, edge):
    got = {r.doc_id: r for r in rows(spark, "op7_lm_scoring", edge)}
    assert got[3].n_tokens == 0 and got[3].score is None and got[1].score < 0


def test_substrings(spark, edge):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows(spark, "op8_suffix_dedup", edge)]
    n = len(DOCS[0][1])
    assert got.count((2, n, n, 1)) == 2 and (1, n, n, 1) in got
    assert (7, len(LONG), len(LONG), 1) in got and (9, 50_000, 50_000, 1) in got and (3, 0, 0, 0) in got


def test_warc(spark, edge):
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows(spark, "op9_warc", edge)}
    assert got == {(1, 1203, "revisit", 2), (2, 1203, "response", None), (None, 1203, "revisit", 2),
                   (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None),
                   (6, 5, "response", None), (7, 4_000_000, "response", None)}


def test_mixing(spark, edge):
    got = rows(spark, "op10_mixing", edge)
    assert {r.source for r in got} <= {"a", "b", None} and sum(r.n_tokens for r in got) <= sum(len((d[1] or "").split()) for d in DOCS)


def test_stages_keep_columns(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, edge), name)
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, edge)
    assert set(columns) < set(last.columns) and {r.doc_id for r in last.collect()} <= {None, 1, 7, 8, 9, 2}
