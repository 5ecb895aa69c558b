"""Ids above 2**53 beside null ids come through every operator and stage as they are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripwire.llm import registry

BIG = 1 << 53
SAME = "The passage that stands in two documents, word for word, is long enough to be removed. " * 8
DOCS = [
    (BIG + 1, SAME + "One end, mail me at x.y@mail.example.com for more of it.", "en", "a", 1),
    (BIG + 3, "Another beginning of a text that is not like the first. " * 9 + SAME, "en", "a", 2),
    (None, "A text of its own that nobody has written before, mit license, with some words more. " * 3, "en", "b", 3),
    ((1 << 62) + 1, "Der Hund und die Katze sind im Garten, und das Haus steht am Fluss. " * 3, "de", "b", 4),
]
IDS = {d[0] for d in DOCS}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1) \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(BIG + 1, "What is the name of the river that runs behind the old house of the miller?"), (None, None)],
                          "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(BIG + 1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1) \
        .write.parquet(f"{path}/labels.parquet")
    page = "<p>" + "y" * 1200
    spark.createDataFrame([(BIG + 1, "u", page), (BIG + 3, "u", page), (None, "u", page), (BIG + 5, "u", "short")],
                          "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(BIG + 1, 0, "user", "Why?"), (BIG + 3, BIG + 1, "user", "Why?"), (None, None, "user", "Why?")],
                          "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in ("op4_decontamination", "op9_warc", "op11_conversations", "op12_spelling")))
def test_queries(spark, folder, name):
    got = {r.doc_id for r in registry.QUERIES[name](spark, folder).collect()}
    assert got <= IDS and (name == "op10_mixing" or got == IDS)


def test_repeats_and_classes(spark, folder):
    removed = {r.doc_id: r.n_removed for r in registry.QUERIES["op8_suffix_dedup"](spark, folder).collect()}
    assert min(removed[BIG + 1], removed[BIG + 3]) >= len(SAME.strip()) and removed[None] == 0
    assert {r.doc_id: r.class_id for r in registry.QUERIES["op3_near_dedup"](spark, folder).collect()} == {i: i for i in IDS}


def test_pages_and_conversations(spark, folder):
    got = {r.page_id: (r.record_type, r.refers_to) for r in registry.QUERIES["op9_warc"](spark, folder).collect()}
    assert got == {BIG + 1: ("revisit", BIG + 3), BIG + 3: ("response", None), None: ("revisit", BIG + 3), BIG + 5: ("response", None)}
    got = {r.conv_id for r in registry.QUERIES["op11_conversations"](spark, folder).collect()}
    assert got == {BIG + 1, BIG + 3, None}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = {r.doc_id for r in stage(spark, docs, folder).select(F.col("doc_id").cast("long")).collect()}
        assert kept == IDS, name
