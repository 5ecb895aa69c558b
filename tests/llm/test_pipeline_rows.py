"""Which rows every stage of the pipeline lets through, on planted documents."""

import random

import corpus_pipeline


def test_decisions_take_effect(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(400)]

    def prose(n=120):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    clean = {i: prose() for i in range(1, 25)}
    item = "Which of the " + prose(25) + " is meant here?"
    near = clean[3].split()
    near[60] = "changed"
    planted = {
        100: clean[1],                                   # an exact copy
        101: " ".join(near),                             # one word of 120 changed
        102: prose(40) + " " + item + " " + prose(40),   # a benchmark passage
        103: "12 34 !! 56 --",                           # no letter
        104: prose(60) + " Write to anna.b@mail.example.org today. " + prose(20),
        105: None,
    }
    docs = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in {**clean, **planted}.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialize(stage(spark, rows, str(tmp_path)), name)
        seen[name] = {r.doc_id: r.text for r in rows.collect()}
    every = set(clean) | set(planted)
    assert set(seen["language_id"]) == every - {103, 105}
    assert set(seen["near_dedup"]) == every - {103, 105, 100, 101}
    assert set(seen["decontamination"]) == set(clean) | {104}
    assert set(seen["pii"]) == set(clean) | {104}
    assert "[EMAIL]" in seen["pii"][104] and "anna.b@" not in seen["pii"][104]
    assert all(seen["pii"][i] == t for i, t in clean.items())
    assert set(seen["mixing"]) <= set(seen["pii"]) and all(seen["pii"][i] == t for i, t in seen["mixing"].items())
