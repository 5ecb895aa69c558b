"""What the joins of the mixture and of the near copies carry, and that the rows are the same."""

import duckdb
import numpy as np
import pytest

from tripwire.llm import minhash, mixing


@pytest.fixture(scope="module")
def uneven():
    rng = np.random.default_rng(3)
    docs = []
    for i in range(3000):
        source = [None, "a", "b", "c"][int(rng.choice(4, p=[0.02, 0.7, 0.2, 0.08]))]
        docs.append((i // 2 if i < 40 else i, source, None if i % 97 == 0 else "word " * int(rng.integers(0, 60))))
    return docs + [(9000, "no words", " ")]


def test_mixture_shuffles_no_text(spark, uneven, tmp_path):
    spark.createDataFrame(uneven, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "source", "n_tokens", "epoch", "mix_key"]
    got = mixing.mix(docs)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, got.select(names).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(mixing.SQL).fetchall(), key=repr)
    assert {x[1] for x in got} == {None, "a", "b", "c"} and len({x[3] for x in got}) > 1
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as with very many sources
    try:
        assert got == sorted(map(tuple, mixing.mix(docs).select(names).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_near_copies_carry_numbers(spark, monkeypatch):
    """After the nodes are numbered no table but theirs carries a name; repeated ids and rows,
    null ids and null texts keep their classes."""
    kept = {}

    def recorded(df, name, plain=minhash.materialize):
        kept[name] = dict(df.dtypes)
        return plain(df, name)

    monkeypatch.setattr(minhash, "materialize", recorded)
    base = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join([*base[:k], f"x{k}", *base[k + 1:]])      # noqa: E731
    other = " ".join(f"v{i}" for i in range(60))
    docs = [(5, near(3)), (5, near(90)), (5, other), (5, near(3)), (2, near(150).upper()), (None, near(40)),
            (None, "alone and short"), (7, other + " v60"), (8, None), (9, ""), (10, "never seen before at all here")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == sorted(
        [(5, 2, False)] * 3 + [(5, 5, True), (2, 2, True), (0, 2, False), (0, 0, True), (7, 5, False),
         (8, 8, True), (9, 8, False), (10, 10, True)])
    assert {k: t for k, t in kept["nodes"].items() if k in ("node", "name")} == {"node": "bigint", "name": "string"}
    later = [c for n, t in kept.items() if n not in ("sketched", "nodes") for c in t.items()]
    assert len(later) > 20 and "string" not in {kind for _, kind in later}
