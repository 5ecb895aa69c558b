"""What a plan writes, keeps and schedules as its table grows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def flows_dir(spark, tmp_path_factory):
    """A small lineitem of its own."""
    d = tmp_path_factory.mktemp("flows")
    rng = np.random.default_rng(5)
    rows = [(i // 4, int(rng.integers(50)), int(rng.integers(9)), i % 4 + 1, float(rng.integers(1, 51)),
             float(rng.integers(100, 99_999)) / 100, float(rng.integers(11)) / 100, float(rng.integers(9)) / 100,
             str(rng.choice(list("RAN"))), str(rng.choice(list("OF")))) for i in range(1200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string") \
        .write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def test_a_batch_is_one_partition(spark, flows_dir, monkeypatch):
    """A learner runs a batch's rows dozens of times: not one task per split of the segment."""
    from tripwire.plans import cascade

    rows = spark.range(0, 900, numPartitions=6).select(
        F.col("id").alias("ord"), F.lit("test").alias("split"), F.col("id").cast("double").alias("score"), F.lit(1).alias("ANOMALY"))
    monkeypatch.setattr(cascade, "SEGMENT_ROWS", 400)
    s1 = cascade.StageOne(None, rows, {0.45: 450.0}, 0.0)
    batches, n, _ = cascade.batch_table(spark, s1, 0.45, 100, "one-partition")
    assert n == 9 and batches.df.rdd.getNumPartitions() > 1
    for b in range(n):
        got = batches.batch(b)
        assert got.rdd.getNumPartitions() == 1
        assert sorted(r.ord for r in got.collect()) == list(range(100 * b, 100 * b + 100))


def test_a_large_forest_is_fitted_some_trees_at_a_time(spark, monkeypatch):
    """A fit keeps a count per row and tree: over many rows a fit has few trees, and all trees are fitted."""
    from pyspark.ml.classification import RandomForestClassifier

    from tripwire.operators import profile

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[1] > 0)) for r in x], "a double, b double, c double, ANOMALY int")
    fits: list = []
    real = RandomForestClassifier.fit

    def fit(self, data):
        model = real(self, data)
        fits.append((model.getNumTrees, self.getSeed(), self.getCacheNodeIds(), model))
        return model

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    monkeypatch.setattr(profile, "FOREST_DRAWS", 1000, raising=False)
    got = {r.feature: r.importance for r in profile.feature_importance(df, ["a", "b", "c"], trees=25, depth=3).collect()}
    assert [f[0] for f in fits] == [10, 10, 5] and len({f[1] for f in fits}) == 3 and not any(f[2] for f in fits)
    every = sum(t.featureImportances.toArray() for f in fits for t in f[3].trees)
    assert np.allclose([got[c] for c in "abc"], every / every.sum()) and got["b"] > 0.8
    # few rows: one fit
    fits.clear()
    monkeypatch.setattr(profile, "FOREST_DRAWS", 10_000)
    profile.feature_importance(df, ["a", "b", "c"], trees=25, depth=3).collect()
    assert [f[0] for f in fits] == [25]


def test_trees_of_many_alike_rows_are_fitted_on_groups(spark, monkeypatch):
    """Rows of the same bins and label are one weighted row of a fit; all rows count, and the
    importances are those of the forest over rows."""
    from pyspark.ml.classification import RandomForestClassifier

    from tripwire.operators import profile

    df = spark.range(6000).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.xxhash64("id") % 5).cast("double").alias("b"), F.lit(4.0).alias("k"),
        F.element_at(F.array(*map(F.lit, "uvw")), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) + 1).cast("int")).alias("c"), "id")
    rule = ((F.col("a") > 3) & (F.pmod("id", F.lit(10)) > 0)) | ((F.col("b") > 2) & (F.col("c") == "w"))
    df = df.withColumn("ANOMALY", rule.cast("int")).drop("id").cache()
    over_rows = {r.feature: r.importance for r in profile.feature_importance(df, ["a", "b", "k"], trees=40, depth=4, categorical=["c"]).collect()}
    fits: list = []
    real = RandomForestClassifier.fit

    def fit(self, data):
        fits.append((self.getNumTrees(), self.getBootstrap(), data.count(), data.agg(F.sum(self.getWeightCol())).first()[0]))
        return real(self, data)

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    monkeypatch.setattr(profile, "FOREST_DRAWS", 1000)
    got = {r.feature: r.importance for r in profile.feature_importance(df, ["a", "b", "k"], trees=12, depth=4, categorical=["c"]).collect()}
    n_groups = df.groupBy("a", "b", "c", "ANOMALY").count().count()
    assert len(fits) == 12 and all(f[0] == 1 and not f[1] and f[2] <= n_groups for f in fits)
    drawn = [f[3] for f in fits]
    assert len(set(drawn)) > 1 and abs(np.mean(drawn) - 6000) < 5 * (6000 / 12) ** 0.5
    assert all(abs(got[c] - over_rows[c]) < 0.12 for c in got) and got["k"] == 0 and max(got, key=got.get) == "a"


def test_bins_of_a_forest(spark):
    """Each value of a column of few is a bin; a column of many has its quantiles; gaps are refused."""
    from tripwire.operators.profile import _bin_edges

    df = spark.range(5000).select(F.when(F.col("id") == 7, 9.0).otherwise((F.col("id") % 3).cast("double")).alias("few"),
                                  F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"))
    edges = _bin_edges(df, ["few", "many", "one"])
    assert edges["few"] == [0.5, 1.5, 5.5] and edges["one"] == []
    assert len(edges["many"]) == 31 and np.allclose(edges["many"], np.arange(1, 32) * 5000 / 32, atol=5)
    for gap in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            _bin_edges(df.withColumn("many", F.when(F.col("many") == 3, F.lit(gap)).otherwise(F.col("many"))), ["few", "many"])


def test_splits_are_written_without_a_sort_by_split(spark, flows_dir, tmp_path, monkeypatch):
    """A write by ``split`` sorts, and spills, all rows of a task; each split is written on its own."""
    from tripwire.plans.pipeline import prepare, split_flows
    from tripwire.sources.catalog import LINEITEM
    from tripwire.sources.store import Store

    by: list[str] = []
    real = DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: by.extend(map(str, c)) or real(self, *c))
    store = Store(spark, str(tmp_path / "store"))
    got = split_flows(spark, flows_dir, LINEITEM, store=store)
    table = prepare(spark, flows_dir, LINEITEM, store=store).table
    assert by == []
    for df in (got, table):
        n = {r.split: (r.n, r.ords) for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("ords")).collect()}
        assert n == {"train": (960, 0), "test": (240, 240)}
    # a split that is written again replaces that split only
    folder = str(tmp_path / "entry")
    store.write_split({"train": got.filter("split = 'train'"), "test": got.filter("split = 'test'")}, folder)
    store.write_split({"test": got.filter("split = 'test' and ord < 7")}, folder)
    again = store.read_split(folder, got.columns)
    assert again.columns == got.columns and dict(map(tuple, again.groupBy("split").count().collect())) == {"train": 960, "test": 7}


def test_prequential_reads_the_stored_table(spark, flows_dir, monkeypatch):
    """The processed table lies in the store; the plan writes no copy of it."""
    from tripwire import session
    from tripwire.plans.model_queries import sgd_prequential

    monkeypatch.setattr(session, "_WRITTEN", [])
    rows = sgd_prequential(spark, flows_dir).collect()
    assert sorted(r.batch_id for r in rows) == [-1, 0, 1, 2, 3, 4] and sum(r.n for r in rows if r.batch_id >= 0) == 240
    assert not [p for p in session._WRITTEN if "prequential" in p]
