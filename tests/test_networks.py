"""Fits of networks against Spark's own, and the replay of batches against single steps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tripwire.operators import networks
from tripwire.operators.learners import SEAPool, make_learner
from tripwire.plans.cascade import _BatchTable


def _rows(n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return np.c_[x, (x[:, 0] * x[:, 1] + 0.2 * x[:, 2] > 0)].astype(float)


def test_a_fit_is_that_of_sparks_classifier(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    rows = _rows(512)                    # blocks of 128 rows: its loss is the mean over blocks
    df = spark.createDataFrame([(Vectors.dense(r[:-1]), float(r[-1])) for r in rows], ["x", "y"]).coalesce(1).cache()

    def theirs(iterations, tol, start=None):
        c = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[3, 7, 2], seed=11, maxIter=iterations, tol=tol)
        c = c if start is None else c.setInitialWeights(Vectors.dense(start))
        return c.fit(df)

    start = networks.start_weights(spark, 3, 7, 11)
    assert np.array_equal(start, theirs(0, 1e-4).weights.toArray())
    for iterations, tol in ((1, 1e-4), (2, 1e-4), (8, 1e-4), (25, 1e-4), (60, 1e-3)):
        model = theirs(iterations, tol)
        got = networks.fitted(start, rows, iterations, tol)
        assert np.allclose(got, model.weights.toArray(), rtol=1e-4, atol=1e-4), iterations
        said = [r.prediction for r in model.transform(df).select("prediction").collect()]
        assert np.array_equal(networks.predictions(got, rows), said)
    again = theirs(2, 0.0, got).weights.toArray()
    assert np.allclose(networks.fitted(got, rows, 2, 0.0), again, rtol=1e-4, atol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    rows, rng = _rows(700), np.random.default_rng(1)
    w = rng.normal(size=3 * 9 + 9 + 2 * 9 + 2)
    loss, grad = networks.loss_sums(w, rows)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert abs((networks.loss_sums(w + e, rows)[0] - networks.loss_sums(w - e, rows)[0]) / 2e-6 - grad[i]) < 1e-4
    assert loss > 0 and networks.predictions(w, rows[:0]).shape == (0,)


def _batches(spark, per=60, n=9):
    """Batches of which one has a single class, one no flagged row, and the last is short."""
    rows = [(*map(float, r[:3]), 0 if i // per == 4 else int(r[3]), int(i // per != 7 and i % 5 > 0), i // per, i // per // 3)
            for i, r in enumerate(_rows(per * n - 13))]
    df = spark.createDataFrame(rows, "a double, b double, c double, ANOMALY int, s1_flag int, batch_id int, segment int")
    return _BatchTable(df.repartition(5).cache(), 3), n


@pytest.mark.parametrize("kind", ["mlp", "ensemble"])
def test_replay_is_step_after_step(spark, kind):
    """Same counts and weights as single steps, in a few jobs for a segment of batches."""
    batches, n = _batches(spark)
    one, many = (make_learner(kind, ["a", "b", "c"], seed=5) for _ in range(2))
    if kind == "mlp":                     # the other one starts with an empty pool
        train = spark.createDataFrame([(*map(float, r[:3]), int(r[3])) for r in _rows(400, 8)], "a double, b double, c double, ANOMALY int")
        assert one.warmup(train) == many.warmup(train) == 400
    steps = [one.step(batches.batch(b)) for b in range(n)]
    tracker, group = spark.sparkContext.statusTracker(), f"replay-{kind}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        replayed = list(many.replay(batches, n))
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert replayed == steps and sum(r.n for r in steps) == 60 * n - 13 and steps[7].n_flagged == 0
    assert many.updates == one.updates
    for a, b in zip(many.state().get("members") or [many.params], one.state().get("members") or [one.params], strict=True):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-6)
    assert jobs <= 8 * 3 + 2              # three segments; a step has dozens of jobs


def test_batches_wider_than_a_task_are_stepped_over_all_tasks(spark):
    batches, n = _batches(spark, n=2)
    wide = _BatchTable(batches.df, 3, tasks=2)
    for kind in ("mlp", "ensemble"):
        one, many = make_learner(kind, ["a", "b", "c"]), make_learner(kind, ["a", "b", "c"])
        assert list(many.replay(wide, n)) == list(one.replay(batches, n))


def test_replay_wants_whole_rows(spark):
    batches, n = _batches(spark, n=3)
    gaps = _BatchTable(batches.df.withColumn("a", F.when(F.col("a") < 1, F.col("a"))), 3)
    for kind in ("mlp", "ensemble"):
        with pytest.raises(ValueError):
            list(make_learner(kind, ["a", "b", "c"]).replay(gaps, n))
        # a gap or an infinite value in the training rows only
        train = gaps.df.withColumn("row_key", F.monotonically_increasing_id())
        for rows in (train, train.fillna(float("inf"), ["a"])):
            with pytest.raises((ValueError, PySparkException)):
                make_learner(kind, ["a", "b", "c"]).warmup(rows)


def test_a_failed_fit_keeps_its_seed(spark):
    """L4: a fit without finite weights is a no-op; the next member starts from that seed."""
    pool, asked = SEAPool(features=["a"], seed=40), []

    def fit(starts):
        asked.append(sorted(starts))
        return {k: w * np.nan if k == 3 else w for k, w in starts.items()}

    got = pool._fitted(spark, fit, [1, 3, 4, 9])
    assert asked == [[1, 3, 4, 9], [4, 9]] and {k: m.seed for k, m in got.items()} == {1: 40, 4: 41, 9: 42}
    assert np.array_equal(got[4].weights, networks.start_weights(spark, 1, 50, 41))
