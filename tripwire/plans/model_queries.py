"""Registered model plans: forest scores and sweep, the three cascades (replay)
and the streaming cascade.  The online logistic learner is checked step by step
against unrolled SQL (``sgd_prequential``); the other models are rows-only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..operators.learners import SGDLogistic, StepResult, make_learner
from ..sources.catalog import DEFAULT_CONTAMINATION, LABEL, LINEITEM
from ..sources.store import Store
from ..streaming.prequential import run_stream
from .cascade import batch_table, record, record_frame, run_cascade, run_stage1, forest_records
from .common import stable_round, stable_round_sql
from .pipeline import prepare
from .prep_queries import prepared_ctes

# batch sizes of the reference's stored runs
BATCH = {"sgd": 25_000, "mlp": 20_000, "ensemble": 25_000}


def _stage1(spark: SparkSession, sf_dir: str):
    """The processed table and its forest; both are kept in the session's store."""
    store = Store(spark)
    p = prepare(spark, sf_dir, LINEITEM, store=store)
    return p, run_stage1(p, store=store)


def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with score and flag at contamination 0.45."""
    _p, s1 = _stage1(spark, sf_dir)
    cut = s1.cutoffs[DEFAULT_CONTAMINATION]
    return s1.scored.filter(F.col("split") == "test").select(
        "row_key", LABEL, F.round("score", 6).alias("score"),
        (F.col("score") > F.lit(cut)).cast("int").alias("flagged"))


def iforest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: twelve records from one forest (only the cut-off differs)."""
    _p, s1 = _stage1(spark, sf_dir)
    return forest_records(s1)


def _cascade(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, s1 = _stage1(spark, sf_dir)
        _l, rec, _pb = run_cascade(spark, p, s1, kind, BATCH[kind])
        return record_frame(spark, rec)
    run.__name__ = f"{kind}_cascade"
    return run


def streaming_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SGD cascade driven by Structured Streaming."""
    p, s1 = _stage1(spark, sf_dir)
    run_id = uuid.uuid4().hex[:12]
    batches, n_batches, _ = batch_table(spark, s1, DEFAULT_CONTAMINATION, BATCH["sgd"], run_id)
    learner = make_learner("sgd", p.features)
    cut = s1.cutoffs[DEFAULT_CONTAMINATION]
    import time
    t0 = time.time()
    learner.warmup(s1.scored.filter((F.col("split") == "train") & (F.col("score") > F.lit(cut))))
    warm_s = time.time() - t0
    total, test_s, _rows = run_stream(spark, batches, n_batches, learner, run_id)
    return record_frame(spark, record(learner, BATCH["sgd"], total, warm_s, test_s))


def embedding_forest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4 on 64 embedding dimensions (label 0 as the anomaly class)."""
    from ..sources.catalog import EMBEDDINGS

    p = prepare(spark, sf_dir, EMBEDDINGS)
    return forest_records(run_stage1(p))


# ---------------------------------------------------------------- L2, L7, Z2 step by step
STEPS = 5                # stream batches of the unrolled run
UNROLLED_WARMUP = 3
SCORE_SHARE = 1 - DEFAULT_CONTAMINATION


def sgd_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online logistic learner behind a rule detector: warm-up on flagged training
    rows, then every batch is predicted and learned; one row per batch (-1: warm-up)
    with its confusion counts and the parameters after it."""
    p = prepare(spark, sf_dir, LINEITEM)
    table = p.table                       # lies in the store, so that a pass is a plain scan
    score = LINEITEM.score_col
    benign = table.filter((F.col("split") == "train") & (F.col(LABEL) == 0))
    cut = exact_percentiles(benign, [score], [SCORE_SHARE])[("", score, SCORE_SHARE)]
    table = table.withColumn("s1_flag", (F.col(score) > F.lit(cut)).cast("int"))
    test = table.filter(F.col("split") == "test")
    n = test.count()
    test = test.withColumn("batch_id", F.floor(F.col("ord") * STEPS / F.lit(n)).cast("int"))
    learner = SGDLogistic(p.features, warm_steps=UNROLLED_WARMUP)
    warm = learner.warmup(table.filter("split = 'train' and s1_flag = 1"))

    def row(b, r):
        return (b, r.n, r.n_flagged, r.tn, r.fp, r.fn, r.tp, *(float(v) for v in learner.params))

    rows = [row(-1, StepResult(n=warm, n_flagged=warm))]
    rows += [row(b, learner.step(test.filter(F.col("batch_id") == b))) for b in range(STEPS)]
    names = [f"w_{c}" for c in p.features] + ["w_intercept"]
    out = spark.createDataFrame(rows, "batch_id int, n long, n_flagged long, tn long, fp long, fn long, tp long, "
                                + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: stable_round(c) for c in names})


def _prequential_sql() -> str:
    feats = [*LINEITEM.features, "1.0"]
    names = [f"w_{c}" for c in LINEITEM.features] + ["w_intercept"]
    score, d1 = LINEITEM.score_col, len(feats)
    z = " + ".join(f"{w} * {x}" for w, x in zip(names, feats))
    grads = ", ".join(f"sum((1.0 / (1.0 + exp(-z)) - {LABEL}) * {x}) AS g{i}, sum({x} * CAST({x} AS DOUBLE)) AS s{i}"
                      for i, x in enumerate(feats))
    moved = ", ".join(
        f"{w} - (g{i} / k + {ridge} * {w}) / ({d1} / 4.0 * s{i} / k + {ridge}) AS {w}"
        for i, w in enumerate(names) for ridge in ["0.0" if w == "w_intercept" else repr(SGDLogistic.alpha)])
    any_w = ", ".join(f"any_value({w}) AS {w}" for w in names)
    steps = [f"w0 AS (SELECT {', '.join(f'CAST(0.0 AS DOUBLE) AS {w}' for w in names)})"]

    def step(i: int, where: str) -> str:
        inner = f"SELECT c.*, w{i}.*, {z} AS z FROM c, w{i} WHERE {where} AND flagged = 1"
        return (f"w{i + 1} AS MATERIALIZED (SELECT {moved} FROM (SELECT count(*) AS k, {grads}, {any_w} FROM ({inner}) a) b)")

    steps += [step(i, "split = 'train'") for i in range(UNROLLED_WARMUP)]
    steps += [step(UNROLLED_WARMUP + b, f"batch_id = {b}") for b in range(STEPS)]
    shown = ", ".join(f"{stable_round_sql(w)} AS {w}" for w in names)
    counts = []
    for b in range(STEPS):
        counted = ", ".join(f"CAST(sum(CASE WHEN {LABEL} = {y} AND pred = {p} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
                            for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
        inner = (f"SELECT c.*, CASE WHEN flagged = 1 AND {z} > 0 THEN 1 ELSE 0 END AS pred "
                 f"FROM c, w{UNROLLED_WARMUP + b} WHERE batch_id = {b}")
        counts.append(f"SELECT CAST({b} AS INTEGER) AS batch_id, m.*, {shown} FROM (SELECT count(*) AS n, "
                      f"CAST(sum(flagged) AS BIGINT) AS n_flagged, {counted} FROM ({inner}) r) m, w{UNROLLED_WARMUP + b + 1}")
    warm = (f"SELECT CAST(-1 AS INTEGER) AS batch_id, m.*, {shown} FROM (SELECT count(*) AS n, count(*) AS n_flagged, "
            "CAST(0 AS BIGINT) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS tp "
            f"FROM c WHERE split = 'train' AND flagged = 1) m, w{UNROLLED_WARMUP}")
    return (f"WITH {prepared_ctes(LINEITEM, None)},\n"
            f"cut AS (SELECT quantile_cont({score}, {SCORE_SHARE!r}) AS v FROM x WHERE split = 'train' AND {LABEL} = 0),\n"
            f"size AS (SELECT count(*) AS n FROM x WHERE split = 'test'),\n"
            f"c AS MATERIALIZED (SELECT x.*, CASE WHEN {score} > cut.v THEN 1 ELSE 0 END AS flagged, "
            f"CASE WHEN split = 'test' THEN CAST(floor(ord * {STEPS} / size.n) AS INTEGER) END AS batch_id FROM x, cut, size),\n"
            + ",\n".join(steps) + "\n" + " UNION ALL ".join([warm, *counts]))


QUERIES = {
    "sgd_prequential": sgd_prequential,
    "embedding_forest_sweep": embedding_forest_sweep,
    "iforest_scores": iforest_scores,
    "iforest_sweep": iforest_sweep,
    "sgd_cascade": _cascade("sgd"),
    "mlp_cascade": _cascade("mlp"),
    "ensemble_cascade": _cascade("ensemble"),
    "streaming_cascade": streaming_cascade,
}
SQL = {"sgd_prequential": _prequential_sql()}
