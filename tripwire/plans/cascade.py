"""Two-stage cascade: forest screen → online learner, evaluated prequentially.

Flow (Z1-Z5, T1-T6, L7):

1. ``prepare`` the flow table (split, arrival order, encode, scale);
2. fit the forest on benign train rows; score every row once and keep the
   scored table in the shared checkpoint folder;
3. thresholds for all contaminations from one exact-percentile job;
4. warm-up: the learner's first pass over the *flagged* rows of the full
   training split;
5. the test split, cut into arrival-order batches of ``batch_size`` rows, is
   written partitioned by ``batch_id``; each batch in order predicts its
   flagged rows with the pre-batch parameters (others get 0) and updates
   the learner on those same flagged rows (``Learner.replay``);
6. per-batch confusion rows are summed into the evaluation record.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRIC_SQL, with_metrics
from ..operators.iforest import Forest, fit_forest, load_forest, save_forest, thresholds, with_scores
from ..operators.learners import Learner, StepResult, make_learner
from ..session import materialize, scratch_path
from ..sources.catalog import CONTAMINATION_VALUES, DEFAULT_CONTAMINATION, LABEL, RANDOM_STATE
from ..sources.store import Store
from .pipeline import Prepared

N_TREES = 100
MAX_SAMPLES = 256


@dataclass
class StageOne:
    forest: Forest
    scored: DataFrame             # prepared table + score, checkpointed
    cutoffs: dict                 # contamination -> threshold
    seconds: float                # fit, scoring of every row, thresholds
    reused: bool = False          # the forest came from the store


def run_stage1(prep: Prepared, contaminations=CONTAMINATION_VALUES, n_trees: int = N_TREES,
               seed: int = RANDOM_STATE, store: Store | None = None) -> StageOne:
    """T1-T3.  With a ``store`` a forest fitted before on the same processed table with the
    same parameters is taken (T7), and a new one is kept (S12)."""
    t0 = time.time()
    spark = prep.table.sparkSession
    folder = held = None
    if store is not None and prep.folder:
        folder = store.folder("forest", prep.spec.name, {"table": prep.folder, "trees": n_trees, "sample": MAX_SAMPLES,
                                                         "seed": seed, "contaminations": sorted(contaminations)})
        held = store.manifest(folder)
    if held:
        forest, cut = load_forest(spark, folder)
        scored = materialize(with_scores(prep.table, forest), "scored")
        return StageOne(forest, scored, cut, time.time() - t0, True)
    forest = fit_forest(prep.benign_train(), prep.features, n_trees, MAX_SAMPLES, seed,
                        n=prep.n_benign_train)
    scored = materialize(with_scores(prep.table, forest), "scored")
    benign = scored.filter((F.col("split") == "train") & (F.col(LABEL) == 0))
    cut = thresholds(benign, list(contaminations))
    if folder:
        save_forest(forest, spark, folder, cut)
        store.finish(folder, {"seconds": round(time.time() - t0, 2)})
    return StageOne(forest, scored, cut, time.time() - t0)


def sweep(df: DataFrame, score: str, cutoffs: dict[float, float]) -> DataFrame:
    """T4: confusion counts per contamination from one scan (conditional sums, no cross join)."""
    y, s = F.col(LABEL), lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = []
    for i, cut in enumerate(cutoffs.values()):
        p = F.col(score) > F.lit(cut)
        aggs += [s((y == 0) & ~p).alias(f"tn_{i}"), s((y == 0) & p).alias(f"fp_{i}"),
                 s((y == 1) & ~p).alias(f"fn_{i}"), s((y == 1) & p).alias(f"tp_{i}")]
    args = ", ".join(f"CAST({c!r} AS DOUBLE), CAST({cut!r} AS DOUBLE), tn_{i}, fp_{i}, fn_{i}, tp_{i}"
                     for i, (c, cut) in enumerate(cutoffs.items()))
    return df.agg(*aggs).selectExpr(f"stack({len(cutoffs)}, {args}) AS (contamination, threshold, tn, fp, fn, tp)")


def best_record(records: DataFrame) -> DataFrame:
    """T5: the contamination with the highest macro F1 (smallest on ties)."""
    return records.orderBy(F.col("f1_macro").desc(), F.col("contamination").asc()).limit(1)


def forest_records(stage1: StageOne, contaminations=CONTAMINATION_VALUES,
                   seed: int = RANDOM_STATE) -> DataFrame:
    """T4: one evaluation record per contamination, from a single test scan."""
    long = sweep(stage1.scored.filter(F.col("split") == "test"), "score", {c: stage1.cutoffs[c] for c in contaminations})
    # stage-1 records carry no balanced accuracy (as the reference's)
    names = [m for m in METRIC_SQL if m not in ("balanced_accuracy", "specificity")]
    rec = with_metrics(long, 4, names).withColumns({
        "n_estimators": F.lit(stage1.forest.n_trees), "random_state": F.lit(seed),
        "elapsed_sec": F.lit(round(stage1.seconds, 2))})
    return rec.withColumnsRenamed({"tn": "confusion_tn", "fp": "confusion_fp",
                                   "fn": "confusion_fn", "tp": "confusion_tp"})


SEGMENT_ROWS = 2_000_000      # rows per directory of the batch table
TASK_ROWS = 50_000            # rows of a batch per task


def batch_table(spark: SparkSession, stage1: StageOne, contamination: float, batch_size: int,
                run_id: str) -> tuple[DataFrame, int, str]:
    """Test rows with ``flag`` and ``batch_id``, written once.

    Directories hold a segment of consecutive batches (~2M rows each, so the
    directory count stays small at any scale) and files inside are sorted by
    ``batch_id``: reading one batch prunes to one directory, and parquet
    row-group statistics skip the other batches in it."""
    cut = stage1.cutoffs[contamination]
    seg = max(1, SEGMENT_ROWS // batch_size)
    test = (stage1.scored.filter(F.col("split") == "test")
            .withColumn("s1_flag", (F.col("score") > F.lit(cut)).cast("int"))
            .withColumn("batch_id", F.floor(F.col("ord") / F.lit(batch_size)).cast("int"))
            .withColumn("segment", F.floor(F.col("batch_id") / F.lit(seg)).cast("int")))
    path = scratch_path(spark, f"batches-{run_id}")
    n = test.count()
    n_parts = max(1, -(-n // (SEGMENT_ROWS // 4)))
    (test.repartitionByRange(n_parts, "ord").sortWithinPartitions("ord")
     .write.mode("overwrite").option("parquet.block.size", 8 * 1024 * 1024)
     .partitionBy("segment").parquet(path))
    n_batches = -(-n // batch_size)
    return _BatchTable(spark.read.parquet(path), seg, max(1, -(-batch_size // TASK_ROWS))), n_batches, path


class _BatchTable:
    """The written batch table; ``batch(b)`` prunes to b's segment.

    A segment is scanned by as many tasks as its size asks for, of which nearly all find
    no row of the batch, and a learner runs its rows dozens of times: they are brought
    into ``tasks`` partitions first (one, at the registered batch sizes)."""

    def __init__(self, df: DataFrame, seg: int, tasks: int = 1):
        self.df, self.seg, self.tasks = df, seg, tasks
        self.schema = df.schema

    def batch(self, b: int) -> DataFrame:
        rows = self.df.filter((F.col("segment") == b // self.seg) & (F.col("batch_id") == b))
        return rows.coalesce(self.tasks)

    def segment(self, b: int) -> DataFrame:
        """The rows of the segment that batch ``b`` lies in."""
        return self.df.filter(F.col("segment") == b // self.seg)

    def filter(self, cond):          # DataFrame-like access used by callers
        return self.df.filter(cond)


def record(learner: Learner, batch_size: int, total: StepResult, warm_s: float,
           test_s: float, digits: int = 4) -> dict:
    """One flat evaluation row (counts were summed over batches)."""
    rec = {"model_name": learner.name, **learner.hyperparams(), "batch_size": batch_size,
           "warmup_time_sec": round(warm_s, 2), "test_time_sec": round(test_s, 2),
           "total_time_sec": round(warm_s + test_s, 2), "total_processed": total.n,
           "stage2_calls": total.n_flagged,
           "stage2_call_rate": round(total.n_flagged / total.n, digits) if total.n else 0.0}
    rec.update({k: round(v, digits) for k, v in metric_values(total).items()})
    rec.update({"support_normal": total.tn + total.fp, "support_anomaly": total.fn + total.tp,
                "confusion_tn": total.tn, "confusion_fp": total.fp,
                "confusion_fn": total.fn, "confusion_tp": total.tp})
    return rec


def metric_values(total: StepResult) -> dict[str, float]:
    """The metrics of summed counts, by the expressions of ``functions/metrics``."""
    spark = SparkSession.getActiveSession()
    counts = spark.createDataFrame([(total.tn, total.fp, total.fn, total.tp)], "tn long, fp long, fn long, tp long")
    row = counts.select(*[F.expr(e).cast("double").alias(n) for n, e in METRIC_SQL.items()]).first()
    return row.asDict()


def run_cascade(spark: SparkSession, prep: Prepared, stage1: StageOne, kind: str,
                batch_size: int, contamination: float = DEFAULT_CONTAMINATION,
                seed: int = RANDOM_STATE, store: Store | None = None):
    """Z2 replay: warm-up, then one prequential job per batch in order.  The test time
    includes writing the batch table.  With a ``store`` the learner's final state is
    kept (S12)."""
    learner = make_learner(kind, prep.features, seed)
    run_id = uuid.uuid4().hex[:12]
    cut = stage1.cutoffs[contamination]
    t0 = time.time()
    warm = stage1.scored.filter((F.col("split") == "train") & (F.col("score") > F.lit(cut)))
    learner.warmup(warm)
    warm_s = time.time() - t0
    t1 = time.time()
    batches, n_batches, _path = batch_table(spark, stage1, contamination, batch_size, run_id)
    total, per_batch = StepResult(), []
    for b, res in enumerate(learner.replay(batches, n_batches)):
        total.add(res)
        per_batch.append((b, res.n, res.n_flagged, res.tn, res.fp, res.fn, res.tp))
    test_s = time.time() - t1
    if store is not None:
        save_learner(store, prep, kind, learner, {"batch_size": batch_size, "contamination": contamination, "seed": seed})
    return learner, record(learner, batch_size, total, warm_s, test_s), per_batch


def _learner_folder(store: Store, prep: Prepared, kind: str, params: dict) -> str:
    """Where a trained learner lies."""
    return store.folder(f"learner-{kind}", prep.spec.name, {"table": prep.folder, "features": prep.features, **params})


def save_learner(store: Store, prep: Prepared, kind: str, learner: Learner, params: dict) -> str:
    """A learner's state by data set and parameters."""
    folder = _learner_folder(store, prep, kind, params)
    store.finish(folder, {"kind": kind, "features": prep.features, "state": learner.state(), "params": params})
    return folder


def load_learner(store: Store, prep: Prepared, kind: str, params: dict) -> Learner:
    """A trained learner; FileNotFoundError if there is none."""
    folder = _learner_folder(store, prep, kind, params)
    held = store.manifest(folder)
    if held is None:
        raise FileNotFoundError(f"no {kind} learner at {folder}")
    learner = make_learner(kind, held["features"], params.get("seed", RANDOM_STATE))
    learner.load(held["state"])
    return learner


def record_frame(spark: SparkSession, rec: dict) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame([rec]))


__all__ = ["StageOne", "run_stage1", "forest_records", "run_cascade", "record_frame",
           "with_metrics", "fit_forest", "with_scores"]
