"""Experiment runner (entry A) and comparison phase (entry C).

``run_prepared`` fits the stage-1 forest of one processed table once (or takes it
from the store), records the whole contamination sweep, runs every stage-2 learner
over each batch size of its sweep (a failing size is skipped) and writes the
evaluation records under ``<out>/<model>/<dataset>/`` (S5, S9).  ``run_experiment``
does so for a driver table, ``run_all`` for any list of driver tables and raw files,
where a data set that fails does not stop the others.
``compare_phase`` discovers those records (S6), loads them tolerantly (S7),
unions them (R1), picks the best run per (model, dataset) (R2) and writes
the summary, the best-per-pair table and a Markdown report (S10, S11).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..operators.compare import KEY_METRICS
from ..sources.catalog import BATCH_SWEEP, CONTAMINATION_VALUES, DEFAULT_CONTAMINATION, LINEITEM, FlowSpec, evaluation_path, get_spec, raw_paths
from ..sources.readers import find_result_files, load_result_files
from ..sources.store import Store
from .cascade import best_record, forest_records, run_cascade, run_stage1
from .pipeline import Prepared, prepare
from .raw_pipeline import prepare_raw

log = logging.getLogger(__name__)

REPORT_METRICS = KEY_METRICS
#: what a run may fail with on its data or parameters; anything else ends the experiment
RUN_ERRORS = (ValueError, ArithmeticError, FileNotFoundError, PySparkException)


@dataclass(frozen=True)
class Dataset:
    """A data set of an experiment: a driver table by name, or raw files by format (given,
    or found under a project folder)."""

    name: str
    sf_dir: str | None = None
    train: str | None = None
    test: str | None = None
    root: str | None = None

    def prepare(self, spark: SparkSession, store: Store) -> Prepared:
        if self.sf_dir is not None:
            return prepare(spark, self.sf_dir, get_spec(self.name), store=store)
        train, test = self.train, self.test
        if train is None and self.root is not None:
            paths = raw_paths(self.name, self.root)
            train, test = paths.get("train", paths.get("file")), paths.get("test")
        return prepare_raw(spark, self.name, train, test, store=store)


def write_record(df: DataFrame, out_dir: str, model: str, dataset: str) -> str:
    """The run's records as one headered CSV, replaced on rerun."""
    path = evaluation_path(out_dir, model, dataset)
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return path


def _alive(spark: SparkSession) -> bool:
    return not spark.sparkContext._jsc.sc().isStopped()  # noqa: SLF001


def run_prepared(spark: SparkSession, prep: Prepared, out_dir: str, models=("sgd", "mlp", "ensemble"),
                 batch_sweep: dict | None = None, contamination: float = DEFAULT_CONTAMINATION,
                 store: Store | None = None, n_trees: int = 100) -> dict:
    sweep = batch_sweep or BATCH_SWEEP
    name = prep.spec.name
    values = sorted({*CONTAMINATION_VALUES, contamination})
    s1 = run_stage1(prep, values, n_trees, store=store)
    forest = forest_records(s1, values)
    write_record(forest, out_dir, "isolation_forest", name)
    best = best_record(forest).first()                                          # T5
    summary = {"best_contamination": best.contamination, "records": {}, "reused": s1.reused}
    for kind in models:
        recs = []
        for b in sweep.get(kind, [25_000]):                                     # L9
            try:
                _l, rec, _pb = run_cascade(spark, prep, s1, kind, b, contamination, store=store)
            except RUN_ERRORS as exc:        # a failing size is skipped
                if not _alive(spark):
                    raise
                log.warning("%s batch size %s failed: %s", kind, b, exc)
                continue
            recs.append(rec)
        total = round(sum(r["total_time_sec"] for r in recs), 2)
        for r in recs:
            r["total_training_time_sec"] = total
        if recs:
            write_record(spark.createDataFrame(pd.DataFrame(recs)), out_dir, kind, name)
        summary["records"][kind] = recs
    return summary


def run_experiment(spark: SparkSession, sf_dir: str, out_dir: str, spec: FlowSpec = LINEITEM, store: Store | None = None,
                   **options) -> dict:
    """``run_prepared`` on a driver table."""
    return run_prepared(spark, prepare(spark, sf_dir, spec, store=store), out_dir, store=store, **options)


def run_all(spark: SparkSession, datasets: list[Dataset], out_dir: str, store: Store | None = None, **options) -> dict:
    """Every data set in turn: name -> its summary, or ``{"error": ...}`` for one that failed."""
    store, out = store or Store(spark), {}
    for d in datasets:
        try:
            out[d.name] = run_prepared(spark, d.prepare(spark, store), out_dir, store=store, **options)
        except RUN_ERRORS as exc:
            if not _alive(spark):
                raise
            log.warning("data set %s failed: %s", d.name, exc)
            out[d.name] = {"error": f"{type(exc).__name__}: {exc}"}
    return out


def load_corpus(spark: SparkSession, root: str) -> DataFrame | None:
    """S6 + S7 + R1: every readable record under ``root``, tagged."""
    frames = load_result_files(spark, find_result_files(spark, root))
    return compare.union_records(frames) if frames else None


def _table(df: DataFrame) -> str:
    """A small table as Markdown."""
    lines = [df.columns, ["---"] * len(df.columns)]
    lines += [["N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.orderBy(df.columns[0]).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def compare_phase(spark: SparkSession, root: str, report_dir: str) -> DataFrame | None:
    """Entry C; ``None`` when no record exists (the caller fails the run)."""
    corpus = load_corpus(spark, root)
    if corpus is None:
        return None
    best = compare.best_per_group(corpus, "both", "f1_macro").orderBy(
        F.col("f1_macro").desc_nulls_last(), "model", "dataset")
    corpus.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{report_dir}/summary")
    best.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{report_dir}/summary_best")
    metrics = [m for m in REPORT_METRICS if m in best.columns]
    for param in ("contamination", "batch_size"):                      # R11-R13
        if param in corpus.columns:
            compare.by_parameter(corpus, param, [*metrics, "total_time_sec"]).coalesce(1) \
                .write.mode("overwrite").option("header", "true").csv(f"{report_dir}/by_{param}")
    stamp = spark.range(1).select(F.current_timestamp()).first()[0]
    md = ["# Cross-dataset evaluation summary", "", f"Generated: {stamp:%Y-%m-%d %H:%M:%S}", "",
          "## Best results per dataset and model", "", compare.to_markdown(best, metrics), "",
          "## Best model per dataset", ""]
    winners = compare.best_per_group(best, "dataset", "f1_macro").orderBy("dataset")
    md.append(compare.to_markdown(winners, metrics))
    if "f1_macro" in best.columns:
        stage2 = compare.exclude_stage1(best)
        models = sorted(r.model for r in stage2.select("model").distinct().collect())
        md += ["", "## Macro F1 of the stage-2 models", "", _table(compare.pivot_metric(stage2, "f1_macro", models))]
    path = f"{report_dir}/summary.md"
    spark.createDataFrame([("\n".join(md),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)
    return best
