"""Threshold detectors over a single score column, evaluated with M1-M5.

These are the SQL-checkable counterparts of the stage-1 contract: a score,
a cut-off taken from benign rows (``percentile(score, 1 - contamination)``),
flagged iff ``score > cut-off`` (strict), then the confusion metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..sources.catalog import CONTAMINATION_VALUES, EVENTS, LABEL, LINEITEM, FlowSpec
from .cascade import best_record, sweep
from .common import DIGITS, confusion_row, confusion_sql, flows


def benign_cutoffs(df: DataFrame, score: str, contaminations: list[float]) -> dict[float, float]:
    """T3 on a plain column: one exact-percentile job for all contaminations."""
    qs = {c: 1 - c for c in contaminations}
    got = exact_percentiles(df.filter(F.col(LABEL) == 0), [score], list(qs.values()))
    return {c: got[("", score, q)] for c, q in qs.items()}


def flag(score: str, cutoff: float):
    """F8: strictly beyond the cut-off → 1."""
    return (F.col(score) > F.lit(cutoff)).cast("int")


# ---------------------------------------------------------------- confusion_metrics
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§7.2 minimum slice: events, value above the 0.55 quantile of non-error
    rows is flagged; label is event_type = 'error'."""
    ev = flows(spark, sf_dir, EVENTS).select("value", LABEL)
    cut = exact_percentiles(ev.filter(F.col(LABEL) == 0), ["value"], [0.55])[("", "value", 0.55)]
    out = confusion_row(ev, flag("value", cut))
    return out.withColumn("threshold", F.round(F.lit(cut), DIGITS))


CONFUSION_METRICS_SQL = (
    "WITH t AS (SELECT quantile_cont(value, 0.55) AS thr FROM events WHERE event_type <> 'error')\n"
    + "SELECT c.*, round(t.thr, 6) AS threshold FROM (\n"
    + confusion_sql(
        "SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, "
        "CASE WHEN value > (SELECT thr FROM t) THEN 1 ELSE 0 END AS p FROM events", "y", "p")
    + ") c, t")


# ---------------------------------------------------------------- threshold_sweep
def _sweep(df: DataFrame, score: str, contaminations: list[float]) -> DataFrame:
    """T4 by the function that the forest's records come from."""
    long = sweep(df, score, benign_cutoffs(df, score, contaminations))
    long = long.withColumns({"total_processed": F.expr("tn + fp + fn + tp"),
                             "stage2_calls": F.expr("fp + tp")})
    from ..functions.metrics import with_metrics
    out = with_metrics(long, DIGITS)
    return out.withColumn("threshold", F.round("threshold", DIGITS)).withColumn(
        "stage2_call_rate", F.round(F.expr(
            "CASE WHEN total_processed = 0 THEN 0.0 ELSE "
            "CAST(stage2_calls AS DOUBLE) / total_processed END"), DIGITS))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 on lineitem's price: 12 contaminations from one pass."""
    df = flows(spark, sf_dir, LINEITEM).select(LINEITEM.score_col, LABEL)
    return _sweep(df, LINEITEM.score_col, CONTAMINATION_VALUES)


def _sweep_sql(spec: FlowSpec, contaminations: list[float]) -> str:
    score = spec.score_col
    cuts = " UNION ALL ".join(
        f"SELECT CAST({c!r} AS DOUBLE) AS contamination, (SELECT quantile_cont({score}, {1 - c!r}) "
        f"FROM {spec.table} WHERE ({spec.label_sql}) = 0) AS threshold"
        for c in contaminations)
    src = (f"SELECT b.contamination, b.threshold, ({spec.label_sql}) AS y, "
           f"CASE WHEN {score} > b.threshold THEN 1 ELSE 0 END AS p FROM {spec.table}, ({cuts}) b")
    inner = confusion_sql(src, "y", "p", keys=["contamination", "threshold"])
    return (f"SELECT * REPLACE (round(threshold, 6) AS threshold) FROM ({inner}) z")


THRESHOLD_SWEEP_SQL = _sweep_sql(LINEITEM, CONTAMINATION_VALUES)


# ---------------------------------------------------------------- best_contamination
def best_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the contamination with the highest macro F1 (smallest on ties)."""
    return best_record(threshold_sweep(spark, sf_dir)).select("contamination", "f1_macro")


BEST_CONTAMINATION_SQL = (
    f"SELECT contamination, f1_macro FROM ({THRESHOLD_SWEEP_SQL}) s "
    "ORDER BY f1_macro DESC, contamination ASC LIMIT 1")


QUERIES = {
    "confusion_metrics": confusion_metrics,
    "threshold_sweep": threshold_sweep,
    "best_contamination": best_contamination,
}
SQL = {
    "confusion_metrics": CONFUSION_METRICS_SQL,
    "threshold_sweep": THRESHOLD_SWEEP_SQL,
    "best_contamination": BEST_CONTAMINATION_SQL,
}
