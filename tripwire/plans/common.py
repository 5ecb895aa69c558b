"""Shared pieces of the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRIC_NAMES, confusion_aggs, metrics_sql, with_metrics
from ..sources.catalog import LABEL, FlowSpec
from ..sources.readers import flow_frame

DIGITS = 6   # float noise between engines is ~1e-16; compare at 6 decimals


def sig_round(col: str, digits: int = 10):
    """Round to ``digits`` significant digits with exact powers of ten, so
    large-magnitude statistics agree across engines despite 1e-16 noise."""
    x = F.col(col)
    e = F.floor(F.log10(F.abs(x))) - (digits - 1)
    return (F.when(x.isNull() | (x == 0), x)
            .when(e < 0, F.round(x * F.pow(F.lit(10.0), -e)) / F.pow(F.lit(10.0), -e))
            .otherwise(F.round(x / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e)))


def sig_round_sql(x: str, digits: int = 10) -> str:
    e = f"(floor(log10(abs({x}))) - {digits - 1})"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} WHEN {e} < 0 THEN "
            f"round({x} * pow(10.0, -{e})) / pow(10.0, -{e}) "
            f"ELSE round({x} / pow(10.0, {e})) * pow(10.0, {e}) END")


def stable_round(col: str, digits: int = DIGITS):
    """Round a float aggregate so both engines agree: 12 significant digits
    first (absorbs summation-order noise), then half-up at ``digits``
    decimals with plain IEEE arithmetic (no engine-specific tie rule)."""
    scale = float(10 ** digits)
    x = sig_round(col, 12)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def stable_round_sql(x: str, digits: int = DIGITS) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(floor(({sig_round_sql(x, 12)}) * {scale} + 0.5) / {scale})"


def flows(spark: SparkSession, sf_dir: str, spec: FlowSpec) -> DataFrame:
    return flow_frame(spark, sf_dir, spec)


def confusion_row(df: DataFrame, pred, keys: list[str] | None = None) -> DataFrame:
    """M1-M5: counts, call count/rate and all metrics, optionally per key."""
    keys = keys or []
    pred = F.col(pred) if isinstance(pred, str) else pred
    aggs = confusion_aggs(F.col(LABEL), pred) + [
        F.count(F.lit(1)).cast("long").alias("total_processed"),
        F.sum(pred).cast("long").alias("stage2_calls"),
    ]
    counts = (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs))
    out = with_metrics(counts, DIGITS).withColumn(
        "stage2_call_rate", F.round(F.expr(
            "CASE WHEN total_processed = 0 THEN 0.0 ELSE "
            "CAST(stage2_calls AS DOUBLE) / total_processed END"), DIGITS))
    return out


def confusion_sql(source: str, y: str, p: str, keys: list[str] | None = None) -> str:
    """Oracle text matching :func:`confusion_row` over ``source`` (a subquery)."""
    keys = keys or []
    kc = "".join(f"{k}, " for k in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    counts = (
        f"SELECT {kc}"
        f"CAST(SUM(CASE WHEN {y} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
        f"CAST(SUM(CASE WHEN {y} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
        f"CAST(SUM(CASE WHEN {y} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
        f"CAST(SUM(CASE WHEN {y} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
        f"CAST(COUNT(*) AS BIGINT) AS total_processed, CAST(SUM({p}) AS BIGINT) AS stage2_calls "
        f"FROM ({source}) src{grp}")
    return (
        f"SELECT *, {metrics_sql(DIGITS)},\n"
        f"       round(CASE WHEN total_processed = 0 THEN 0.0 ELSE "
        f"CAST(stage2_calls AS DOUBLE) / total_processed END, {DIGITS}) AS stage2_call_rate\n"
        f"FROM ({counts}) cnt")


__all__ = ["DIGITS", "METRIC_NAMES", "confusion_row", "confusion_sql", "flows"]
