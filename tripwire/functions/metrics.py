"""Confusion-matrix metrics (M1-M8) as column expressions.

Counts come from one aggregation (four conditional sums); every derived
metric is an expression over the four counts.  The formulas are kept as SQL
text so that the Spark job and the DuckDB oracle evaluate the same thing.
Zero denominators give 0, as the reference's report does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"


_P0 = _div("tn", "tn + fn")
_R0 = _div("tn", "tn + fp")
_P1 = _div("tp", "tp + fp")
_R1 = _div("tp", "tp + fn")

# name -> SQL over columns tn, fp, fn, tp
METRIC_SQL: dict[str, str] = {
    "accuracy": _div("tn + tp", "tn + fp + fn + tp"),
    "precision_normal": _P0,
    "recall_normal": _R0,
    "f1_normal": _f1(_P0, _R0),
    "precision_anomaly": _P1,
    "recall_anomaly": _R1,
    "f1_anomaly": _f1(_P1, _R1),
    "precision_macro": f"(({_P0}) + ({_P1})) / 2",
    "recall_macro": f"(({_R0}) + ({_R1})) / 2",
    "f1_macro": f"(({_f1(_P0, _R0)}) + ({_f1(_P1, _R1)})) / 2",
    "balanced_accuracy": (
        "CASE WHEN tn + fp > 0 AND tp + fn > 0 THEN "
        f"(({_R0}) + ({_R1})) / 2 WHEN tn + fp > 0 THEN {_R0} "
        f"WHEN tp + fn > 0 THEN {_R1} ELSE 0.0 END"),
    "specificity": _div("tn", "tn + fp"),
}
METRIC_NAMES = list(METRIC_SQL)


def confusion_aggs(y: str | Column, p: str | Column) -> list[Column]:
    """M1: tn, fp, fn, tp in one pass (labels fixed to {0, 1})."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [s((y == 0) & (p == 0)).alias("tn"), s((y == 0) & (p == 1)).alias("fp"),
            s((y == 1) & (p == 0)).alias("fn"), s((y == 1) & (p == 1)).alias("tp")]


def with_metrics(counts: DataFrame, digits: int | None = None,
                 names: list[str] | None = None) -> DataFrame:
    """M2-M4, M8 on a frame holding tn, fp, fn, tp (plus supports)."""
    names = names or METRIC_NAMES
    cols = {}
    for n in names:
        e = F.expr(METRIC_SQL[n])
        cols[n] = F.round(e, digits) if digits is not None else e
    cols["support_normal"] = (F.col("tn") + F.col("fp")).cast("long")
    cols["support_anomaly"] = (F.col("fn") + F.col("tp")).cast("long")
    return counts.withColumns(cols)


def _share(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0)"


_HALF = "(CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END)"
#: name -> oracle text over tn, fp, fn, tp
ORACLE_SQL: dict[str, str] = {
    "accuracy": f"1 - {_share('fp + fn', 'tn + fp + fn + tp')} * 1.0 - CASE WHEN tn + fp + fn + tp = 0 THEN 1 ELSE 0 END",
    "precision_normal": _share("tn", "tn + fn"),
    "recall_normal": _share("tn", "tn + fp"),
    "f1_normal": _share("2 * tn", "2 * tn + fn + fp"),
    "precision_anomaly": _share("tp", "tp + fp"),
    "recall_anomaly": _share("tp", "tp + fn"),
    "f1_anomaly": _share("2 * tp", "2 * tp + fn + fp"),
    "precision_macro": f"0.5 * {_share('tn', 'tn + fn')} + 0.5 * {_share('tp', 'tp + fp')}",
    "recall_macro": f"0.5 * {_share('tn', 'tn + fp')} + 0.5 * {_share('tp', 'tp + fn')}",
    "f1_macro": f"{_share('tn', '2 * tn + fn + fp')} + {_share('tp', '2 * tp + fn + fp')}",
    # the mean recall of the classes that occur
    "balanced_accuracy": f"coalesce(({_share('tn', 'tn + fp')} + {_share('tp', 'tp + fn')}) / nullif({_HALF}, 0), 0)",
    "specificity": f"CASE WHEN tn + fp = 0 THEN 0.0 ELSE 1 - {_share('fp', 'tn + fp')} END",
}


def metrics_sql(digits: int) -> str:
    """Every metric as a SQL select fragment for oracle text."""
    parts = [f"round({e}, {digits}) AS {n}" for n, e in ORACLE_SQL.items()]
    parts.append("CAST(tn + fp AS BIGINT) AS support_normal")
    parts.append("CAST(fn + tp AS BIGINT) AS support_anomaly")
    return ",\n       ".join(parts)


def confusion_long(counts: DataFrame, keys: list[str]) -> DataFrame:
    """M9: 2x2 matrix per key in long form (actual, predicted, n)."""
    return counts.select(*keys, F.expr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)"))
