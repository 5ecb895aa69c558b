"""Evaluation records from rule detectors over the driver tables.

Each dataset (a driver table mapped to the flow model) is screened by three
rules on its score column, all cut from benign rows:

* ``quantile_rule``: score above the benign ``1 - 0.45`` quantile;
* ``iqr_rule``: score outside the benign Tukey fences (1.5 IQR);
* ``zscore_rule``: |score - benign mean| above one benign standard deviation.

One scan per dataset computes all three confusion matrices (conditional
sums), the rows are stacked, metrics derived, and the per-model records —
which carry different parameter columns — are unioned by name (R1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import with_metrics
from ..functions.quantiles import exact_percentiles
from ..operators.compare import union_records
from ..sources.catalog import CUSTOMER, EVENTS, LABEL, LINEITEM, ORDERS, PART, FlowSpec
from .common import DIGITS, confusion_sql, flows

RECORD_SPECS = [LINEITEM, EVENTS, ORDERS, CUSTOMER, PART]
MODELS = ["iqr_rule", "quantile_rule", "zscore_rule"]
CONTAMINATION = 0.45
WHISKER = 1.5
Z = 1.0
PARAMS = {"quantile_rule": ("contamination", CONTAMINATION), "iqr_rule": ("whisker", WHISKER),
          "zscore_rule": ("z", Z)}


def _rule_preds(spec: FlowSpec, cuts: dict) -> dict:
    s = F.col(spec.score_col)
    return {
        "quantile_rule": s > F.lit(cuts["q"]),
        "iqr_rule": (s < F.lit(cuts["lo"])) | (s > F.lit(cuts["hi"])),
        "zscore_rule": F.abs(s - F.lit(cuts["mu"])) > F.lit(Z * cuts["sd"]),
    }


def dataset_records(spark: SparkSession, sf_dir: str, spec: FlowSpec) -> DataFrame:
    df = flows(spark, sf_dir, spec).select(spec.score_col, LABEL)
    ben = df.filter(F.col(LABEL) == 0)
    qs = exact_percentiles(ben, [spec.score_col], [0.25, 1 - CONTAMINATION, 0.75])
    q1, q, q3 = (qs[("", spec.score_col, x)] for x in (0.25, 1 - CONTAMINATION, 0.75))
    mom = ben.agg(F.avg(spec.score_col).alias("mu"), F.stddev_samp(spec.score_col).alias("sd")).first()
    cuts = {"q": q, "lo": q1 - WHISKER * (q3 - q1), "hi": q3 + WHISKER * (q3 - q1),
            "mu": mom.mu, "sd": mom.sd}
    preds = _rule_preds(spec, cuts)
    y = F.col(LABEL)
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = []
    for m in MODELS:
        p = preds[m]
        aggs += [s((y == 0) & ~p).alias(f"{m}_tn"), s((y == 0) & p).alias(f"{m}_fp"),
                 s((y == 1) & ~p).alias(f"{m}_fn"), s((y == 1) & p).alias(f"{m}_tp")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{m}', {m}_tn, {m}_fp, {m}_fn, {m}_tp" for m in MODELS)
    long = wide.selectExpr(f"stack({len(MODELS)}, {args}) AS (model, tn, fp, fn, tp)")
    long = long.withColumns({"total_processed": F.expr("tn + fp + fn + tp"),
                             "stage2_calls": F.expr("fp + tp")})
    long = with_metrics(long, DIGITS).withColumn("stage2_call_rate", F.round(F.expr(
        "CASE WHEN total_processed = 0 THEN 0.0 ELSE CAST(stage2_calls AS DOUBLE) / total_processed END"),
        DIGITS))
    long = long.withColumns({"dataset": F.lit(spec.name),
                             "source_file": F.concat(F.lit(f"{spec.name}/"), F.col("model"))})
    per_model = []
    for m in MODELS:
        pname, pval = PARAMS[m]
        per_model.append(long.filter(F.col("model") == m).withColumn(pname, F.lit(float(pval))))
    return union_records(per_model)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all datasets.

    The datasets are independent, so their (small) jobs are submitted from
    driver threads concurrently and share the executors."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(RECORD_SPECS)) as pool:
        frames = list(pool.map(lambda s: dataset_records(spark, sf_dir, s), RECORD_SPECS))
    return union_records(frames)


def _dataset_sql(spec: FlowSpec) -> str:
    t = f"(SELECT {spec.score_col} AS s, ({spec.label_sql}) AS y FROM {spec.table})"
    b = (f"(SELECT quantile_cont(s, 0.25) AS q1, quantile_cont(s, {1 - CONTAMINATION!r}) AS q, "
         f"quantile_cont(s, 0.75) AS q3, avg(s) AS mu, stddev_samp(s) AS sd FROM {t} tb WHERE y = 0)")
    rules = {
        "quantile_rule": "s > b.q",
        "iqr_rule": f"s < b.q1 - {WHISKER} * (b.q3 - b.q1) OR s > b.q3 + {WHISKER} * (b.q3 - b.q1)",
        "zscore_rule": f"abs(s - b.mu) > {Z} * b.sd",
    }
    parts = []
    for m in MODELS:
        pname, pval = PARAMS[m]
        src = f"SELECT y, CASE WHEN {rules[m]} THEN 1 ELSE 0 END AS p FROM {t} tt, {b} b"
        parts.append(
            f"SELECT '{m}' AS model, '{spec.name}' AS dataset, '{spec.name}/{m}' AS source_file, "
            f"CAST({pval!r} AS DOUBLE) AS {pname}, c.* FROM ({confusion_sql(src, 'y', 'p')}) c")
    return "\nUNION ALL BY NAME ".join(parts)


CORPUS_SQL = "\nUNION ALL BY NAME ".join(f"({_dataset_sql(s)})" for s in RECORD_SPECS)
