"""Result comparison over evaluation records.

A record is one flat row per (model, dataset) run.  Records of different
models carry different columns; the corpus is their by-name union.  Every
report below is a small aggregation or window over that corpus, which has
one row per run (tens to thousands of rows), so none of them moves data of
the size of the flow tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Metrics where a larger value is better; any other metric sorts ascending.
HIGHER_IS_BETTER = ["accuracy", "balanced_accuracy", "f1_macro", "f1_anomaly",
                    "precision_anomaly", "recall_anomaly", "precision_macro", "recall_macro"]
# Canonical names of columns that older records spell differently.
CANONICAL = {"elapsed_sec": "total_time_sec", "time_sec": "total_time_sec",
             "balanced_acc": "balanced_accuracy"}
# Key metrics tried in order when the requested one is absent.
KEY_METRICS = ["accuracy", "balanced_accuracy", "f1_macro", "f1_anomaly", "precision_anomaly",
               "recall_anomaly", "stage2_call_rate", "total_time_sec"]
# ---------------------------------------------------------------------------------


def canonicalize(df: DataFrame) -> DataFrame:
    """rename legacy columns; an existing canonical column wins."""
    out = df
    for old, new in CANONICAL.items():
        if old in out.columns:
            if new in out.columns:
                out = out.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
            else:
                out = out.withColumnRenamed(old, new)
    return out


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """R1 + F13: by-name union, missing columns null, ``model, dataset`` first."""
    frames = [canonicalize(f) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    first = [c for c in ("model", "dataset") if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def pick_metric(df: DataFrame, metric: str) -> str:
    if metric in df.columns:
        return metric
    for m in KEY_METRICS:
        if m in df.columns:
            return m
    raise ValueError(f"no metric column among {[metric, *KEY_METRICS]}")


def best_per_group(df: DataFrame, group_by: str | Sequence[str], metric: str = "f1_macro") -> DataFrame:
    """One row per group, best by ``metric`` (direction by name,
    nulls last), ties by model then dataset.  ``'both'`` = (model, dataset)."""
    keys = ["model", "dataset"] if group_by == "both" else (
        [group_by] if isinstance(group_by, str) else list(group_by))
    if not {metric, *KEY_METRICS} & set(df.columns):
        return df.dropDuplicates(keys)          # nothing to choose by
    m = pick_metric(df, metric)
    order = F.col(m).desc_nulls_last() if m in HIGHER_IS_BETTER else F.col(m).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order, F.col("model"), F.col("dataset"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def winner_count(df: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """R4 + R6: best model per dataset, then how many datasets each model wins."""
    best = best_per_group(df, "dataset", metric)
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("n_wins"))


def pivot_metric(df: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """Dataset × model table of ``max(metric)``; the model list is given
    so the pivot needs no extra distinct pass."""
    return df.groupBy("dataset").pivot("model", list(models)).agg(F.max(metric))


def tradeoff(df: DataFrame, base: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """Per dataset, ``(other - base) / base * 100`` and the absolute
    delta for each metric (pivot, no self-join)."""
    wide = df.filter(F.col("model").isin(base, other)).groupBy("dataset").pivot(
        "model", [base, other]).agg(*[F.max(m).alias(m) for m in metrics])
    cols = []
    for m in metrics:
        a, b = F.col(f"{base}_{m}"), F.col(f"{other}_{m}")
        cols += [(b - a).alias(f"delta_{m}"),
                 F.when(a == 0, F.lit(None)).otherwise((b - a) / a * 100.0).alias(f"pct_{m}")]
    return wide.select("dataset", *cols)


def call_rate_reduction(df: DataFrame) -> DataFrame:
    """Stage-2 call rate per dataset (first model by name) and the share
    of traffic the screen keeps away from stage 2."""
    first = df.filter(F.col("stage2_call_rate").isNotNull()).groupBy("dataset").agg(
        F.min_by("stage2_call_rate", "model").alias("call_rate"))
    return first.withColumn("reduction_pct", 100.0 - F.col("call_rate") * 100.0)


def metric_long(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per (model, dataset, metric)."""
    args = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return df.selectExpr("model", "dataset", f"stack({len(metrics)}, {args}) AS (metric, value)")


def distinct_lists(df: DataFrame) -> DataFrame:
    """The datasets and models present."""
    return (df.select(F.lit("dataset").alias("kind"), F.col("dataset").alias("name"))
            .unionByName(df.select(F.lit("model").alias("kind"), F.col("model").alias("name")))
            .distinct())


def markdown_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """S11 helper: metrics as 4-decimal text, null as ``N/A``."""
    return df.select("model", "dataset", *[
        F.when(F.col(m).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", F.col(m))).alias(m)
        for m in metrics])


def to_markdown(df: DataFrame, metrics: Sequence[str]) -> str:
    """A Markdown table of the best-results report (tens of rows)."""
    rows = markdown_rows(df, metrics).collect()
    head = ["model", "dataset", *metrics]
    lines = ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|"]
    lines += ["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows]
    return "\n".join(lines)


# --- report helpers (F14-F17, R7, R11-R14) ------------------------------------------
STAGE1_MODEL = "isolation_forest"


def exclude_stage1(df: DataFrame) -> DataFrame:
    """stage-2 runs only."""
    return df.filter(F.col("model") != STAGE1_MODEL)


def time_fallback(df: DataFrame) -> DataFrame:
    """``total_time_sec``, else ``elapsed_sec``, else 0."""
    cols = [F.col(c) for c in ("total_time_sec", "elapsed_sec") if c in df.columns]
    return df.withColumn("time_sec", F.coalesce(*cols, F.lit(0.0)))


def config_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """F16: the first record (by model, dataset) with ``column == value``."""
    return df.filter(F.col(column) == F.lit(value)).orderBy("model", "dataset").limit(1)


def display_names(df: DataFrame, mapping: dict, col: str = "model",
                  out: str = "model_display") -> DataFrame:
    """short name → display title (unmapped names kept)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.coalesce(m[F.col(col)], F.col(col)))


def model_table(df: DataFrame, columns: Sequence[str], missing: str = "-") -> DataFrame:
    """One row per model with the chosen columns as text, ``-`` where the
    model's records lack the column."""
    return df.select("model", "dataset", *[
        F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) if c in df.columns
        else F.lit(missing).alias(c) for c in columns])


def by_parameter(df: DataFrame, param: str, metrics: Sequence[str]) -> DataFrame:
    """Metric (or time) series ordered by a run parameter."""
    return (df.filter(F.col(param).isNotNull())
            .select("model", "dataset", param, *[m for m in metrics if m in df.columns])
            .orderBy("model", "dataset", param))


def best_model_by_name(df: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Per dataset, the model name with the largest metric (ties by name)."""
    best = best_per_group(df.filter(F.col(metric).isNotNull()), "dataset", metric)
    return best.select("dataset", F.col("model").alias("best_model"), metric)
