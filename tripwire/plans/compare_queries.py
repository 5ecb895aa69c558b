"""Registered comparison plans (R1-R16, M8, M9) over the rule-detector corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import confusion_long
from ..operators import compare
from .common import DIGITS
from .records import CORPUS_SQL, MODELS, corpus

SIX = ["accuracy", "precision_anomaly", "recall_anomaly", "f1_anomaly", "f1_macro",
       "balanced_accuracy"]
C = f"WITH corpus AS ({CORPUS_SQL})\n"


def r6(e: str) -> str:
    return f"round({e}, {DIGITS})"


def result_corpus(spark, sf_dir):
    return corpus(spark, sf_dir)


RESULT_CORPUS_SQL = C + "SELECT * FROM corpus"


def best_per_group(spark, sf_dir):
    return compare.best_per_group(corpus(spark, sf_dir), "dataset", "f1_macro")


BEST_PER_GROUP_SQL = C + (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "
    "f1_macro DESC NULLS LAST, model, dataset) AS rn FROM corpus) z WHERE rn = 1")


def lowest_call_rate(spark, sf_dir):
    """A metric outside the higher-is-better list sorts ascending."""
    return compare.best_per_group(corpus(spark, sf_dir), "dataset", "stage2_call_rate")


LOWEST_CALL_RATE_SQL = C + (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "
    "stage2_call_rate ASC NULLS LAST, model, dataset) AS rn FROM corpus) z WHERE rn = 1")


def winner_count(spark, sf_dir):
    return compare.winner_count(corpus(spark, sf_dir))


WINNER_COUNT_SQL = C + (
    "SELECT model, count(*) AS n_wins FROM (SELECT *, row_number() OVER (PARTITION BY dataset "
    "ORDER BY f1_macro DESC NULLS LAST, model, dataset) AS rn FROM corpus) z WHERE rn = 1 GROUP BY model")


def pivot_metric(spark, sf_dir):
    return compare.pivot_metric(corpus(spark, sf_dir), "f1_macro", MODELS)


PIVOT_METRIC_SQL = C + "SELECT dataset, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN f1_macro END) AS {m}" for m in MODELS) + " FROM corpus GROUP BY dataset"

TRADE_BASE, TRADE_OTHER, TRADE_METRICS = "quantile_rule", "zscore_rule", ["f1_macro", "stage2_call_rate"]


def tradeoff_pct(spark, sf_dir):
    out = compare.tradeoff(corpus(spark, sf_dir), TRADE_BASE, TRADE_OTHER, TRADE_METRICS)
    return out.withColumns({c: F.round(c, DIGITS) for c in out.columns if c != "dataset"})


def _trade_sql():
    cols = []
    for m in TRADE_METRICS:
        a = f"max(CASE WHEN model = '{TRADE_BASE}' THEN {m} END)"
        b = f"max(CASE WHEN model = '{TRADE_OTHER}' THEN {m} END)"
        cols.append(f"{r6(f'{b} - {a}')} AS delta_{m}")
        cols.append(f"{r6(f'CASE WHEN {a} = 0 THEN NULL ELSE ({b} - {a}) / {a} * 100.0 END')} AS pct_{m}")
    return C + f"SELECT dataset, {', '.join(cols)} FROM corpus WHERE model IN ('{TRADE_BASE}', '{TRADE_OTHER}') GROUP BY dataset"


TRADEOFF_PCT_SQL = _trade_sql()


def call_rate_reduction(spark, sf_dir):
    out = compare.call_rate_reduction(corpus(spark, sf_dir))
    return out.withColumn("reduction_pct", F.round("reduction_pct", DIGITS))


CALL_RATE_REDUCTION_SQL = C + (
    "SELECT dataset, call_rate, " + r6("100.0 - call_rate * 100.0") + " AS reduction_pct FROM ("
    "SELECT dataset, arg_min(stage2_call_rate, model) AS call_rate FROM corpus "
    "WHERE stage2_call_rate IS NOT NULL GROUP BY dataset) z")


def metric_long(spark, sf_dir):
    return compare.metric_long(corpus(spark, sf_dir), SIX)


METRIC_LONG_SQL = C + "\nUNION ALL ".join(
    f"SELECT model, dataset, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM corpus" for m in SIX)


def distinct_lists(spark, sf_dir):
    return compare.distinct_lists(corpus(spark, sf_dir))


DISTINCT_LISTS_SQL = C + ("SELECT DISTINCT 'dataset' AS kind, dataset AS name FROM corpus UNION "
                          "SELECT DISTINCT 'model' AS kind, model AS name FROM corpus")


def confusion_by_model(spark, sf_dir):
    return confusion_long(corpus(spark, sf_dir), ["model", "dataset"])


CONFUSION_BY_MODEL_SQL = C + (
    "SELECT model, dataset, v.actual, v.predicted, CASE WHEN v.actual = 0 AND v.predicted = 0 THEN tn "
    "WHEN v.actual = 0 THEN fp WHEN v.predicted = 0 THEN fn ELSE tp END AS n FROM corpus, "
    "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)")


def best_model_by_name(spark, sf_dir):
    """The best model per dataset by macro F1."""
    return compare.best_model_by_name(corpus(spark, sf_dir), "f1_macro")


BEST_MODEL_BY_NAME_SQL = C + (
    "SELECT dataset, model AS best_model, f1_macro FROM (SELECT *, row_number() OVER (PARTITION BY "
    "dataset ORDER BY f1_macro DESC NULLS LAST, model, dataset) AS rn FROM corpus "
    "WHERE f1_macro IS NOT NULL) z WHERE rn = 1")

TABLE_COLS = ["contamination", "whisker", "z", "confusion_tp"]


def model_table(spark, sf_dir):
    """Fixed columns per run as text, '-' where a model lacks them."""
    c = corpus(spark, sf_dir).withColumnRenamed("tp", "confusion_tp")
    return compare.model_table(c, TABLE_COLS)


MODEL_TABLE_SQL = C + "SELECT model, dataset, " + ", ".join(
    f"COALESCE(CAST({'tp' if c == 'confusion_tp' else c} AS VARCHAR), '-') AS {c}"
    for c in TABLE_COLS) + " FROM corpus"


QUERIES = {
    "best_model_by_name": best_model_by_name, "model_table": model_table,
    "result_corpus": result_corpus, "best_per_group": best_per_group,
    "lowest_call_rate": lowest_call_rate, "winner_count": winner_count,
    "pivot_metric": pivot_metric, "tradeoff_pct": tradeoff_pct,
    "call_rate_reduction": call_rate_reduction, "metric_long": metric_long,
    "distinct_lists": distinct_lists, "confusion_by_model": confusion_by_model,
}
SQL = {
    "best_model_by_name": BEST_MODEL_BY_NAME_SQL, "model_table": MODEL_TABLE_SQL,
    "result_corpus": RESULT_CORPUS_SQL, "best_per_group": BEST_PER_GROUP_SQL,
    "lowest_call_rate": LOWEST_CALL_RATE_SQL, "winner_count": WINNER_COUNT_SQL,
    "pivot_metric": PIVOT_METRIC_SQL, "tradeoff_pct": TRADEOFF_PCT_SQL,
    "call_rate_reduction": CALL_RATE_REDUCTION_SQL, "metric_long": METRIC_LONG_SQL,
    "distinct_lists": DISTINCT_LISTS_SQL, "confusion_by_model": CONFUSION_BY_MODEL_SQL,
}
