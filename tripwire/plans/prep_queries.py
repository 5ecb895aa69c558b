"""Registered preparation plans (P1-P4, F4, F6, F10, E1-E6) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rowkey import row_key_sql
from ..operators import prep
from ..sources.catalog import EVENTS, LABEL, LINEITEM, PART, RANDOM_STATE, FlowSpec
from ..sources.readers import flow_frame, table
from .common import DIGITS
from .pipeline import TEST_SIZE, keyed_flows, prepare, split_flows

BATCH_SIZE = 2500        # rows per stream batch in the registered plans
SAMPLE_FRAC = 0.8
CAP = 10_000


# ---------------------------------------------------------------- SQL builders
def base_sql(spec: FlowSpec, seed: int = RANDOM_STATE) -> str:
    feats = ", ".join(spec.features)
    return (f"SELECT {row_key_sql(spec.key_cols, seed)} AS row_key, "
            f"({spec.label_sql}) AS {LABEL}, {feats} FROM {spec.table}")


def split_ctes(spec: FlowSpec, test_size: float = TEST_SIZE) -> str:
    """CTEs base, k, t, f, q, s (split), o (arrival order ``ord``)."""
    return f"""base AS ({base_sql(spec)}),
k AS (SELECT {LABEL}, count(*) AS c FROM base GROUP BY {LABEL}),
t AS (SELECT sum(c) AS n, sum(c) - ceil({test_size!r} * sum(c)) AS ntr FROM k),
f AS (SELECT {LABEL}, floor(c * ntr / n) AS fl, c * ntr / n - floor(c * ntr / n) AS rem FROM k, t),
q AS (SELECT {LABEL}, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {LABEL})
        <= (SELECT ntr FROM t) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
s AS (SELECT base.*, CASE WHEN row_number() OVER (PARTITION BY base.{LABEL} ORDER BY row_key) - 1
        < q.quota THEN 'train' ELSE 'test' END AS split FROM base JOIN q ON base.{LABEL} = q.{LABEL}),
o AS (SELECT s.*, CASE WHEN split = 'test' THEN row_number() OVER (PARTITION BY split ORDER BY row_key) - 1 END AS ord FROM s)"""


def encoder_ctes(cols, benign_from: str, prefix: str = "enc_") -> str:
    return ",\n".join(
        f"{prefix}{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT COALESCE(CAST({c} AS VARCHAR), 'nan') AS v FROM {benign_from}) d)"
        for c in cols)


def encoded_expr(c: str, src: str, prefix: str = "enc_") -> str:
    return (f"COALESCE((SELECT code FROM {prefix}{c} WHERE v = COALESCE(CAST({src}.{c} AS VARCHAR), "
            f"'nan')), 0)")


def prepared_ctes(spec: FlowSpec, digits: int | None = DIGITS) -> str:
    """... plus e (encoded), p (scaling params per feature), x (prepared, rounded to ``digits``)."""
    cats = list(spec.categorical)
    enc = encoder_ctes(cats, "(SELECT * FROM o WHERE split = 'train' AND ANOMALY = 0) bt")
    enc_cols = ", ".join(
        [f"o.{c}" for c in spec.numeric] + [f"{encoded_expr(c, 'o')} AS {c}" for c in cats])
    params = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr "
        f"FROM e WHERE split = 'train' AND {LABEL} = 0" for c in spec.features)
    before, after = ("", "") if digits is None else ("round(", f", {digits})")
    scaled = ", ".join(
        f"{before}(CAST(e.{c} AS DOUBLE) - (SELECT median FROM p WHERE feature = '{c}')) / "
        f"(SELECT CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END FROM p WHERE feature = '{c}')"
        f"{after} AS {c}" for c in spec.features)
    parts = [split_ctes(spec)]
    if enc:
        parts.append(enc)
    parts.append(f"e AS (SELECT o.row_key, o.split, o.ord, o.{LABEL}, {enc_cols} FROM o)")
    parts.append(f"p AS ({params})")
    parts.append(f"x AS (SELECT e.row_key, e.split, e.ord, e.{LABEL}, {scaled} FROM e)")
    return ",\n".join(parts)


# ---------------------------------------------------------------- label_binarize
def label_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type")
    out = prep.binarize_label(ev, "event_type", normal="view")
    return out.groupBy("event_type", LABEL).agg(F.count(F.lit(1)).alias("n"))


LABEL_BINARIZE_SQL = (
    "SELECT event_type, CASE WHEN rtrim(event_type, '.') IS NOT DISTINCT FROM 'view' THEN 0 ELSE 1 END "
    f"AS {LABEL}, count(*) AS n FROM events GROUP BY ALL")


# ---------------------------------------------------------------- ordinal_encode
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoders for part's brand and type fitted on benign parts, applied to all."""
    df = flow_frame(spark, sf_dir, PART)
    enc = prep.fit_ordinal(prep.benign(df), PART.categorical)
    out = enc.transform(df.select("p_partkey", *PART.categorical))
    return out


ORDINAL_ENCODE_SQL = (
    "WITH bt AS (SELECT * FROM part WHERE (" + PART.label_sql + ") = 0),\n"
    + encoder_ctes(PART.categorical, "bt") + "\n"
    + "SELECT p_partkey, " + ", ".join(f"{encoded_expr(c, 'part')} AS {c}" for c in PART.categorical)
    + " FROM part")


# ---------------------------------------------------------------- unseen_to_zero
def unseen_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type encoder fitted on non-error events: 'error' is unseen → 0."""
    df = flow_frame(spark, sf_dir, EVENTS)
    enc = prep.fit_ordinal(prep.benign(df), ["event_type"], unseen="zero")
    coded = enc.transform(df.select("event_type", F.col("event_type").alias("raw")))
    return coded.groupBy(F.col("raw").alias("event_type"), F.col("event_type").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))


UNSEEN_TO_ZERO_SQL = (
    "WITH bt AS (SELECT * FROM events WHERE (" + EVENTS.label_sql + ") = 0),\n"
    + encoder_ctes(["event_type"], "bt") + "\n"
    + f"SELECT event_type, {encoded_expr('event_type', 'events')} AS code, count(*) AS n "
    "FROM events GROUP BY ALL")


# ---------------------------------------------------------------- exact_sample
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keyed_flows(spark, sf_dir, LINEITEM).select("row_key", "row_pfx")
    return prep.exact_sample(base, SAMPLE_FRAC).select("row_key")


EXACT_SAMPLE_SQL = (
    f"WITH base AS ({base_sql(LINEITEM)}),\n"
    "r AS (SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS sample_idx FROM base)\n"
    f"SELECT row_key FROM r WHERE sample_idx < (SELECT round({SAMPLE_FRAC} * count(*)) FROM base)")


# ---------------------------------------------------------------- capped samples
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keyed_flows(spark, sf_dir, LINEITEM).select("row_key", LABEL)
    return prep.capped_sample(base, CAP)


CAPPED_SAMPLE_SQL = (
    f"WITH base AS ({base_sql(LINEITEM)})\n"
    f"SELECT row_key, {LABEL} FROM base ORDER BY row_key LIMIT {CAP}")


def per_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keyed_flows(spark, sf_dir, LINEITEM).select("row_key", "row_pfx", LABEL)
    return prep.per_class_cap(base, CAP).select("row_key", LABEL)


PER_CLASS_CAP_SQL = (
    f"WITH base AS ({base_sql(LINEITEM)})\n"
    f"SELECT row_key, {LABEL} FROM (SELECT row_key, {LABEL}, row_number() OVER "
    f"(PARTITION BY {LABEL} ORDER BY row_key) AS rn FROM base) z WHERE rn <= {CAP}")


# ---------------------------------------------------------------- stratified_split
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_flows(spark, sf_dir, LINEITEM).select("row_key", LABEL, "split", "ord")


STRATIFIED_SPLIT_SQL = (
    f"WITH {split_ctes(LINEITEM)}\nSELECT row_key, {LABEL}, split, ord FROM o")


# ---------------------------------------------------------------- batch_assign
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = split_flows(spark, sf_dir, LINEITEM).filter(F.col("split") == "test")
    out = prep.assign_batches(test, BATCH_SIZE)
    return out.select("row_key", "ord", "batch_id")


BATCH_ASSIGN_SQL = (
    f"WITH {split_ctes(LINEITEM)}\n"
    f"SELECT row_key, ord, CAST(floor(ord / {BATCH_SIZE}) AS INTEGER) AS batch_id "
    "FROM o WHERE split = 'test'")


# ---------------------------------------------------------------- robust scaling
def robust_scale_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepare(spark, sf_dir, LINEITEM)
    rows = [(c, round(m, DIGITS), round(s, DIGITS)) for c, m, s in p.scaling.as_rows()]
    return spark.createDataFrame(rows, "feature string, median double, scale double")


ROBUST_SCALE_PARAMS_SQL = (
    f"WITH {prepared_ctes(LINEITEM)}\n"
    f"SELECT feature, round(median, {DIGITS}) AS median, "
    f"round(CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END, {DIGITS}) AS scale FROM p")


def prepared_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full hand-over table: split, order, label and scaled features."""
    p = prepare(spark, sf_dir, LINEITEM)
    return p.table.withColumns({c: F.round(c, DIGITS) for c in LINEITEM.features})


PREPARED_FLOWS_SQL = f"WITH {prepared_ctes(LINEITEM)}\nSELECT * FROM x"


# ---------------------------------------------------------------- shape census
def shape_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    fam = prep.feature_families(df)
    n = df.count()
    return spark.createDataFrame(
        [(n, len(df.columns), len(fam["numeric"]), len(fam["categorical"]))],
        "n_rows long, n_columns long, n_numeric long, n_string long")


SHAPE_CENSUS_SQL = (
    "SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS n_columns, "
    "count(*) FILTER (WHERE data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT',"
    "'FLOAT','DOUBLE') OR data_type LIKE 'DECIMAL%') AS n_numeric, "
    "count(*) FILTER (WHERE data_type = 'VARCHAR') AS n_string "
    "FROM information_schema.columns WHERE table_name = 'lineitem'")


QUERIES = {
    "label_binarize": label_binarize,
    "ordinal_encode": ordinal_encode,
    "unseen_to_zero": unseen_to_zero,
    "exact_sample": exact_sample,
    "capped_sample": capped_sample,
    "per_class_cap": per_class_cap,
    "stratified_split": stratified_split,
    "batch_assign": batch_assign,
    "robust_scale_params": robust_scale_params,
    "prepared_flows": prepared_flows,
    "shape_census": shape_census,
}
SQL = {
    "label_binarize": LABEL_BINARIZE_SQL,
    "ordinal_encode": ORDINAL_ENCODE_SQL,
    "unseen_to_zero": UNSEEN_TO_ZERO_SQL,
    "exact_sample": EXACT_SAMPLE_SQL,
    "capped_sample": CAPPED_SAMPLE_SQL,
    "per_class_cap": PER_CLASS_CAP_SQL,
    "stratified_split": STRATIFIED_SPLIT_SQL,
    "batch_assign": BATCH_ASSIGN_SQL,
    "robust_scale_params": ROBUST_SCALE_PARAMS_SQL,
    "prepared_flows": PREPARED_FLOWS_SQL,
    "shape_census": SHAPE_CENSUS_SQL,
}
