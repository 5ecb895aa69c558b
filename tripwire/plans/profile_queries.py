"""Registered profiling plans (A2-A25) over the labelled lineitem flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile
from ..sources.catalog import LABEL, LINEITEM, PLACEHOLDERS
from ..sources.readers import flow_frame, table
from .common import DIGITS, sig_round, sig_round_sql, stable_round, stable_round_sql

NUM = list(LINEITEM.numeric)
LI = f"(SELECT *, ({LINEITEM.label_sql}) AS {LABEL} FROM lineitem)"
PCT = "CAST(100 AS DOUBLE)"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (float noise between engines)."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields
                           if isinstance(f.dataType, T.DoubleType)})


def r6(e: str) -> str:
    return f"round({e}, {DIGITS})"


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_frame(spark, sf_dir, LINEITEM)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- A2 missing
def missing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return rounded(profile.missing_counts(df))


def _missing_sql(cols):
    inner = _union([f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) "
                    f"AS BIGINT) AS n_missing, count(*) AS n FROM lineitem" for c in cols])
    return (f"SELECT feature, n_missing, {r6(f'CASE WHEN n = 0 THEN 0.0 ELSE n_missing * {PCT} / n END')}"
            f" AS pct_missing FROM ({inner}) z")


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
MISSING_SQL = _missing_sql(LINEITEM_COLS)


# ---------------------------------------------------------------- A3 placeholders
PH_TABLE, PH_COLS = "conversations", ["role", "text"]


def placeholders(spark, sf_dir):
    return profile.placeholder_counts(table(spark, sf_dir, PH_TABLE), PH_COLS)


_ph_list = ", ".join("'" + p.replace("'", "''") + "'" for p in PLACEHOLDERS)
PLACEHOLDERS_SQL = _union([
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS placeholder, count(*) AS n FROM {PH_TABLE} "
    f"WHERE CAST({c} AS VARCHAR) IN ({_ph_list}) GROUP BY 1, 2" for c in PH_COLS])


# ---------------------------------------------------------------- A4 infinities
def infinities(spark, sf_dir):
    return profile.infinite_counts(li(spark, sf_dir), NUM)


INFINITIES_SQL = _union([
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE THEN 1 "
    f"ELSE 0 END) AS BIGINT) AS n_inf FROM lineitem" for c in NUM])


# ---------------------------------------------------------------- A5 zeros
def zeros(spark, sf_dir):
    return rounded(profile.zero_counts(li(spark, sf_dir), NUM, top=10))


ZEROS_SQL = (
    "SELECT feature, n_zero, " + r6(f"CASE WHEN n = 0 THEN 0.0 ELSE n_zero * {PCT} / n END")
    + " AS pct_zero FROM (" + _union([
        f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, "
        f"count(*) AS n FROM lineitem" for c in NUM]) + ") z ORDER BY n_zero DESC, feature LIMIT 10")


# ---------------------------------------------------------------- A6-A8 duplicates
def duplicates(spark, sf_dir):
    """Exact duplicates over all columns; feature duplicates and conflicts over all features."""
    df = li(spark, sf_dir)
    return rounded(profile.duplicate_summary(df, LINEITEM.features, columns=[*LINEITEM_COLS, LABEL]))


def document_duplicates(spark, sf_dir):
    """Copies among documents: rows but for their id, features without the source, which
    is the label that copies may disagree in."""
    df = table(spark, sf_dir, "documents")
    return rounded(profile.duplicate_summary(df, ["text", "lang", "n_chars"], "source"))


def _duplicates_sql(source: str, features, label: str, columns) -> str:
    f, r = ", ".join(features), ", ".join(columns)
    return f"""WITH x AS (SELECT * FROM {source} t),
s AS (SELECT (SELECT count(*) FROM x) AS n_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {r} FROM x) d) AS n_distinct_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {f} FROM x) d) AS n_distinct_features,
  (SELECT count(*) FROM (SELECT {f} FROM (SELECT DISTINCT {f}, {label} FROM x) l GROUP BY {f} HAVING count(*) > 1) g)
  AS n_conflicting_groups)
SELECT n_rows, n_rows - n_distinct_rows AS n_duplicate_rows,
  {r6(f"CASE WHEN n_rows = 0 THEN 0.0 ELSE (n_rows - n_distinct_rows) * {PCT} / n_rows END")} AS pct_duplicate_rows,
  n_rows - n_distinct_features AS n_duplicate_features,
  {r6(f"CASE WHEN n_rows = 0 THEN 0.0 ELSE (n_rows - n_distinct_features) * {PCT} / n_rows END")} AS pct_duplicate_features,
  n_conflicting_groups FROM s"""


DUPLICATES_SQL = _duplicates_sql(LI, LINEITEM.features, LABEL, [*LINEITEM_COLS, LABEL])
DOCUMENT_DUPLICATES_SQL = _duplicates_sql("documents", ["text", "lang", "n_chars"], "source", ["text", "lang", "n_chars", "source"])


# ---------------------------------------------------------------- A9-A11 class distribution
def class_dist(spark, sf_dir):
    return rounded(profile.class_distribution(li(spark, sf_dir)))


CLASS_DIST_SQL = f"""WITH c AS (SELECT {LABEL}, count(*) AS n FROM {LI} x GROUP BY 1),
k AS (SELECT * FROM (VALUES (0), (1)) v({LABEL})),
f AS (SELECT k.{LABEL}, COALESCE(c.n, 0) AS n FROM k LEFT JOIN c ON k.{LABEL} = c.{LABEL})
SELECT {LABEL}, CAST(n AS BIGINT) AS n,
  {r6("CASE WHEN sum(n) OVER () = 0 THEN 0.0 ELSE n / sum(n) OVER () END")} AS share,
  {r6("CASE WHEN min(n) OVER () > 0 THEN max(n) OVER () / min(n) OVER () END")} AS imbalance_ratio FROM f"""


# ---------------------------------------------------------------- A12 attack types
def attack_types(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.expr("TRIM(TRAILING '.' FROM event_type)").alias("label"))
    return profile.top_values(ev, "label", 10)


ATTACK_TYPES_SQL = ("SELECT rtrim(event_type, '.') AS value, count(*) AS n FROM events "
                    "GROUP BY 1 ORDER BY n DESC, value LIMIT 10")


# ---------------------------------------------------------------- A13 categorical summary
CAT_COLS = ["o_orderstatus", "o_orderpriority"]


def categorical_summary(spark, sf_dir):
    return profile.categorical_summary(table(spark, sf_dir, "orders"), CAT_COLS, top=5)


CATEGORICAL_SUMMARY_SQL = f"""WITH c AS ({_union([f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 2" for c in CAT_COLS])}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS rank FROM c),
d AS (SELECT feature, count(*) AS n_distinct FROM c WHERE value IS NOT NULL GROUP BY 1)
SELECT r.feature, r.value, r.n, r.rank, d.n_distinct FROM r LEFT JOIN d ON r.feature = d.feature WHERE rank <= 5"""


# ---------------------------------------------------------------- A14 distinct counts
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"))


DISTINCT_COUNTS_SQL = _union([f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM lineitem"
                              for c in LINEITEM_COLS])


# ---------------------------------------------------------------- A15/A16 describe
def describe(spark, sf_dir):
    out = profile.describe(li(spark, sf_dir), NUM)
    out = out.withColumns({c: stable_round(c) for c in ("mean", "std", "cv")})
    return rounded(out)


DESCRIBE_SQL = _union([
    f"SELECT '{c}' AS feature, count({c}) AS count, {r6(stable_round_sql(f'avg({c})'))} AS mean, "
    f"{r6(stable_round_sql(f'stddev_samp({c})'))} AS std, {r6(f'CAST(min({c}) AS DOUBLE)')} AS min, "
    f"{r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS q75, {r6(f'CAST(max({c}) AS DOUBLE)')} AS max, "
    f"{r6(f'CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)')} AS range, "
    f"{r6(stable_round_sql(f'CASE WHEN avg({c}) = 0 THEN NULL ELSE stddev_samp({c}) / avg({c}) END'))} AS cv "
    f"FROM lineitem" for c in NUM])


# ---------------------------------------------------------------- A17 low variance
def low_variance(spark, sf_dir):
    out = profile.low_variance(li(spark, sf_dir), NUM)
    return out.withColumn("variance", sig_round("variance"))


LOW_VARIANCE_SQL = _union([
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, {sig_round_sql(f'var_samp({c})')} AS variance, "
    f"(count(DISTINCT {c}) <= 2 OR COALESCE(var_samp({c}), 0.0) < 0.01) AS low_variance FROM lineitem"
    for c in NUM])


# ---------------------------------------------------------------- A18/A19 correlation pairs
def high_corr(spark, sf_dir):
    out = profile.correlation_pairs(li(spark, sf_dir), NUM, 0.9)
    return rounded(out.withColumns({"r": stable_round("r"), "abs_r": stable_round("abs_r")}))


_pairs = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
HIGH_CORR_SQL = _union([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(stable_round_sql(f'corr({a}, {b})'))} AS r, "
    f"{r6(stable_round_sql(f'abs(corr({a}, {b}))'))} AS abs_r, abs(corr({a}, {b})) > 0.9 AS high FROM lineitem"
    for a, b in _pairs])


# ---------------------------------------------------------------- A18/A19 on 64 dimensions
def embedding_corr(spark, sf_dir):
    """All 2016 Pearson pairs of the 64 embedding dimensions in one aggregation."""
    from ..sources.catalog import EMBEDDINGS

    df = flow_frame(spark, sf_dir, EMBEDDINGS)
    out = profile.correlation_pairs(df, list(EMBEDDINGS.numeric), 0.9)
    return rounded(out.withColumns({"r": stable_round("r"), "abs_r": stable_round("abs_r")}))


def _embedding_corr_sql():
    """All pairs from one scan: every corr in one SELECT, then UNPIVOT."""
    from ..sources.catalog import EMBED_DIM

    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMBED_DIM))
    aggs = ", ".join(f'corr(e{i}, e{j}) AS "e{i}__e{j}"'
                     for i in range(EMBED_DIM) for j in range(i + 1, EMBED_DIM))
    return (f"WITH w AS (SELECT {aggs} FROM (SELECT {cols} FROM embeddings) x),\n"
            "l AS (UNPIVOT w ON COLUMNS(*) INTO NAME k VALUE r)\n"
            "SELECT split_part(k, '__', 1) AS feature_a, split_part(k, '__', 2) AS feature_b, "
            f"{r6(stable_round_sql('r'))} AS r, {r6(stable_round_sql('abs(r)'))} AS abs_r, "
            "abs(r) > 0.9 AS high FROM l")


EMBEDDING_CORR_SQL = _embedding_corr_sql()


# ---------------------------------------------------------------- A20 target correlation
def target_corr(spark, sf_dir):
    out = profile.target_correlation(li(spark, sf_dir), NUM)
    return rounded(out.withColumns({"r": stable_round("r"), "abs_r": stable_round("abs_r")}))


TARGET_CORR_SQL = _union([
    f"SELECT '{c}' AS feature, {r6(stable_round_sql(f'corr(CAST({c} AS DOUBLE), CAST({LABEL} AS DOUBLE))'))} AS r, "
    f"{r6(stable_round_sql(f'abs(corr(CAST({c} AS DOUBLE), CAST({LABEL} AS DOUBLE)))'))} AS abs_r FROM {LI} x"
    for c in NUM])


# ---------------------------------------------------------------- A21 IQR outliers
def iqr_outliers(spark, sf_dir):
    return rounded(profile.iqr_outliers(li(spark, sf_dir), NUM))


def _iqr_sql(c):
    return (f"SELECT '{c}' AS feature, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, "
            f"q3 + 1.5 * (q3 - q1) AS upper, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE "
            f"{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers, "
            f"(SELECT count(*) FROM lineitem) AS n FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3 FROM lineitem) qq")


IQR_OUTLIERS_SQL = (
    f"SELECT feature, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('iqr')} AS iqr, {r6('lower')} AS lower, "
    f"{r6('upper')} AS upper, n_outliers, "
    f"{r6(f'CASE WHEN n = 0 THEN 0.0 ELSE n_outliers * {PCT} / n END')} AS pct_outliers FROM ("
    + _union([_iqr_sql(c) for c in NUM]) + ") z")


# ---------------------------------------------------------------- A25 box summaries
def box_summary(spark, sf_dir):
    return rounded(profile.box_summary(li(spark, sf_dir), NUM))


def _box_sql(c):
    return (f"SELECT '{c}' AS feature, q1, med AS median, q3, "
            f"(SELECT CAST(min({c}) AS DOUBLE) FROM lineitem WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, "
            f"(SELECT CAST(max({c}) AS DOUBLE) FROM lineitem WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, "
            f"quantile_cont({c}, 0.75) AS q3 FROM lineitem) qq")


BOX_SUMMARY_SQL = (
    f"SELECT feature, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3, "
    f"{r6('whisker_low')} AS whisker_low, {r6('whisker_high')} AS whisker_high FROM ("
    + _union([_box_sql(c) for c in NUM]) + ") z")


# ---------------------------------------------------------------- A23/A24 histograms
def histogram(spark, sf_dir):
    return rounded(profile.histogram(li(spark, sf_dir), NUM, bins=50))


def histogram_by_class(spark, sf_dir):
    return rounded(profile.histogram(li(spark, sf_dir), NUM, bins=30, by=LABEL))


def _hist_sql(bins: int, by: str | None) -> str:
    k = f"{by}, " if by else ""
    kx = f"x.{by}, " if by else ""
    on = f" AND l.{by} = x.{by}" if by else ""
    longf = _union([f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {LI} t" for c in NUM])
    on_g = f" AND g.{by} = x.{by}" if by else ""
    kg = f"g.{by}, " if by else ""
    return f"""WITH l AS ({longf}),
g AS (SELECT feature, {k}min(v) AS lo, max(v) AS hi FROM l WHERE isfinite(v) GROUP BY ALL),
x AS (SELECT l.feature, {''.join(f'l.{by}, ' if by else '')}
      CASE WHEN g.hi - g.lo = 0 THEN 0 ELSE least(CAST(floor((l.v - g.lo) / (g.hi - g.lo) * {bins}) AS INTEGER), {bins - 1}) END AS bin
      FROM l JOIN g ON l.feature = g.feature{on.replace('x.', 'g.')} WHERE isfinite(l.v)),
c AS (SELECT x.feature, {kx}x.bin, count(*) AS n FROM x GROUP BY ALL),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.feature, {kg}b.bin, {r6(f'g.lo + b.bin * ((g.hi - g.lo) / {bins})')} AS bin_lo,
  {r6(f'g.lo + (b.bin + 1) * ((g.hi - g.lo) / {bins})')} AS bin_hi, coalesce(x.n, 0) AS n
FROM g CROSS JOIN b LEFT JOIN c x ON x.feature = g.feature AND x.bin = b.bin{on_g}"""


HISTOGRAM_SQL = _hist_sql(50, None)
HISTOGRAM_BY_CLASS_SQL = _hist_sql(30, LABEL)


# ---------------------------------------------------------------- A2-A5, A15, A19-A21, A25 on gaps
# derived columns with nulls, NaN, infinities, placeholders, no value at all and one value only
GAPS = {
    "g_quantity": "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END",
    "g_price": "CASE WHEN l_linenumber = 5 AND l_quantity > 40 THEN CAST('Infinity' AS DOUBLE) "
               "WHEN l_linenumber = 6 AND l_quantity > 45 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END",
    "g_ratio": "CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) END",
    "g_twice": "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS DOUBLE) * 2 + 1 END",
    "g_empty": "CAST(NULL AS DOUBLE)",
    "g_const": "CAST(7 AS DOUBLE)",
    "g_status": "CASE l_linenumber WHEN 1 THEN '?' WHEN 2 THEN '' WHEN 4 THEN 'N/A' ELSE l_linestatus END",
}
G_NUM = [c for c in GAPS if c != "g_status"]
G_FINITE = [c for c in G_NUM if c != "g_price"]
G_SQL = "(SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in GAPS.items()) + f" FROM {LI} b)"
G_CLEAN = "(SELECT " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in G_NUM) + f", {LABEL} FROM {G_SQL} g)"


def gaps(spark, sf_dir):
    return li(spark, sf_dir).selectExpr("*", *[f"{e} AS {c}" for c, e in GAPS.items()])


def gap_missing(spark, sf_dir):
    return rounded(profile.missing_counts(gaps(spark, sf_dir), list(GAPS)))


def gap_missing_total(spark, sf_dir):
    return profile.missing_total(gaps(spark, sf_dir), list(GAPS))


_gap_missing = [f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NULL"
                + (f" OR isnan({c})" if c in G_NUM else "") + f") AS BIGINT) AS n_missing, count(*) AS n FROM {G_SQL} g" for c in GAPS]
GAP_MISSING_SQL = (f"SELECT feature, n_missing, {r6(f'n_missing * {PCT} / n')} AS pct_missing FROM ({_union(_gap_missing)}) z")
GAP_MISSING_TOTAL_SQL = (f"SELECT CAST(sum(n_missing) AS BIGINT) AS n_missing, count(*) FILTER (WHERE n_missing > 0) AS n_columns "
                         f"FROM ({_union(_gap_missing)}) z")


def gap_placeholders(spark, sf_dir):
    return profile.placeholder_counts(gaps(spark, sf_dir), ["g_status", "l_linestatus"])


GAP_PLACEHOLDERS_SQL = _union([
    f"SELECT '{c}' AS feature, {c} AS placeholder, count(*) AS n FROM {G_SQL} g WHERE {c} IN ({_ph_list}) GROUP BY 1, 2"
    for c in ("g_status", "l_linestatus")])


def gap_infinities(spark, sf_dir):
    return profile.infinite_counts(gaps(spark, sf_dir), G_NUM).withColumn("n_inf", F.coalesce("n_inf", F.lit(0)))


GAP_INFINITIES_SQL = _union([f"SELECT '{c}' AS feature, count(*) FILTER (WHERE isinf({c})) AS n_inf FROM {G_SQL} g" for c in G_NUM])


def gap_describe(spark, sf_dir):
    out = profile.describe(gaps(spark, sf_dir), G_FINITE)
    return rounded(out.withColumns({c: stable_round(c) for c in ("mean", "std", "cv")}))


GAP_DESCRIBE_SQL = _union([
    f"SELECT '{c}' AS feature, count({c}) AS count, {r6(stable_round_sql(f'avg({c})'))} AS mean, "
    f"{r6(stable_round_sql(f'stddev_samp({c})'))} AS std, {r6(f'min({c})')} AS min, "
    f"{r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS q75, {r6(f'max({c})')} AS max, {r6(f'max({c}) - min({c})')} AS range, "
    f"{r6(stable_round_sql(f'CASE WHEN avg({c}) = 0 THEN NULL ELSE stddev_samp({c}) / avg({c}) END'))} AS cv "
    f"FROM {G_CLEAN} g" for c in G_FINITE])


def gap_outliers(spark, sf_dir):
    return rounded(profile.iqr_outliers(gaps(spark, sf_dir), G_NUM))


def _gap_iqr_sql(c):
    fences = f"{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"
    return (f"SELECT '{c}' AS feature, any_value(q1) AS q1, any_value(q3) AS q3, count(*) FILTER (WHERE {fences}) AS n_outliers, "
            f"count(*) AS n FROM {G_CLEAN} g, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {G_CLEAN} h) q")


GAP_OUTLIERS_SQL = (
    f"SELECT feature, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('q3 - q1')} AS iqr, {r6('q1 - 1.5 * (q3 - q1)')} AS lower, "
    f"{r6('q3 + 1.5 * (q3 - q1)')} AS upper, n_outliers, {r6(f'n_outliers * {PCT} / n')} AS pct_outliers FROM ("
    + _union([_gap_iqr_sql(c) for c in G_NUM]) + ") z")


def gap_boxes(spark, sf_dir):
    return rounded(profile.box_summary(gaps(spark, sf_dir), G_NUM))


def _gap_box_sql(c):
    return (f"SELECT '{c}' AS feature, {r6('any_value(q1)')} AS q1, {r6('any_value(q2)')} AS median, {r6('any_value(q3)')} AS q3, "
            f"{r6(f'min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1))')} AS whisker_low, "
            f"{r6(f'max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high "
            f"FROM {G_CLEAN} g, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, "
            f"quantile_cont({c}, 0.75) AS q3 FROM {G_CLEAN} h) q")


GAP_BOXES_SQL = _union([_gap_box_sql(c) for c in G_NUM])


def gap_high_corr(spark, sf_dir):
    """Pairs beyond |r| > 0.9, strongest first."""
    out = profile.high_correlations(gaps(spark, sf_dir), [*NUM, *G_FINITE], 0.9)
    return rounded(out.withColumns({"r": stable_round("r"), "abs_r": stable_round("abs_r")}))


def _gap_corr(a, b):
    return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM g"


_gap_cols = [*NUM, *G_FINITE]
GAP_HIGH_CORR_SQL = (
    f"WITH g AS (SELECT {', '.join(NUM)}, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in G_FINITE)
    + f" FROM {G_SQL} x),\np AS (" + _union([_gap_corr(a, b) for i, a in enumerate(_gap_cols) for b in _gap_cols[i + 1:]
                                            if not {a, b} & {"g_empty", "g_const"}]) + "),\n"
    f"r AS (SELECT feature_a, feature_b, {r6(stable_round_sql('r'))} AS r, {r6(stable_round_sql('abs(r)'))} AS abs_r FROM p "
    "WHERE abs(r) > 0.9)\n"
    "SELECT *, CAST(row_number() OVER (ORDER BY abs_r DESC, feature_a, feature_b) AS INTEGER) AS rank FROM r")


# ---------------------------------------------------------------- A1, A26 overview
def dtype_census(spark, sf_dir):
    return profile.dtype_census(table(spark, sf_dir, "lineitem"))


DTYPE_CENSUS_SQL = (
    "SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype, count(*) AS n_columns "
    "FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1")


def preview(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return profile.preview(li(spark, sf_dir).select(*order, *[c for c in LINEITEM_COLS if c not in order], LABEL), order)


PREVIEW_SQL = (f"SELECT {', '.join(LINEITEM_COLS)}, {LABEL} FROM {LI} x "
               "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5")


# ---------------------------------------------------------------- A22 importance (rows only)
def feature_importance(spark, sf_dir):
    return rounded(profile.feature_importance(li(spark, sf_dir), NUM, categorical=LINEITEM.categorical))


QUERIES = {
    "missing": missing, "placeholders": placeholders, "infinities": infinities, "zeros": zeros,
    "duplicates": duplicates, "class_dist": class_dist, "attack_types": attack_types,
    "categorical_summary": categorical_summary, "distinct_counts": distinct_counts,
    "describe": describe, "low_variance": low_variance, "high_corr": high_corr,
    "target_corr": target_corr, "iqr_outliers": iqr_outliers, "box_summary": box_summary,
    "histogram": histogram, "histogram_by_class": histogram_by_class,
    "feature_importance": feature_importance, "embedding_corr": embedding_corr,
    "document_duplicates": document_duplicates, "gap_missing": gap_missing, "gap_missing_total": gap_missing_total,
    "gap_placeholders": gap_placeholders, "gap_infinities": gap_infinities, "gap_describe": gap_describe,
    "gap_outliers": gap_outliers, "gap_boxes": gap_boxes, "gap_high_corr": gap_high_corr,
    "dtype_census": dtype_census, "preview": preview,
}
SQL = {
    "missing": MISSING_SQL, "placeholders": PLACEHOLDERS_SQL, "infinities": INFINITIES_SQL,
    "zeros": ZEROS_SQL, "duplicates": DUPLICATES_SQL, "class_dist": CLASS_DIST_SQL,
    "attack_types": ATTACK_TYPES_SQL, "categorical_summary": CATEGORICAL_SUMMARY_SQL,
    "distinct_counts": DISTINCT_COUNTS_SQL, "describe": DESCRIBE_SQL,
    "low_variance": LOW_VARIANCE_SQL, "high_corr": HIGH_CORR_SQL, "target_corr": TARGET_CORR_SQL,
    "iqr_outliers": IQR_OUTLIERS_SQL, "box_summary": BOX_SUMMARY_SQL, "histogram": HISTOGRAM_SQL,
    "histogram_by_class": HISTOGRAM_BY_CLASS_SQL, "embedding_corr": EMBEDDING_CORR_SQL,
    "document_duplicates": DOCUMENT_DUPLICATES_SQL, "gap_missing": GAP_MISSING_SQL, "gap_missing_total": GAP_MISSING_TOTAL_SQL,
    "gap_placeholders": GAP_PLACEHOLDERS_SQL, "gap_infinities": GAP_INFINITIES_SQL, "gap_describe": GAP_DESCRIBE_SQL,
    "gap_outliers": GAP_OUTLIERS_SQL, "gap_boxes": GAP_BOXES_SQL, "gap_high_corr": GAP_HIGH_CORR_SQL,
    "dtype_census": DTYPE_CENSUS_SQL, "preview": PREVIEW_SQL,
}
