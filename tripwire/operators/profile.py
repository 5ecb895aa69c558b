"""Data profiling.

Each profile is one wide aggregation over the whole table (every column's
statistic computed in the same scan, partial aggregation before the
shuffle) followed by an unpivot into a long ``(feature, stat...)`` table.
Quantile-based profiles use the bounded exact-percentile helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..sources.catalog import LABEL, PLACEHOLDERS


def _unpivot(wide: DataFrame, cols: Sequence[str], prefixes: Sequence[str],
             names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Turn ``<prefix><col>`` columns of a one-row frame into rows per col,
    repeating the ``carry`` columns (e.g. the row count) on every row."""
    args = ", ".join(
        f"'{c}', " + ", ".join(f"`{p}{c}`" for p in prefixes) for c in cols)
    return wide.selectExpr(*carry, f"stack({len(cols)}, {args}) AS (feature, {', '.join(names)})")


#: pairs of columns up to which correlations are built-in aggregates
BUILT_IN_PAIRS = 300


def _is_true(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: nulls (and NaN for floating columns) per column, with percentage."""
    cols = list(cols or df.columns)
    n = F.count(F.lit(1)).alias("_n")
    real = {c for c, kind in df.dtypes if kind in ("float", "double")}
    aggs = [n] + [_is_true(F.col(c).isNull() | (F.isnan(c) if c in real else F.lit(False))).alias(f"m_{c}")
                  for c in cols]
    wide = df.agg(*aggs)
    long = _unpivot(wide, cols, ["m_"], ["n_missing"], carry=["_n"])
    return long.select(
        "feature", "n_missing",
        F.when(F.col("_n") == 0, 0.0).otherwise(F.col("n_missing") * 100.0 / F.col("_n"))
        .alias("pct_missing"))


def placeholder_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: occurrences of placeholder strings per string column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                         F.col(c).cast("string").alias("value")) for c in cols]))
    long = df.select(pairs.alias("p")).select("p.feature", "p.value")
    return (long.filter(F.col("value").isin(PLACEHOLDERS))
            .groupBy("feature", F.col("value").alias("placeholder"))
            .agg(F.count(F.lit(1)).alias("n")))


def infinite_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: +/- infinity per numeric column."""
    inf = F.lit(float("inf"))
    wide = df.agg(*[_is_true(F.abs(F.col(c).cast("double")) == inf).alias(f"i_{c}") for c in cols])
    return _unpivot(wide, cols, ["i_"], ["n_inf"])


def zero_counts(df: DataFrame, cols: Sequence[str], top: int = 10) -> DataFrame:
    """A5: zeros per column and share, top ``top`` by count."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[_is_true(F.col(c) == 0).alias(f"z_{c}") for c in cols])
    long = _unpivot(wide, cols, ["z_"], ["n_zero"], carry=["_n"])
    long = long.select("feature", "n_zero", F.when(F.col("_n") == 0, 0.0).otherwise(
        F.col("n_zero") * 100.0 / F.col("_n")).alias("pct_zero"))
    return long.orderBy(F.col("n_zero").desc(), F.col("feature")).limit(top)


def _fingerprint(df: DataFrame, cols: Sequence[str], name: str) -> list[F.Column]:
    """128 bits that stand for the values of ``cols``: nulls, zeros and NaN as group keys see them."""
    kinds = dict(df.dtypes)
    values = [F.when(F.col(c) == 0, F.lit(0.0)).when(F.isnan(c), F.lit(float("nan"))).otherwise(F.col(c))
              if kinds[c] in ("float", "double") else F.col(c) for c in cols]
    gaps = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(*values, *gaps).alias(f"{name}0"), F.xxhash64(F.lit(name), *gaps, *values).alias(f"{name}1")]


def duplicate_summary(df: DataFrame, features: Sequence[str], label: str = LABEL,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicate rows over ``columns`` (features and label if not given),
    duplicates on features only, and feature groups carrying more than one label.

    Rows are grouped by 128-bit hashes, so a wide row is shuffled as a few numbers;
    group-bys pre-aggregate on the map side, so a hot group of copies collapses
    before the shuffle."""
    feats = list(features)
    hashed = df.select(*_fingerprint(df, feats, "f"), *_fingerprint(df, [label], "l"),
                       *_fingerprint(df, list(columns or [*feats, label]), "r"))
    rows = hashed.groupBy(*hashed.columns).agg(F.count(F.lit(1)).alias("c"))
    full = rows.groupBy("f0", "f1", "l0", "l1").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    by_feat = full.groupBy("f0", "f1").agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("g"))
    out = by_feat.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_rows"),
                      F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n_distinct_rows"),
                      F.count(F.lit(1)).cast("long").alias("n_distinct_features"),
                      F.coalesce(_is_true(F.col("g") > 1), F.lit(0)).alias("n_conflicting_groups"))
    pct = lambda c: F.when(F.col("n_rows") == 0, 0.0).otherwise(c * 100.0 / F.col("n_rows"))
    return out.select(
        "n_rows",
        (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicate_rows"),
        pct(F.col("n_rows") - F.col("n_distinct_rows")).alias("pct_duplicate_rows"),
        (F.col("n_rows") - F.col("n_distinct_features")).alias("n_duplicate_features"),
        pct(F.col("n_rows") - F.col("n_distinct_features")).alias("pct_duplicate_features"),
        "n_conflicting_groups")


def class_distribution(df: DataFrame, label: str = LABEL, classes=(0, 1)) -> DataFrame:
    """Count and share per class and max/min ratio; a listed class that is
    absent has 0, null and unlisted classes are kept."""
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    kind = counts.schema[label].dataType
    known = spark.createDataFrame([(c,) for c in classes], f"{label} int") \
        .select(F.col(label).cast(kind).alias(label), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(known).groupBy(label).agg(F.sum("n").alias("n"))
    w = Window.partitionBy()   # the frame holds one row per class
    full = full.withColumns({"_t": F.sum("n").over(w), "_mx": F.max("n").over(w),
                             "_mn": F.min("n").over(w)})
    return full.select(
        label, F.col("n").cast("long").alias("n"),
        F.when(F.col("_t") == 0, 0.0).otherwise(F.col("n") / F.col("_t")).alias("share"),
        F.when(F.col("_mn") > 0, F.col("_mx") / F.col("_mn")).alias("imbalance_ratio"))


def top_values(df: DataFrame, col: str, top: int) -> DataFrame:
    """The ``top`` most frequent values of one column (ties by value)."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("value")).limit(top))


def categorical_summary(df: DataFrame, cols: Sequence[str], top: int = 5) -> DataFrame:
    """Distinct count and the ``top`` values per string column.

    ``row_number() <= top`` is planned as a window group limit, so each map
    task keeps only its local top values before the exchange."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                         F.col(c).cast("string").alias("value")) for c in cols]))
    counts = (df.select(pairs.alias("p")).select("p.feature", "p.value")
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    distinct = counts.filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"))
    return ranked.join(F.broadcast(distinct), on="feature", how="left")


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None,
                    approx_rsd: float | None = None) -> DataFrame:
    """Distinct values per column (nulls excluded); exact by default,
    HyperLogLog++ with relative error ``approx_rsd`` when given."""
    cols = list(cols or df.columns)
    agg = ((lambda c: F.approx_count_distinct(c, approx_rsd)) if approx_rsd
           else (lambda c: F.countDistinct(c)))
    wide = df.agg(*[agg(c).alias(f"d_{c}") for c in cols])
    return _unpivot(wide, cols, ["d_"], ["n_distinct"])


def _quartile_rows(df: DataFrame, cols: Sequence[str]) -> tuple[dict, DataFrame]:
    """Quartiles per column, and as a small table; null where a column has no value."""
    qs = exact_percentiles(df, cols, [0.25, 0.5, 0.75])
    got = {c: tuple(qs.get(("", c, q)) for q in (0.25, 0.5, 0.75)) for c in cols}
    return got, df.sparkSession.createDataFrame([(c, *got[c]) for c in cols], "feature string, q25 double, q50 double, q75 double")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles, max, range and CV; null and NaN are no
    values, and a column without a value has count 0 and nulls."""
    wide = df.agg(*[x for c in cols for v in [_value(c)] for x in (
        F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"mean_{c}"), F.stddev_samp(v).alias(f"std_{c}"),
        F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"))])
    long = _unpivot(wide, cols, ["n_", "mean_", "std_", "min_", "max_"],
                    ["count", "mean", "std", "min", "max"])
    out = long.join(F.broadcast(_quartile_rows(df, cols)[1]), on="feature")
    return out.select(
        "feature", F.col("count").cast("long").alias("count"), "mean", "std", "min", "q25", "q50",
        "q75", "max", (F.col("max") - F.col("min")).alias("range"),
        F.when(F.col("mean") == 0, F.lit(None)).otherwise(F.col("std") / F.col("mean")).alias("cv"))


def _value(c: str) -> F.Column:
    """A column as double, NaN as null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def low_variance(df: DataFrame, cols: Sequence[str], var_threshold: float = 0.01,
                 max_unique: int = 2) -> DataFrame:
    """``nunique <= 2 or var < 0.01`` flags a near-constant feature."""
    wide = df.agg(*[x for c in cols for x in (
        F.countDistinct(c).alias(f"u_{c}"), F.var_samp(c).alias(f"v_{c}"))])
    long = _unpivot(wide, cols, ["u_", "v_"], ["n_unique", "variance"])
    return long.withColumn("low_variance", (F.col("n_unique") <= max_unique) | (
        F.coalesce(F.col("variance"), F.lit(0.0)) < var_threshold))


def _pearson(a: str, b: str):
    """r over the rows where both values are there (NaN is missing); null if one
    of the two is constant."""
    x, y = _value(a), _value(b)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def _pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For every pair of columns (i, j), over the rows where both values are
    there: n, sums of x, y, x*x, y*y and x*y, taken around the column means.
    One pass; each task sends one cell per pair."""
    import numpy as np
    import pandas as pd

    num = [_value(c).alias(f"x{i}") for i, c in enumerate(cols)]
    flat = df.select(*num)
    mean = np.array([0.0 if m is None else m for m in flat.agg(*[F.avg(c) for c in flat.columns]).first()])
    i, j = np.triu_indices(len(cols), 1)

    def sums(batches):
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64)
            there = (~np.isnan(x)).astype(np.float64)
            x = np.where(there > 0, x - mean, 0.0)
            first, second, cross = x.T @ there, (x * x).T @ there, x.T @ x
            got = np.stack([(there.T @ there)[i, j], first[i, j], first[j, i], second[i, j], second[j, i], cross[i, j]])
            total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": i, "j": j, **dict(zip(("n", "sx", "sy", "xx", "yy", "xy"), total))})

    cells = flat.mapInPandas(sums, "i int, j int, n double, sx double, sy double, xx double, yy double, xy double")
    return cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])


def correlation_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Pearson r for every pair (upper triangle), flagged when
    |r| > threshold.  Null and NaN are left out pair by pair; a column that is
    constant over the pair's rows has a null r and is never flagged.  Up to
    ``BUILT_IN_PAIRS`` pairs are one built-in aggregation, more (wide tables) one pass
    of matrix products; the results are the same."""
    cols = list(cols)
    schema = "feature_a string, feature_b string, r double, abs_r double, high boolean"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    flagged = {"abs_r": F.abs("r"), "high": F.coalesce(F.abs("r") > threshold, F.lit(False))}
    if len(pairs) <= BUILT_IN_PAIRS:
        wide = df.agg(*[_pearson(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
        args = ", ".join(f"'{a}', '{b}', r{k}" for k, (a, b) in enumerate(pairs))
        long = wide.selectExpr(f"stack({len(pairs)}, {args}) AS (feature_a, feature_b, r)")
        inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))     # greatest and least skip nulls
        return long.withColumn("r", F.when(F.col("r").isNotNull(), inside)).withColumns(flagged)
    near = 1e-12                             # what is left of a constant's spread by rounding
    vx, vy = (F.col(q) - F.col(t) * F.col(t) / F.col("n") for q, t in (("xx", "sx"), ("yy", "sy")))
    vx, vy = (F.when(v > near * F.col(q), v) for v, q in ((vx, "xx"), (vy, "yy")))
    r = (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)
    names = F.array(*[F.lit(c) for c in cols])
    long = _pair_sums(df, cols).select(names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
                                       F.when((F.col("n") > 1) & vx.isNotNull() & vy.isNotNull(),
                                              F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    return long.withColumns(flagged)


def high_correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """The pairs beyond the threshold, strongest first, with their rank."""
    pairs = correlation_pairs(df, cols, threshold).where("high").select("feature_a", "feature_b", "r", "abs_r")
    # one row per pair of columns; equal to six decimals is a tie
    w = Window.orderBy(F.round("abs_r", 6).desc(), "feature_a", "feature_b")
    return pairs.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def target_correlation(df: DataFrame, cols: Sequence[str], label: str = LABEL) -> DataFrame:
    """r(feature, label) with the sign kept, strongest first; null for a constant feature."""
    wide = df.agg(*[_pearson(c, label).alias(f"t_{c}") for c in cols])
    return _unpivot(wide, cols, ["t_"], ["r"]).withColumn("abs_r", F.abs("r")) \
        .orderBy(F.col("abs_r").desc_nulls_last(), "feature")


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values outside [Q1 - k*IQR, Q3 + k*IQR], most outliers first; one quantile
    job, one count job.  A feature without a value has null bounds and no outlier."""
    quartiles, _ = _quartile_rows(df, cols)
    rows, aggs = [], []
    for c in cols:
        q1, _q2, q3 = quartiles[c]
        lo, hi = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        rows.append((c, q1, q3, lo, hi))
        out = F.lit(False) if q1 is None else (_value(c) < F.lit(lo)) | (_value(c) > F.lit(hi))
        aggs.append(F.coalesce(_is_true(out), F.lit(0)).alias(f"o_{c}"))
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    long = _unpivot(wide, cols, ["o_"], ["n_outliers"], carry=["_n"])
    brows = df.sparkSession.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double")
    return long.join(F.broadcast(brows), on="feature").select(
        "feature", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "lower", "upper",
        "n_outliers", F.when(F.col("_n") == 0, 0.0).otherwise(
            F.col("n_outliers") * 100.0 / F.col("_n")).alias("pct_outliers")) \
        .orderBy(F.col("n_outliers").desc(), "feature")


def box_summary(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles and whiskers (furthest values inside the fences); nulls for a
    feature without a value."""
    quartiles, _ = _quartile_rows(df, cols)
    rows, aggs = [], []
    for c in cols:
        q1, q2, q3 = quartiles[c]
        rows.append((c, q1, q2, q3))
        lo, hi = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        v, null = _value(c), F.lit(None).cast("double")
        aggs += [(F.min(F.when(v >= F.lit(lo), v)) if q1 is not None else F.first(null)).alias(f"wl_{c}"),
                 (F.max(F.when(v <= F.lit(hi), v)) if q1 is not None else F.first(null)).alias(f"wh_{c}")]
    wide = df.agg(*aggs)
    long = _unpivot(wide, cols, ["wl_", "wh_"], ["whisker_low", "whisker_high"])
    qdf = df.sparkSession.createDataFrame(rows, "feature string, q1 double, median double, q3 double")
    return long.join(F.broadcast(qdf), on="feature")


def _bin_expr(v, lo, hi, bins: int):
    width = hi - lo
    return F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / width * F.lit(bins)).cast("int"), F.lit(bins - 1)))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50,
              by: str | None = None) -> DataFrame:
    """Equal-width bins between each feature's smallest and largest
    finite value (per class when ``by`` is given); the top bin is closed on the
    right and empty bins are kept.  Null, NaN and infinite values are in no bin."""
    keys = [by] if by else []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                         F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*keys, pairs.alias("p")).select(*keys, "p.feature", "p.v").filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    rng = long.groupBy("feature", *keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # one row per (feature, class): bounded by the number of features × classes
    joined = long.join(F.broadcast(rng), on=["feature", *keys])
    b = _bin_expr(F.col("v"), F.col("lo"), F.col("hi"), bins)
    full = joined.groupBy("feature", *keys, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    held = full.groupBy("feature", *keys, "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))   # <= bins entries
    out = held.select("feature", *keys, "lo", "hi", "held",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    n = F.coalesce(F.element_at("held", F.col("bin")), F.lit(0).cast("long"))
    return out.select("feature", *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), n.alias("n"))


#: rows × trees up to which a forest is fitted at once, and the trees of a fit beyond that
FOREST_DRAWS = 200_000_000
FOREST_TREES = 10
#: beyond that, groups per row up to which trees are fitted on weighted groups, and the fits at once
FOREST_GROUPS = 0.25
FOREST_FITS = 3
#: bins of a number, as the forest's own
FOREST_BINS = 32


def _bin_edges(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """The split points of every column, from all rows: between all values of a column of at most
    ``FOREST_BINS``, else its quantiles (rank error 1 in 2,000; the forest takes them from 10,000 rows)."""
    aggs = [F.count(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1)).alias(f"bad{i}") for i, c in enumerate(cols)]
    aggs += [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]
    aggs += [F.percentile_approx(c, [k / FOREST_BINS for k in range(1, FOREST_BINS)], 2_000).alias(f"q{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    if any(row[f"bad{i}"] for i in range(len(cols))):
        raise ValueError("null, NaN or infinite features: impute or drop such rows before a forest")
    few = [c for i, c in enumerate(cols) if row[f"d{i}"] <= 2 * FOREST_BINS]
    values = df.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    out = {}
    for i, c in enumerate(cols):
        v = sorted(values[c]) if c in few else []
        out[c] = [(x + y) / 2 for x, y in zip(v, v[1:])] if 0 < len(v) <= FOREST_BINS else sorted(set(row[f"q{i}"]))
    return out


def _grouped(df: DataFrame, numbers: Sequence[str], cats: Sequence[str], label: str) -> DataFrame:
    """The rows by bin of every number, category and label, with their number ``_n``.  A tree sees
    no more of a row than that, so a group is as good as its rows."""
    from pyspark.ml.feature import Bucketizer

    from ..session import materialize

    edges = _bin_edges(df, numbers)
    split = [c for c in numbers if edges[c]]
    binned = df
    if split:
        inf = float("inf")
        binned = Bucketizer(inputCols=split, outputCols=[f"_b_{c}" for c in split],
                            splitsArray=[[-inf, *edges[c], inf] for c in split]).transform(df)
    keys = [(F.col(f"_b_{c}") if c in split else F.lit(0)).cast("int").alias(c) for c in numbers]
    return materialize(binned.groupBy(*keys, *cats, label).agg(F.count(F.lit(1)).alias("_n")), "forest-groups")


def _drawn(groups: DataFrame, trees: int, seed: int) -> DataFrame:
    """The groups with a column ``_w<t>`` per tree: how often their rows are in its bootstrap sample.
    A row is drawn Poisson(1) times, so a group of n is drawn Poisson(n) times."""
    import zlib

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..session import materialize

    names = [f"_w{t}" for t in range(trees)]
    at = groups.columns.index("_n")

    def draw(batches):
        for b in batches:
            rng = np.random.default_rng([seed, *(zlib.crc32(np.ascontiguousarray(c.to_numpy(zero_copy_only=False))) for c in b.columns)])
            n = b.column(at).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(rng.poisson(n), pa.int64()) for _ in names)],
                                             names=[*b.schema.names, *names])

    schema = T.StructType([*groups.schema, *(T.StructField(w, T.LongType()) for w in names)])
    return materialize(groups.mapInArrow(draw, schema), "forest-draws")


def feature_importance(df: DataFrame, features: Sequence[str], label: str = LABEL, trees: int = 100, depth: int = 10,
                       seed: int = 42, categorical: Sequence[str] = (), max_categories: int = 200) -> DataFrame:
    """Random-forest impurity importances, ranked.  ``categorical`` columns are
    numbered by ``fit_ordinal`` and declared to the forest, which then splits sets of
    categories; a column of more than ``max_categories`` is split by its codes' order.

    A fit keeps every row with one drawn count per tree.  Over many rows the forest is
    therefore fitted ``FOREST_TREES`` trees at a time, each fit on all rows with a seed of
    its own; node ids (one per row and tree) are looked up and not kept.

    A tree sees a row's bins and label only.  Where many rows share them (at most
    ``FOREST_GROUPS`` groups a row), each tree is fitted on the groups, weighted by how often
    their rows are drawn: the forest of all rows, at the cost of the groups."""
    from concurrent.futures import ThreadPoolExecutor

    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from .prep import fit_ordinal

    feats, named = list(features), [c for c in categorical]
    encoding = fit_ordinal(df, named)
    coded = encoding.transform(df.select(*feats, *named, label))
    few = {c: 1 < encoding.sizes[c] <= max_categories for c in named}

    def vectors(rows: DataFrame, *carry: str) -> DataFrame:
        cols = []
        for c in feats:
            cols.append(F.col(c).cast("double").alias(c))
        for c in named:
            kind = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(encoding.sizes[c])]}} if few[c] else {}
            cols.append(F.col(c).cast("double").alias(c, metadata=kind))
        return VectorAssembler(inputCols=[*feats, *named], outputCol="_x", handleInvalid="keep").transform(
            rows.select(*cols, F.col(label).cast("double").alias(label), *carry))

    bins = max([FOREST_BINS, *(encoding.sizes[c] for c in named if encoding.sizes[c] <= max_categories)])
    n = df.count()
    per_fit = trees if n * trees <= FOREST_DRAWS else min(trees, FOREST_TREES)
    imp = np.zeros(len(feats) + len(named))
    groups = None
    if per_fit < trees:
        codes = [c for c in named if few[c]]
        numbers = [*feats, *(c for c in named if not few[c])]
        groups = _grouped(coded.select(*[F.col(c).cast("double").alias(c) for c in numbers], *codes, label), numbers, codes, label)
        n_groups = groups.count()
        if n_groups > FOREST_GROUPS * n or groups.select(label).distinct().count() > 2:
            groups = None
    if groups is not None:
        drawn = _drawn(groups, trees, seed)
        # the forest looks for split points in so many rows that it sees all bins
        most = max(bins, min(46_000, int(n_groups ** 0.5) + 1))

        def one(t: int):
            rows = drawn.withColumn("_n", F.col(f"_w{t}").cast("double")).where("_n > 0")
            return RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="_n", numTrees=1, bootstrap=False,
                                          featureSubsetStrategy="sqrt", maxBins=most, maxDepth=depth, seed=seed + t,
                                          maxMemoryInMB=1024).fit(vectors(rows, "_n"))

        with ThreadPoolExecutor(max_workers=FOREST_FITS) as pool:
            for model in pool.map(one, range(trees)):
                imp += model.trees[0].featureImportances.toArray()
    else:
        vec = vectors(coded)
        for i, first in enumerate(range(0, trees, per_fit)):
            # more nodes per pass over the data
            model = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=min(per_fit, trees - first), maxBins=bins,
                                           maxDepth=depth, seed=seed + i, maxMemoryInMB=1024).fit(vec)
            if per_fit >= trees:
                imp = model.featureImportances.toArray()
            else:                                            # summed over all trees, as in one forest
                imp += sum(tree.featureImportances.toArray() for tree in model.trees)
    imp = (imp / imp.sum() if per_fit < trees and imp.sum() else imp).tolist()
    rows = sorted(zip([*feats, *named], imp), key=lambda t: (-t[1], t[0]))
    return df.sparkSession.createDataFrame(
        [(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
        "feature string, importance double, rank int")


def dtype_census(df: DataFrame) -> DataFrame:
    """A1: number of columns per type, most first."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    rows = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "dtype string, n_columns long")


def missing_total(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: missing cells of the table, and the columns that have any."""
    return missing_counts(df, cols).agg(F.sum("n_missing").alias("n_missing"),
                                        F.count(F.when(F.col("n_missing") > 0, 1)).alias("n_columns"))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)
