"""Data preparation: label rules, drops, exact sampling, stratified split,
batch slicing, ordinal encoding and robust scaling (P1-P5, F1-F6, F10, E1-E6).

The scaler's state is tiny (three percentiles per column) and its transform a
plain projection; the encoder's state is a table that is joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_percentiles
from ..functions.rowkey import ordered_index, row_key
from ..functions.selection import below_cutoff, kth_keys
from ..sources.catalog import LABEL

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


# --- projections and predicates ------------------------------------------------

def drop_if_exists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop listed columns, ignoring absent ones."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_null_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """rows without a label are removed (after sampling, as the reference)."""
    return df.na.drop(subset=[label])


def benign(df: DataFrame, label: str = LABEL) -> DataFrame:
    """benign rows only."""
    return df.filter(F.col(label) == 0)


def binarize_label(df: DataFrame, col: str = "label", normal: str = "normal",
                   out: str = LABEL) -> DataFrame:
    """strip trailing dots; anything but ``normal`` (null included) is 1."""
    cleaned = F.expr(f"TRIM(TRAILING '.' FROM `{col}`)")
    return df.withColumn(out, F.when(cleaned.eqNullSafe(F.lit(normal)), 0).otherwise(1)
                         .cast("int"))


def string_columns(df: DataFrame) -> list[str]:
    """string-typed columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """numeric columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def feature_families(df: DataFrame, label: str = LABEL,
                     binary: Sequence[str] = ()) -> dict[str, list[str]]:
    """categorical / binary / numeric (= the rest)."""
    cats = [c for c in string_columns(df) if c != label]
    bins = [c for c in binary if c in df.columns]
    nums = [c for c in numeric_columns(df, exclude=[label]) if c not in bins]
    return {"categorical": cats, "binary": bins, "numeric": nums}


# --- deterministic sampling -------------------------------------------------------

def with_row_key(df: DataFrame, key_exprs: Sequence[str], seed: int = 42,
                 name: str = "row_key") -> DataFrame:
    return df.withColumn(name, row_key(key_exprs, seed))


def exact_sample(df: DataFrame, frac: float, key: str = "row_key") -> DataFrame:
    """Exactly ``round(frac * n)`` rows: the first ones in md5 order.

    The cut-off key is selected without sorting; the sample is a narrow
    filter.  Its order (the reference's shuffled order) is md5 order: call
    :func:`ordered_index` on the sample when dense positions are needed.
    """
    n = df.count()
    k = round(frac * n)             # same rounding as the reference library
    cut = kth_keys(df, key, {0: k}, sizes={0: n})
    return df.filter(below_cutoff(key, cut))


def capped_sample(df: DataFrame, cap: int, key: str = "row_key") -> DataFrame:
    """At most ``cap`` rows, first in md5 order (a cut-off on the key, no sort)."""
    return df.filter(below_cutoff(key, kth_keys(df, key, {0: cap})))


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def per_class_cap(df: DataFrame, cap: int, label: str = LABEL,
                  key: str = "row_key") -> DataFrame:
    """At most ``cap`` rows per class, first in md5 order (no sort)."""
    counts = class_counts(df, label)
    cut = kth_keys(df, key, {c: cap for c in counts}, group=label, sizes=counts)
    return df.filter(below_cutoff(key, cut, label))


def _largest_remainder(counts: dict, n_draws: int) -> dict:
    """Per-class quota: floor of the proportional share plus the leftover
    draws to the largest fractional parts (ties to the smaller label)."""
    total = sum(counts.values())
    cont = {c: counts[c] * n_draws / total for c in counts}
    quota = {c: math.floor(v) for c, v in cont.items()}
    left = n_draws - sum(quota.values())
    for c in sorted(cont, key=lambda c: (-(cont[c] - quota[c]), c))[:left]:
        quota[c] += 1
    return quota


def stratified_split(df: DataFrame, test_size: float = 0.2, label: str = LABEL,
                     key: str = "row_key") -> DataFrame:
    return stratified_split_quota(df, test_size, label, key)[0]


def stratified_split_quota(df: DataFrame, test_size: float = 0.2, label: str = LABEL,
                           key: str = "row_key") -> tuple[DataFrame, dict]:
    """Add ``split`` in {'train','test'}; per-class shares follow the
    class mix, total test rows = ceil(test_size * n).

    Inside each class the first ``quota`` rows in md5 order go to train.
    The per-class cut-off key is selected by prefix counting, so the split
    itself is a narrow projection (no shuffle of the table).
    """
    counts = class_counts(df, label)
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train_quota = _largest_remainder(counts, n - n_test)
    cut = kth_keys(df, key, train_quota, group=label, sizes=counts)
    out = df.withColumn("split", F.when(below_cutoff(key, cut, label), "train").otherwise("test"))
    return out, train_quota


def replay_order(df: DataFrame, key: str = "row_key", name: str = "ord") -> DataFrame:
    """Dense md5 order of the rows given (the test split): the arrival order
    of the stream.  Only the streamed split is sorted."""
    return ordered_index(df, [key], name=name)


def assign_batches(df: DataFrame, batch_size: int, order_col: str = "ord",
                   name: str = "batch_id") -> DataFrame:
    """rows [i*b, (i+1)*b) of the arrival order form batch i."""
    return df.withColumn(name, F.floor(F.col(order_col) / F.lit(batch_size)).cast("int"))


# --- encoding -------------------------------------------------------------------------

#: categories up to which a column's dictionary is broadcast (its size is known)
BROADCAST_CODES = 100_000
#: a value is hot when it holds more than this share of the fitting rows
HOT_SHARE = 1 / 1000
_CODE_BLOCK = 10_000


@dataclass
class OrdinalEncoding:
    """Sorted distinct values → 0..k-1 per column, fitted on one table.

    The dictionary is a table ``(c, v, n, code)`` in the shared folder; ``n`` tells how
    often the value occurred in the fitting rows.  Only the number of categories and
    of rows of every column is held here."""

    columns: list[str]
    dictionary: DataFrame | None
    sizes: dict[str, int]
    rows: dict[str, int]
    unseen: str = "zero"          # 'zero' (E2), 'error' (E3) or 'keep'

    def categories(self, c: str) -> DataFrame:
        """(v, code) of one column, in code order when sorted by ``code``."""
        return self.dictionary.where(F.col("c") == c).select("v", "code")

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            out = self._join(out, c)
        return out.select(*df.columns) if self.columns else out

    def _join(self, df: DataFrame, c: str) -> DataFrame:
        """The column replaced by its code.  A small dictionary is broadcast.  Of a large
        one only the hot values are (at most 1 / HOT_SHARE), which also keeps their rows
        out of the shuffled join: they get a key of their own that matches nothing."""
        own = self.dictionary.where(F.col("c") == c)
        keyed = df.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        if self.sizes[c] <= BROADCAST_CODES:
            coded = keyed.join(F.broadcast(own.select(F.col("v").alias("_v"), F.col("code").alias("_code"))), "_v", "left")
        else:
            hot = F.col("n") > self.rows[c] * HOT_SHARE
            some = own.where(hot).select(F.col("v").alias("_v"), F.col("code").alias("_hot"))
            rest = own.where(~hot).select(F.concat(F.lit("v"), "v").alias("_k"), F.col("code").alias("_cold"))
            spread = F.concat(F.lit("h"), F.monotonically_increasing_id().cast("string"))
            coded = keyed.join(F.broadcast(some), "_v", "left") \
                .withColumn("_k", F.when(F.col("_hot").isNull(), F.concat(F.lit("v"), "_v")).otherwise(spread)) \
                .join(rest, "_k", "left").withColumn("_code", F.coalesce("_hot", "_cold")).drop("_k", "_hot", "_cold")
        if self.unseen == "zero":
            code = F.coalesce("_code", F.lit(0))
        elif self.unseen == "keep":
            code = F.coalesce("_code", F.lit(self.sizes[c]))
        else:
            code = F.coalesce("_code", F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), "_v")).cast("int"))
        return coded.withColumn(c, code.cast("int")).drop("_v", "_code")

    def code_percentiles(self, columns: Sequence[str], qs: Sequence[float]) -> dict:
        """``{(column, q): value}``: exact linear-interpolation percentiles of the codes over
        the fitting rows, from the dictionary: first the sums of blocks of codes, then the
        blocks that hold a wanted rank."""
        blocks: dict[str, list] = {c: [] for c in columns}
        block = F.floor(F.col("code") / _CODE_BLOCK)
        for r in self.dictionary.groupBy("c", block.alias("b")).agg(F.sum("n").alias("n")).collect():
            if r.c in blocks:
                blocks[r.c].append((r.b, r.n))
        wanted: dict[tuple, list] = {}
        for c in columns:
            for q in qs:
                k = math.floor(q * (self.rows[c] - 1))
                for rank in {k, min(k + 1, self.rows[c] - 1)}:
                    below = 0
                    for b, n in sorted(blocks[c]):
                        if rank < below + n:
                            wanted.setdefault((c, b), []).append((rank, below))
                            break
                        below += n
        if not wanted:
            return {}
        held: dict[tuple, list] = {}
        keys = [F.struct(F.lit(c).alias("c"), F.lit(int(b)).cast("long").alias("b")) for c, b in wanted]
        for r in self.dictionary.where(F.struct("c", block.cast("long").alias("b")).isin(*keys)).select("c", block.alias("b"), "code", "n").collect():
            held.setdefault((r.c, r.b), []).append((r.code, r.n))
        at: dict[tuple, float] = {}
        for key, ranks in wanted.items():
            for rank, below in ranks:
                for code, n in sorted(held[key]):
                    below += n
                    if rank < below:
                        at[key[0], rank] = float(code)
                        break
        out = {}
        for c in columns:
            for q in qs:
                pos = q * (self.rows[c] - 1)
                k = math.floor(pos)
                lo, hi = at[c, k], at[c, min(k + 1, self.rows[c] - 1)]
                out[c, q] = lo if pos == k or lo == hi else lo + (hi - lo) * (pos - k)
        return out


def fit_ordinal(df: DataFrame, columns: Sequence[str], unseen: str = "zero") -> OrdinalEncoding:
    """The values of every column are counted (map-side first, so hot values collapse)
    and numbered in order by a range sort — the same sorted-distinct encoding as
    ``StringIndexer(stringOrderType='alphabetAsc')``; nulls become the category 'nan'."""
    cols = list(columns)
    if not cols:
        return OrdinalEncoding([], None, {}, {}, unseen)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(
        F.col(c).cast("string"), F.lit("nan")).alias("v")) for c in cols]))
    counts = df.select(pairs.alias("p")).groupBy(F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dictionary = ordered_index(counts, ["v"], group_cols=["c"], name="code").withColumn("code", F.col("code").cast("int"))
    totals = {r.c: (r.k, r.n) for r in dictionary.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
    return OrdinalEncoding(cols, dictionary, {c: totals.get(c, (0, 0))[0] for c in cols},
                           {c: totals.get(c, (0, 0))[1] for c in cols}, unseen)


def encode_independent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Profiling-only encoding fitted on the table itself."""
    return fit_ordinal(df, columns).transform(df)


# --- robust scaling ------------------------------------------------------------------------

@dataclass
class RobustScaling:
    """(x - median) / IQR; IQR 0 leaves x - median (divide by 1)."""

    medians: dict[str, float]
    scales: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {c: ((F.col(c).cast("double") - F.lit(self.medians[c])) / F.lit(self.scales[c]))
                 for c in self.medians}
        return df.withColumns(exprs)

    def as_rows(self) -> list[tuple]:
        return [(c, self.medians[c], self.scales[c]) for c in self.medians]


def fit_robust(df: DataFrame, columns: Sequence[str],
               encoding: OrdinalEncoding | None = None) -> RobustScaling:
    """One exact-percentile job for every column at once (q25, q50, q75).

    Columns encoded by ``encoding`` (fitted on the same rows) take their
    quartiles from the category counts instead of another scan."""
    coded = set(encoding.columns) & set(columns) if encoding is not None else set()
    plain = [c for c in columns if c not in coded]
    qs = exact_percentiles(df, plain, [0.25, 0.5, 0.75]) if plain else {}
    if coded:
        for (c, q), v in encoding.code_percentiles(sorted(c for c in coded if encoding.rows[c]), [0.25, 0.5, 0.75]).items():
            qs["", c, q] = v
    med, scale = {}, {}
    for c in columns:
        q1, q2, q3 = (qs.get(("", c, q)) for q in (0.25, 0.5, 0.75))
        med[c] = 0.0 if q2 is None else float(q2)
        iqr = 0.0 if q1 is None else float(q3 - q1)
        scale[c] = 1.0 if iqr == 0.0 else iqr
    return RobustScaling(med, scale)
