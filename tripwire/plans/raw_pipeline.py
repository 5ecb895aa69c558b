"""Preparation from the raw flow files.

NetFlow and KDD ship separate train and test files: each file is sampled
exactly (80 %, md5 order), labelled and cleaned on its own.  CORES ships one
file that is split 80/20 stratified by label.  Columns on the format's drop
list are removed when present; string columns are the categorical features
(KDD names them).  The result has the same layout as the driver-table
preparation, so stage 1 and the cascades run on it unchanged.

Raw rows have no natural key.  Exact copies are counted (map-side first) and
numbered, and the row key hashes every column plus that number, so a draw depends
on the rows alone and not on how the files are split.

Lines that do not fit the schema go to a quarantine table and are counted; train and
test files are read with one schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.selection import key_prefix
from ..operators import prep
from ..session import materialize, scratch_path
from ..sources.catalog import LABEL, RANDOM_STATE, FlowSpec, RawFormat, get_raw_format
from ..sources.readers import quarantined, raw_schema
from ..sources.store import Store, file_state
from .pipeline import TEST_SIZE, Prepared, finish, stored

COPY_BLOCK = 100_000     # copies of one row that a task writes out


def _labelled(df: DataFrame, fmt: RawFormat) -> DataFrame:
    if fmt.label_col != LABEL:                       # KDD: string label → ANOMALY
        df = prep.binarize_label(df, fmt.label_col).drop(fmt.label_col)
    return prep.drop_null_label(df.withColumn(LABEL, F.col(LABEL).cast("int")))


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPY_BLOCK)))
    numbered = counted.withColumn("_block", blocks)
    first = F.col("_block") * COPY_BLOCK
    last = F.least(first + COPY_BLOCK, F.col("_n")) - 1
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    key = F.md5(F.concat_ws("|", *parts, F.col("_copy").cast("string"), F.lit(str(seed))))
    # a row of very many copies is dealt out block by block before they are written
    return numbered.repartition(*cols, "_block").withColumn("_copy", F.explode(F.sequence(first, last))) \
        .withColumn("row_key", key).drop("_n", "_block", "_copy")


def _sampled(df: DataFrame, fmt: RawFormat, seed: int) -> DataFrame:
    keyed = materialize(_keyed(df, seed).withColumn("row_pfx", key_prefix("row_key")), "raw")
    return prep.exact_sample(keyed, fmt.sample_frac) if fmt.sample_frac else keyed


def prepare_raw(spark: SparkSession, fmt_name: str, train_path: str, test_path: str | None = None,
                seed: int = RANDOM_STATE, test_size: float = TEST_SIZE, schema: T.StructType | None = None,
                store: Store | None = None) -> Prepared:
    """The processed table of raw files; written once per files and parameters.  ``schema``
    replaces the declared or inferred one."""
    fmt = get_raw_format(fmt_name)
    if fmt.split_mode == "files" and test_path is None:
        raise ValueError(f"{fmt_name} needs a train and a test file")
    paths = {"train": train_path} | ({"test": test_path} if fmt.split_mode == "files" else {})
    store = store or Store(spark)
    draw = {"format": fmt.name, "files": {k: [p, file_state(spark, p)] for k, p in paths.items()}, "seed": seed,
            "test_size": test_size, "schema": schema.simpleString() if schema else None}
    spec = FlowSpec(name=fmt.name, table=None, key_cols=("row_key",), label_sql=LABEL, numeric=())
    return stored(store, spec, draw, lambda: _prepare(spark, fmt, paths, seed, test_size, schema))


def _prepare(spark: SparkSession, fmt: RawFormat, paths: dict, seed: int, test_size: float, schema) -> Prepared:
    schema = schema or raw_schema(spark, paths["train"], fmt)
    parts, rejected = {}, {}
    for name, path in paths.items():
        rows, rejected[name] = quarantined(spark, path, fmt, schema, scratch_path(spark, f"quarantine/{fmt.name}-{name}"))
        parts[name] = _labelled(_sampled(rows, fmt, seed), fmt)
    if fmt.split_mode == "files":
        df = parts["train"].withColumn("split", F.lit("train")).unionByName(parts["test"].withColumn("split", F.lit("test")))
    else:
        df = prep.stratified_split(parts["train"], test_size)
    df = prep.drop_if_exists(df, fmt.drop)
    strings = [c for c in prep.string_columns(df) if c not in ("row_key", "split")]
    categorical = [c for c in (fmt.categorical or strings) if c in df.columns]
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, prep.NUMERIC_TYPES)
               and f.name not in (LABEL, "row_pfx") and f.name not in categorical]
    df = df.withColumns({c: F.col(c).cast(T.DoubleType()) for c in numeric})
    spec = FlowSpec(name=fmt.name, table=None, key_cols=("row_key",), label_sql=LABEL,
                    numeric=tuple(numeric), categorical=tuple(categorical))
    train = df.filter(F.col("split") == "train").withColumn("ord", F.lit(None).cast("long"))
    test = prep.replay_order(df.filter(F.col("split") == "test"))
    ordered = train.unionByName(test).select("row_key", "split", "ord", LABEL, *spec.features)
    done = finish(ordered, spec, fmt.unseen)
    done.rejected = rejected
    return done
