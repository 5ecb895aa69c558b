"""Scans: driver parquet tables, raw flow CSVs, processed tables and result
records (S1-S3, S6, S7, S13)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .catalog import KNOWN_METRICS, LABEL, FlowSpec, RawFormat

log = logging.getLogger(__name__)


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A large table already arrives in thousands of splits and is returned
    untouched (no extra shuffle); a small file with a single row group
    would otherwise run every per-row expression upstream of the first
    shuffle in one task.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table (parquet); Catalyst prunes columns and pushes filters."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallel(df) if spread else df


CORRUPT = "_corrupt"


def raw_schema(spark: SparkSession, path: str, fmt: RawFormat):
    """The schema of a raw file: declared, or inferred from a headered file once, so that
    train and test files are read alike."""
    if fmt.schema is not None:
        return fmt.schema
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path).schema


def read_raw_csv(spark: SparkSession, path: str, fmt: RawFormat, schema=None, corrupt: bool = False) -> DataFrame:
    """Headered (NetFlow) or headerless named (KDD, CORES) CSV.

    With ``corrupt`` a line that does not fit the schema stands whole in the column
    ``_corrupt``, beside the columns that could be read.
    """
    schema = schema or raw_schema(spark, path, fmt)
    reader = spark.read.option("header", str(fmt.header).lower()).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return reader.schema(schema).csv(path)


def quarantined(spark: SparkSession, path: str, fmt: RawFormat, schema, quarantine: str) -> tuple[DataFrame, int]:
    """The well-formed rows of a raw file, and how many lines were not: those are kept
    under ``quarantine`` with the file they come from.  The file is parsed once."""
    rows = read_raw_csv(spark, path, fmt, schema, corrupt=True).withColumn("_file", F.col("_metadata.file_path"))
    parsed = materialize(rows, "parsed")
    bad = parsed.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col("_file").alias("file"))
    n = bad.count()
    if n:
        log.warning("%d malformed lines of %s are kept in %s", n, path, quarantine)
        bad.write.mode("overwrite").parquet(quarantine)
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), n


def flow_frame(spark: SparkSession, sf_dir: str, spec: FlowSpec) -> DataFrame:
    """A driver table in flow form: key columns kept for the row key,
    ``ANOMALY`` derived from the spec's label rule, features as declared."""
    df = table(spark, sf_dir, spec.table)
    if spec.derived:
        df = df.withColumns({name: F.expr(sql) for name, sql in spec.derived})
    return df.withColumn(LABEL, F.expr(spec.label_sql).cast("int"))


def find_result_files(spark: SparkSession, root: str) -> DataFrame:
    """Discover ``<root>/<model>/<dataset>/<file>.csv`` records.

    Missing folders yield an empty frame rather than an error.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    rows = []
    if fs.exists(jvm_path):
        for model_st in fs.listStatus(jvm_path):
            if not model_st.isDirectory():
                continue
            for ds_st in fs.listStatus(model_st.getPath()):
                if not ds_st.isDirectory():
                    continue
                for f_st in fs.listStatus(ds_st.getPath()):
                    p = f_st.getPath()
                    if p.getName().endswith(".csv"):
                        rows.append((model_st.getPath().getName(), ds_st.getPath().getName(),
                                     p.toString()))
    return spark.createDataFrame(rows, "model string, dataset string, path string")


def load_result_files(spark: SparkSession, files: DataFrame) -> list[DataFrame]:
    """S7 + F12: the records of all ``files`` (model, dataset, path), tagged; one frame per
    header, each read in one scan.  Empty files and files without a known metric in
    their header are skipped with a warning."""
    listed = files.collect()             # one small row per result file
    if not listed:
        return []
    tags = {r.path: (r.model, r.dataset) for r in listed}
    text = spark.read.text(list(tags), wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n", 2)[0].alias("header"),
        (F.size(F.split(F.trim("value"), r"\r?\n")) > 1).alias("filled"))
    by_header: dict[str, list[str]] = {}
    for r in text.collect():
        if not r.filled or not set(KNOWN_METRICS) & set((r.header or "").split(",")):
            log.warning("skipping unreadable result file %s", r.path)
            continue
        by_header.setdefault(r.header, []).append(r.path)
    tagged = spark.createDataFrame([(p, *t) for p, t in tags.items()], "_path string, model string, dataset string") \
        .withColumn("_path", _plain_path(F.col("_path")))
    out = []
    for _, paths in sorted(by_header.items()):
        df = spark.read.option("header", "true").option("inferSchema", "true").csv(sorted(paths))
        own = [c for c in df.columns if c not in ("model", "dataset", "source_file")]
        df = df.select(*own, F.col("_metadata.file_path").alias("source_file"))
        out.append(df.join(F.broadcast(tagged), _plain_path(F.col("source_file")) == F.col("_path")).drop("_path"))
    return out


def _plain_path(path):
    """A file's path without its scheme, which listings write in different ways."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")


def load_result_file(spark: SparkSession, path: str, model: str, dataset: str,
                     source_file: str | None = None) -> DataFrame | None:
    """S7 for one file: its records, tagged; None if it is unreadable."""
    one = spark.createDataFrame([(model, dataset, path)], "model string, dataset string, path string")
    try:
        got = load_result_files(spark, one)
    except AnalysisException as exc:      # no such path
        log.warning("skipping unreadable result file %s: %s", path, exc)
        return None
    return got[0].withColumn("source_file", F.lit(source_file or path)) if got else None
