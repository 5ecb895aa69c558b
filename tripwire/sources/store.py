"""Tables and models kept under a folder by name and parameters.

An entry is a folder ``<root>/<kind>/<dataset>/<digest of the parameters>`` that holds
parquet tables and, written last, ``manifest`` with the parameters and the small
fitted values.  An entry without a manifest is incomplete and is written again, so a
run that was broken off leaves nothing that a later one would take.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def file_state(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of a table's files: a table that was written again is another."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        out.append([st.getPath().getName(), st.getLen(), st.getModificationTime()])
    return sorted(out)


class Store:
    """Entries under ``root``; by default in the session's shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or scratch_path(spark, "store")).rstrip("/")

    def folder(self, kind: str, dataset: str, params: dict) -> str:
        text = json.dumps(params, sort_keys=True, default=str)
        return f"{self.root}/{kind}/{dataset}/{hashlib.md5(text.encode()).hexdigest()}"

    def manifest(self, folder: str) -> dict | None:
        path = f"{folder}/manifest"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            return None
        row = self.spark.read.text(path, wholetext=True).first()
        return json.loads(row.value) if row else None

    def finish(self, folder: str, manifest: dict) -> None:
        """Declare an entry complete."""
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{folder}/manifest")

    def write_split(self, parts: dict[str, DataFrame], folder: str) -> None:
        """A table partitioned by ``split``, from the rows of every split; only the splits
        in ``parts`` are replaced.  Every split is a write of its own: one write of all of them
        would sort each task's rows by ``split``, and spill them."""
        block = self.spark.conf.get("spark.tripwire.rowGroupBytes", str(64 * 1024 * 1024))
        for name, df in parts.items():
            df.drop("split").write.mode("overwrite").option("parquet.block.size", block).parquet(f"{folder}/rows/split={name}")

    def read_split(self, folder: str, columns: list[str]) -> DataFrame:
        """S3: the table; a filter on ``split`` reads that folder only."""
        return self.spark.read.parquet(f"{folder}/rows").select(*[F.col(f"`{c}`") for c in columns])
