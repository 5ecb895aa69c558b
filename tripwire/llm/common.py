"""Helpers shared by the corpus operators: tables, shared scratch, text arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: code points handled at once inside a Python task; bounds its memory
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own;
    on a cluster an unset folder is an error.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getCheckpointDir()
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(texts: list[str], most: int = CHUNK_CHARS, items: int = 60_000) -> Iterator[list[int]]:
    """Indices of ``texts`` in groups of bounded total length, similar lengths
    together; a text longer than ``most`` is a group of its own."""
    group: list[int] = []
    total = 0
    for i in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if group and (total + len(texts[i]) > most or len(group) == items):
            yield group
            group, total = [], 0
        group.append(i)
        total += len(texts[i]) + 1
    if group:
        yield group


def codes_of(text: str) -> np.ndarray:
    """Code points of a text (lone surrogates included)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """For every code point, its one-code-point lower case, else itself."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)),
                       np.uint32, 0x110000)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finaliser) over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
