"""Deterministic row keys and a distributed dense row index.

Every random draw of the library (sample order, stratified split, batch
order, warm-up chunks) is "order rows by md5(key | seed)".  DuckDB and Spark
compute the same md5 over the same string, so draws agree with an oracle.

A dense 0..n-1 rank in that order is needed for exact fractions and batch
slicing.  A global ``row_number()`` window would pull every row into one
task; instead the rows are range-partitioned on the (unique) order key,
sorted inside each partition, numbered locally and shifted by per-partition
offsets taken from a table with one row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33   # monotonically_increasing_id = partition_index << 33 | record_no


def row_key(key_exprs: Sequence[str], seed: int | str = 42) -> Column:
    """``md5(concat_ws('|', key..., seed))`` — identical text in DuckDB."""
    parts = [F.expr(k).cast("string") for k in key_exprs] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def row_key_sql(key_exprs: Sequence[str], seed: int | str = 42) -> str:
    """The same key as SQL text (for oracle queries)."""
    return "md5(concat_ws('|', " + ", ".join(list(key_exprs) + [f"'{seed}'"]) + "))"


def ordered_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                  name: str = "_idx", partitions: int | None = None,
                  broadcast_limit: int = 200_000) -> DataFrame:
    """Add ``name`` = dense 0-based rank of each row inside its group, by ``order_cols``.

    ``order_cols`` must make rows unique inside a group (add a tie-breaker
    otherwise) so the numbering is deterministic.  The sorted, numbered rows
    are written to the shared checkpoint folder: retries after a lost
    executor see the same numbering, and the offset table is computed once.
    """
    from ..session import materialize

    spark = df.sparkSession
    gcols = list(group_cols)
    keys = gcols + list(order_cols)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(sorted_df, "ordered")
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS))
    if not gcols:
        tagged = tagged.withColumn("_g0", F.lit(0))
        gcols_eff = ["_g0"]
    else:
        gcols_eff = gcols
    # one row per (partition, group): rows sorted by group, so a partition holds
    # a contiguous run of groups and the table has <= partitions + groups rows
    stats = tagged.groupBy("_pid", *gcols_eff).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_loc").alias("_first"))
    if not gcols:
        # ≤ one row per partition: prefix sums on the driver
        rows = sorted((r["_pid"], r["_cnt"], r["_first"]) for r in stats.collect())
        shifts, before = [], 0
        for pid, cnt, first in rows:
            shifts.append((pid, 0, before - first))
            before += cnt
        right = F.broadcast(spark.createDataFrame(shifts or [(0, 0, 0)],
                                                  "_pid long, _g0 int, _shift long"))
    else:
        w = Window.partitionBy(*gcols_eff).orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)
        stats = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
        stats = stats.select("_pid", *gcols_eff,
                             (F.col("_before") - F.col("_first")).alias("_shift"))
        n_stats = stats.count()
        right = F.broadcast(stats) if n_stats <= broadcast_limit else stats
    out = tagged.join(right, on=["_pid", *gcols_eff], how="inner")
    out = out.withColumn(name, F.col("_loc") + F.col("_shift"))
    return out.drop("_mid", "_pid", "_loc", "_shift", *(["_g0"] if not gcols else []))
