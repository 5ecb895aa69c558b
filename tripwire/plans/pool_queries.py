"""Pool mechanics with rule members, checkable in SQL.

Members are fixed rules ``feature > benign median`` so that the vote, the
per-member batch accuracy, the prune choice and the warm-up chunks, which are
those of the learned pool (``operators/learners.py``), can be compared with an
oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.rowkey import ordered_index
from ..operators import learners, prep
from ..sources.catalog import LABEL, LINEITEM
from .common import DIGITS
from .prep_queries import BATCH_SIZE, split_ctes
from .pipeline import split_flows
from ..sources.readers import flow_frame

VOTERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEMBERS = list(LINEITEM.numeric)
LI = f"(SELECT *, ({LINEITEM.label_sql}) AS {LABEL} FROM lineitem)"


# ---------------------------------------------------------------- L5 vote with ties
def vote_tie(spark, sf_dir):
    df = flow_frame(spark, sf_dir, LINEITEM)
    med = exact_percentiles(prep.benign(df), VOTERS, [0.5])
    votes = [(F.col(c) > F.lit(med[("", c, 0.5)])).cast("int") for c in VOTERS]
    out = df.groupBy(sum(votes).cast("int").alias("n_votes"), learners.pool_vote(votes).alias("pred"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).cast("long").alias("n_anomaly"))


VOTE_TIE_SQL = (
    f"WITH m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in VOTERS)} "
    f"FROM {LI} b WHERE {LABEL} = 0),\n"
    f"v AS (SELECT CAST({' + '.join(f'CAST({c} > m_{c} AS INTEGER)' for c in VOTERS)} AS INTEGER) "
    f"AS n_votes, {LABEL} FROM {LI} x, m)\n"
    f"SELECT n_votes, count(*) AS n, CAST(sum({LABEL}) AS BIGINT) AS n_anomaly, "
    f"CASE WHEN n_votes / {len(VOTERS)} >= 0.5 THEN 1 ELSE 0 END AS pred FROM v GROUP BY n_votes")


# ---------------------------------------------------------------- L6/L10 prune choice
def pool_prune(spark, sf_dir):
    o = split_flows(spark, sf_dir, LINEITEM)
    bt = o.filter((F.col("split") == "train") & (F.col(LABEL) == 0))
    med = exact_percentiles(bt, MEMBERS, [0.5])
    test = prep.assign_batches(o.filter(F.col("split") == "test"), BATCH_SIZE)
    votes = [(F.col(c) > F.lit(med[("", c, 0.5)])).cast("int") for c in MEMBERS]
    acc = test.groupBy("batch_id").agg(learners.member_accuracy(votes).alias("acc"))
    return acc.select("batch_id", learners.replaced_slot(F.col("acc")).alias("worst"), F.posexplode("acc").alias("slot", "accuracy")) \
        .select("batch_id", "slot", F.round("accuracy", DIGITS).alias("accuracy"), (F.col("slot") == F.col("worst")).alias("is_worst"))


def _prune_sql():
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS m{i}" for i, c in enumerate(MEMBERS))
    accs = ", ".join(
        f"CAST(sum(CASE WHEN CAST({c} > m{i} AS INTEGER) = {LABEL} THEN 1 ELSE 0 END) AS DOUBLE) "
        f"/ count(*) AS a{i}" for i, c in enumerate(MEMBERS))
    long = " UNION ALL ".join(f"SELECT batch_id, {i} AS slot, a{i} AS accuracy FROM acc"
                              for i in range(len(MEMBERS)))
    return (f"WITH {split_ctes(LINEITEM)},\n"
            f"m AS (SELECT {meds} FROM o WHERE split = 'train' AND {LABEL} = 0),\n"
            f"acc AS (SELECT CAST(floor(ord / {BATCH_SIZE}) AS INTEGER) AS batch_id, {accs} "
            f"FROM o, m WHERE split = 'test' GROUP BY 1),\n"
            f"l AS ({long})\n"
            f"SELECT batch_id, slot, round(accuracy, {DIGITS}) AS accuracy, row_number() OVER "
            f"(PARTITION BY batch_id ORDER BY accuracy, slot) = 1 AS is_worst FROM l")


POOL_PRUNE_SQL = _prune_sql()


# ---------------------------------------------------------------- L8 warm-up chunks
POOL_SIZE = 5
CONTAMINATION = 0.45


def warmup_chunks(spark, sf_dir):
    o = split_flows(spark, sf_dir, LINEITEM)
    score = LINEITEM.score_col
    bt = o.filter((F.col("split") == "train") & (F.col(LABEL) == 0))
    cut = exact_percentiles(bt, [score], [1 - CONTAMINATION])[("", score, 1 - CONTAMINATION)]
    flagged = o.filter((F.col("split") == "train") & (F.col(score) > F.lit(cut)))
    idx = ordered_index(flagged.select("row_key", LABEL), ["row_key"], name="rk")
    n = idx.count()
    chunks = learners.warmup_chunks(idx, n, POOL_SIZE, index="rk", name="chunk_id")
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(LABEL).cast("long").alias("n_anomaly"))


WARMUP_CHUNKS_SQL = (
    f"WITH {split_ctes(LINEITEM)},\n"
    f"c AS (SELECT quantile_cont({LINEITEM.score_col}, {1 - CONTAMINATION!r}) AS cut FROM o "
    f"WHERE split = 'train' AND {LABEL} = 0),\n"
    f"fl AS (SELECT {LABEL}, row_number() OVER (ORDER BY row_key) - 1 AS rk FROM o, c "
    f"WHERE split = 'train' AND {LINEITEM.score_col} > cut),\n"
    f"sz AS (SELECT greatest(1, count(*) // {POOL_SIZE}) AS size FROM fl)\n"
    f"SELECT CAST(floor(rk / size) AS INTEGER) AS chunk_id, count(*) AS n, "
    f"CAST(sum({LABEL}) AS BIGINT) AS n_anomaly FROM fl, sz WHERE floor(rk / size) < {POOL_SIZE} GROUP BY 1")


QUERIES = {"vote_tie": vote_tie, "pool_prune": pool_prune, "warmup_chunks": warmup_chunks}
SQL = {"vote_tie": VOTE_TIE_SQL, "pool_prune": POOL_PRUNE_SQL, "warmup_chunks": WARMUP_CHUNKS_SQL}
