"""Stage-1 detector: isolation forest fitted on benign rows.

Semantics [Liu, Ting, Zhou 2008]: each of ``n_trees`` trees is grown on
ψ = min(max_samples, n) rows drawn without replacement; a node splits on a
random non-constant feature at a uniform value between the node's min and
max, until depth ceil(log2 ψ) or a single row.  A row's path length is the
depth of its leaf plus c(leaf size); score = 2^(-mean path / c(ψ)).

Spark shape:

* sampling: for every tree, each row draws u = hash(row_key, tree, seed);
  a row is a candidate of tree t when u < p (p sized so that ~ψ + 8√ψ rows
  qualify), and the ψ smallest u per tree are kept.  One narrow scan, no
  sort of the table; if a tree's root holds fewer than ψ rows the draw is
  repeated with a larger p (the hashes are fixed, so the result is exact).
* growth: ``groupBy('tree_id').applyInPandas`` on ≤ n_trees·ψ rows — each
  group is one tree's ψ rows, bounded by construction.
* scoring: a vectorised pandas UDF walking all trees at once; the forest
  (≤ n_trees·(2ψ-1) nodes) ships inside the UDF closure.
* threshold: ``score > percentile(score of benign rows, 1 - contamination)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles

EULER_GAMMA = 0.5772156649


def avg_path_length(n):
    """c(n): average path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


NODE_SCHEMA = ("tree_id int, node_id int, feature int, split double, left_child int, "
               "right_child int, size long, depth int")


@dataclass
class Forest:
    """Nodes table plus the sample size ψ; arrays padded per tree."""

    features: list[str]
    psi: int
    nodes: pd.DataFrame

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree_id"].nunique())

    def arrays(self):
        t = self.nodes["tree_id"].to_numpy()
        trees = np.unique(t)
        width = int(self.nodes.groupby("tree_id")["node_id"].max().max()) + 1
        shape = (len(trees), width)
        feat = np.zeros(shape, dtype=np.int64)
        split = np.zeros(shape, dtype=np.float64)
        left = np.full(shape, -1, dtype=np.int64)
        right = np.full(shape, -1, dtype=np.int64)
        leafval = np.zeros(shape, dtype=np.float64)
        ti = np.searchsorted(trees, t)
        ni = self.nodes["node_id"].to_numpy()
        feat[ti, ni] = self.nodes["feature"].to_numpy()
        split[ti, ni] = self.nodes["split"].to_numpy()
        left[ti, ni] = self.nodes["left_child"].to_numpy()
        right[ti, ni] = self.nodes["right_child"].to_numpy()
        leafval[ti, ni] = self.nodes["depth"].to_numpy() + avg_path_length(
            self.nodes["size"].to_numpy())
        depth = int(self.nodes["depth"].max())
        return feat, split, left, right, leafval, depth

    def to_frame(self, spark):
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree over the rows of ``x``; returns node tuples."""
    nodes = []
    stack = [(np.arange(len(x)), 0, 0)]
    next_id = 1
    while stack:
        idx, depth, nid = stack.pop()
        sub = x[idx]
        feature, split, left, right = -1, 0.0, -1, -1
        if depth < max_depth and len(idx) > 1:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable):
                f = int(usable[rng.integers(len(usable))])
                s = float(rng.uniform(lo[f], hi[f]))
                if s >= hi[f]:          # keep both sides non-empty
                    s = float(np.nextafter(hi[f], lo[f]))
                go_left = sub[:, f] <= s
                feature, split = f, s
                left, right = next_id, next_id + 1
                next_id += 2
                stack.append((idx[~go_left], depth + 1, right))
                stack.append((idx[go_left], depth + 1, left))
        nodes.append((nid, feature, split, left, right, len(idx), depth))
    return nodes


def _grower(features: Sequence[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    feats = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        # the ψ smallest draws of this tree (candidates number ~ψ + 8√ψ)
        pdf = pdf.sort_values(["u", "row_key"], kind="mergesort").head(psi)
        x = pdf[feats].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, tree])
        rows = _grow_tree(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node_id", "feature", "split", "left_child",
                                          "right_child", "size", "depth"])
        out.insert(0, "tree_id", tree)
        return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32",
                           "left_child": "int32", "right_child": "int32", "size": "int64",
                           "depth": "int32"})

    return grow


def _binomial_cdf(n: int, p: float) -> list[float]:
    """Cumulative Binomial(n, p) probabilities up to 1 - 1e-15."""
    out, acc = [], 0.0
    for k in range(n + 1):
        acc += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        out.append(acc)
        if acc >= 1.0 - 1e-15:
            break
    return out


def _candidates(df: DataFrame, n_trees: int, p: float, seed: int, key: str) -> DataFrame:
    """(tree_id, u, row...) where every (row, tree) pair is drawn
    independently with probability p.

    Per row, one hash decides how many trees K ~ Binomial(n_trees, p) take
    it (inverse CDF); only rows with K > 0 (≈ n_trees·p of them) rank the
    trees by a second hash and keep the K first — a uniform K-subset, which
    is the same joint law as independent per-tree draws.  ``u`` orders the
    candidates inside a tree."""
    unit = lambda h: F.shiftrightunsigned(h, 11) / float(2 ** 53)
    h = F.xxhash64(F.col(key), F.lit(seed))
    cdf = _binomial_cdf(n_trees, p)
    u0 = unit(F.xxhash64(h, F.lit(-1)))
    k = F.lit(len(cdf))
    for i in range(len(cdf) - 1, -1, -1):
        k = F.when(u0 < F.lit(cdf[i]), F.lit(i)).otherwise(k)
    rows = df.withColumn("_h", h).withColumn("_k", k).filter(F.col("_k") > 0)
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(n_trees - 1)),
        lambda t: F.struct(F.xxhash64(F.col("_h"), t).alias("r"), t.alias("tree_id"))))
    picked = rows.select("*", F.explode(F.slice(ranked, 1, F.col("_k"))).alias("_c"))
    return picked.select(
        F.col("_c.tree_id").cast("int").alias("tree_id"),
        unit(F.xxhash64(F.col("_h"), F.col("_c.tree_id"), F.lit(7))).alias("u"), *df.columns)


def _grow_all(df: DataFrame, feats, n_trees: int, psi: int, p: float, seed: int,
              key: str) -> pd.DataFrame:
    cand = _candidates(df, n_trees, p, seed, key).withColumnRenamed(key, "row_key")
    # explicit partition count: trees spread over the cores, not coalesced by AQE;
    # each group is one tree's ~ψ + 8√ψ candidates (bounded)
    par = df.sparkSession.sparkContext.defaultParallelism
    kept = cand.repartition(max(1, min(n_trees, par)), "tree_id")
    nodes = kept.groupBy("tree_id").applyInPandas(_grower(feats, psi, seed), NODE_SCHEMA)
    return nodes.toPandas()            # ≤ n_trees·(2ψ-1) rows, by construction


def fit_forest(benign: DataFrame, features: Sequence[str], n_trees: int = 100,
               max_samples: int = 256, seed: int = 42, key: str = "row_key",
               n: int | None = None) -> Forest:
    """T1 on the benign training rows (``n`` = their count, if known)."""
    feats = list(features)
    base = benign.select(key, *[F.col(c).cast("double") for c in feats])
    n = base.count() if n is None else n
    if n == 0:
        raise ValueError("isolation forest needs at least one benign row")
    psi = min(max_samples, n)
    p = 1.0 if n <= psi else min(1.0, (psi + 8 * math.sqrt(psi) + 16) / n)
    while True:
        pdf = _grow_all(base, feats, n_trees, psi, p, seed, key)
        roots = pdf[pdf["node_id"] == 0].set_index("tree_id")["size"]
        short = [t for t in range(n_trees) if roots.get(t, 0) < psi]
        if not short or p >= 1.0:
            break
        p = min(1.0, p * 2)       # rare: redraw with a larger p (same hashes, exact result)
    return Forest(feats, psi, pdf.sort_values(["tree_id", "node_id"]).reset_index(drop=True))


def _kernel(forest: Forest):
    """Arrays for the scoring walk: per tree a child table where a leaf
    points to itself, so every row can take the same number of steps."""
    feat, split, left, right, leafval, depth = forest.arrays()
    width = feat.shape[1]
    leaf = left < 0
    child = np.stack([left, right], axis=2)
    child = np.where(leaf[..., None], np.arange(width)[None, :, None], child).astype(np.int32)
    c_psi = float(avg_path_length([forest.psi])[0]) or 1.0
    return feat.astype(np.int32), split, child.reshape(feat.shape[0], -1), leafval, depth, c_psi


def score_array(kernel, xt: np.ndarray) -> np.ndarray:
    """Scores of the columns of ``xt`` (features × rows)."""
    feat, split, child, leafval, depth, c_psi = kernel
    m = xt.shape[1]
    cols = np.arange(m)
    total = np.zeros(m)
    for t in range(feat.shape[0]):
        fe, sp, ch = feat[t], split[t], child[t]
        node = np.zeros(m, dtype=np.int32)
        for _ in range(depth):
            node = ch[node * 2 + (xt[fe[node], cols] > sp[node])]
        total += leafval[t][node]
    return np.power(2.0, -(total / feat.shape[0]) / c_psi)


def score_udf(forest: Forest):
    """T2 as a vectorised pandas UDF over the feature columns: each tree
    walks every row of the Arrow batch one level per step."""
    kernel = _kernel(forest)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        xt = np.vstack([c.to_numpy(dtype=np.float64) for c in cols])   # features × rows
        return pd.Series(score_array(kernel, xt))

    return score


def with_scores(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    return df.withColumn(name, score_udf(forest)(*[F.col(c).cast("double") for c in forest.features]))


def thresholds(scored_benign: DataFrame, contaminations: Sequence[float],
               col: str = "score") -> dict[float, float]:
    """Cut-off per contamination from one exact-percentile job."""
    got = exact_percentiles(scored_benign, [col], [1 - c for c in contaminations])
    return {c: got[("", col, 1 - c)] for c in contaminations}


def save_forest(forest: Forest, spark, path: str, cutoffs: dict[float, float]) -> None:
    """Nodes and thresholds as parquet tables."""
    forest.to_frame(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(float(c), float(t)) for c, t in cutoffs.items()],
                          "contamination double, threshold double").write.mode(
        "overwrite").parquet(f"{path}/thresholds")
    spark.createDataFrame([(forest.psi, ",".join(forest.features))],
                          "psi int, features string").write.mode("overwrite").parquet(f"{path}/meta")


def load_forest(spark, path: str) -> tuple[Forest, dict[float, float]]:
    """Reuse a fitted detector; a missing model raises FileNotFoundError."""
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as exc:
        raise FileNotFoundError(f"no forest at {path}") from exc
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree_id", "node_id"])
    cut = {r.contamination: r.threshold for r in spark.read.parquet(f"{path}/thresholds").collect()}
    return Forest(meta.features.split(","), meta.psi, nodes.reset_index(drop=True)), cut
