"""Hand-made fixtures for the operators' edge semantics (FIXTURES §6) and the
golden records of the reference (SURVEY §5, G1-G5)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.functions.metrics import with_metrics
from tripwire.functions.quantiles import exact_percentiles
from tripwire.functions.rowkey import ordered_index
from tripwire.operators import compare, prep, profile
from tripwire.operators.learners import SEAPool, member_accuracy, pool_vote, replaced_slot, warmup_chunks
from tripwire.operators.learners import StepResult
from tripwire.plans.cascade import metric_values

# --- golden values: confusion counts and published metrics of the 12 stored runs
# (model, dataset, tn, fp, fn, tp, accuracy, f1_macro, balanced_accuracy or None)
GOLDEN = [
    ("isolation_forest", "kdd", 31481, 16916, 5752, 194674, 0.9089, 0.8401, None),
    ("isolation_forest", "cores_iot", 51148, 42707, 1, 107894, 0.7883, 0.7701, None),
    ("isolation_forest", "netflow", 411846, 335154, 1776, 163138, 0.6305, 0.6008, None),
    ("sgd", "kdd", 42497, 5900, 15114, 185312, 0.9155, 0.8741, 0.9013),
    ("sgd", "cores_iot", 83501, 10354, 8914, 98981, 0.9045, 0.9039, 0.9035),
    ("sgd", "netflow", 714238, 32762, 48565, 116349, 0.9108, 0.8436, 0.8308),
    ("mlp", "kdd", 46642, 1755, 11090, 189336, 0.9484, 0.9231, 0.9542),
    ("mlp", "cores_iot", 85881, 7974, 13754, 94141, 0.8923, 0.8921, 0.8938),
    ("mlp", "netflow", 718309, 28691, 16431, 148483, 0.9505, 0.9188, 0.931),
    ("ensemble", "kdd", 47413, 984, 11438, 188988, 0.9501, 0.9262, 0.9613),
    ("ensemble", "cores_iot", 85074, 8781, 21, 107874, 0.9564, 0.9558, 0.9531),
    ("ensemble", "netflow", 727869, 19131, 3485, 161429, 0.9752, 0.9596, 0.9766),
]
# stage-2 calls of every stage-2 run = forest fp + tp on that dataset
GOLDEN_CALLS = {"netflow": 498292, "kdd": 211590, "cores_iot": 150601}
# expected order of the best-per-(model, dataset) summary
GOLDEN_BEST_ORDER = [("ensemble", "netflow"), ("ensemble", "cores_iot"), ("ensemble", "kdd"),
                     ("mlp", "kdd"), ("mlp", "netflow"), ("sgd", "cores_iot"),
                     ("mlp", "cores_iot"), ("sgd", "kdd"), ("sgd", "netflow"),
                     ("isolation_forest", "kdd"), ("isolation_forest", "cores_iot"),
                     ("isolation_forest", "netflow")]


def test_g1_metrics_follow_from_counts(spark):
    rows = [(m, d, tn, fp, fn, tp) for m, d, tn, fp, fn, tp, *_ in GOLDEN]
    df = spark.createDataFrame(rows, "model string, dataset string, tn long, fp long, fn long, tp long")
    got = {(r.model, r.dataset): r for r in with_metrics(df, 4).collect()}
    for m, d, *_c, acc, f1m, bal in GOLDEN:
        r = got[(m, d)]
        assert r.accuracy == acc and r.f1_macro == f1m
        if bal is not None:
            assert r.balanced_accuracy == bal
    tn, fp, fn, tp, _acc, f1m, _bal = GOLDEN[0][2:]
    assert round(metric_values(StepResult(tn, fp, fn, tp))["f1_macro"], 4) == f1m


def test_g2_g3_cascade_identities():
    forest = {d: (tn, fp, fn, tp) for m, d, tn, fp, fn, tp, *_ in GOLDEN if m == "isolation_forest"}
    for d, (_tn, fp, _fn, tp) in forest.items():
        assert fp + tp == GOLDEN_CALLS[d]
    for m, d, tn, fp, fn, tp, *_ in GOLDEN:
        if m != "isolation_forest":
            assert fn >= forest[d][2] and fp <= forest[d][1]


def test_g5_best_order(spark):
    rows = [(m, d, f1m) for m, d, *_c, _a, f1m, _b in GOLDEN]
    df = spark.createDataFrame(rows, "model string, dataset string, f1_macro double")
    best = compare.best_per_group(df, "both", "f1_macro")
    order = [(r.model, r.dataset) for r in best.orderBy(F.col("f1_macro").desc(), "model", "dataset").collect()]
    assert order == GOLDEN_BEST_ORDER


def test_confusion_zero_div(spark):
    df = spark.createDataFrame([(10, 0, 5, 0)], "tn long, fp long, fn long, tp long")
    r = with_metrics(df).first()
    assert r.precision_anomaly == 0.0 and r.f1_anomaly == 0.0 and r.recall_anomaly == 0.0


def test_vote_tie(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (0, 0, 0, 1)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(pool_vote([F.col(c) for c in "abcd"])).collect()] == [1, 0]   # 2 of 4 → attack
    assert [r[0] for r in df.select(pool_vote([])).collect()] == [0, 0]


def test_pool_prune_first_on_tie(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.5, 0.7, 0.6],)], "acc array<double>")
    assert df.select(replaced_slot(F.col("acc"))).first()[0] == 1
    votes = spark.createDataFrame([(1, 1, 0, 1), (0, 1, 0, 1), (1, 0, 0, 0)], "ANOMALY int, a int, b int, f int")
    got = votes.agg(member_accuracy([F.col("a"), F.col("b")], F.col("f") == 1)).first()[0]
    assert got == [0.5, 0.5]


def test_single_class_batch_is_noop(spark):
    pool = SEAPool(features=["a", "b"])
    df = spark.createDataFrame([(float(i), 1.0, 0) for i in range(20)], "a double, b double, ANOMALY int")
    pool.step(df.withColumn("s1_flag", F.lit(1)))
    assert pool.members == []


def test_last_short_batch(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "ord long")
    got = prep.assign_batches(df, 10).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [10, 10, 5]


def test_warmup_chunks(spark):
    df = spark.createDataFrame([(i,) for i in range(13)], "ord long")
    used = warmup_chunks(ordered_index(df, ["ord"], name="rk"), 13, 5, index="rk", name="chunk")
    assert sorted((r.ord, r.chunk) for r in used.collect()) == [(i, i // 2) for i in range(10)]   # rows 11-13 unused


def test_ordered_index_dense_per_group(spark):
    rows = [(i % 3, f"{(i * 7919) % 1000:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, k string")
    got = ordered_index(df, ["k"], group_cols=["g"], name="i").collect()
    for g in range(3):
        part = sorted((r.k, r.i) for r in got if r.g == g)
        assert [i for _, i in part] == list(range(len(part)))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_percentiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.exponential(3.0, n), 1)           # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.55, 0.75, 0.99, 1.0]
    got = exact_percentiles(df, ["v"], qs, collect_limit=50)
    for q in qs:
        assert math.isclose(got[("", "v", q)], float(np.percentile(vals, q * 100)), rel_tol=1e-12,
                            abs_tol=1e-12)


def test_robust_scale_properties(spark):
    rows = [(float(i), 5.0, 0) for i in range(101)]
    df = spark.createDataFrame(rows, "x double, c double, ANOMALY int")
    sc = prep.fit_robust(df, ["x", "c"])
    out = sc.transform(df)
    med = exact_percentiles(out, ["x", "c"], [0.25, 0.5, 0.75])
    assert med[("", "x", 0.5)] == 0.0
    assert med[("", "x", 0.75)] - med[("", "x", 0.25)] == 1.0
    assert sc.scales["c"] == 1.0                          # IQR 0 → x - median
    assert {r.c for r in out.select("c").distinct().collect()} == {0.0}


def test_binarize_label_null_is_attack(spark):
    df = spark.createDataFrame([("normal.",), ("smurf.",), (None,), ("normal",)], "label string")
    got = [r.ANOMALY for r in prep.binarize_label(df).collect()]
    assert got == [0, 1, 1, 0]


def test_encoder_unseen(spark):
    fit = spark.createDataFrame([("tcp",), ("udp",)], "p string")
    enc = prep.fit_ordinal(fit, ["p"], unseen="zero")
    df = spark.createDataFrame([("udp",), ("icmp",), (None,)], "p string")
    assert [r.p for r in enc.transform(df).collect()] == [1, 0, 0]
    strict = prep.fit_ordinal(fit, ["p"], unseen="error")
    with pytest.raises(Exception):
        strict.transform(df).collect()


def test_stratified_split_proportions(spark):
    rows = [(f"k{i:05d}", 1 if i % 4 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_key string, ANOMALY int")
    out = prep.stratified_split(df, 0.2)
    c = {(r.split, r.ANOMALY): r["count"] for r in out.groupBy("split", "ANOMALY").count().collect()}
    assert c[("test", 0)] + c[("test", 1)] == 200
    assert c[("test", 1)] == 50 and c[("test", 0)] == 150


def test_mixed_records_union_and_null_last(spark):
    a = spark.createDataFrame([("m1", "d", 0.5, 1.0)], "model string, dataset string, f1_macro double, elapsed_sec double")
    b = spark.createDataFrame([("m2", "d", None, 0.9)], "model string, dataset string, f1_macro double, balanced_acc double")
    u = compare.union_records([a, b])
    assert {"total_time_sec", "balanced_accuracy"} <= set(u.columns)
    assert "elapsed_sec" not in u.columns
    best = compare.best_per_group(u, "dataset").first()
    assert best.model == "m1"


def test_duplicates_and_conflicts(spark):
    rows = [(1, "a", 0), (1, "a", 0), (1, "a", 1), (2, "b", 0)]
    df = spark.createDataFrame(rows, "x int, s string, ANOMALY int")
    r = profile.duplicate_summary(df, ["x", "s"]).first()
    assert (r.n_duplicate_rows, r.n_duplicate_features, r.n_conflicting_groups) == (1, 2, 1)


def test_raw_csv_formats(spark, tmp_path):
    from tripwire.sources.catalog import KDD_COLUMNS, get_raw_format
    from tripwire.sources.readers import read_raw_csv

    line = ",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal."])
    p = tmp_path / "kdd.csv"
    p.write_text(line + "\n" + line.replace("normal.", "smurf.") + "\n")
    df = read_raw_csv(spark, str(p), get_raw_format("kdd"))
    assert df.columns == KDD_COLUMNS and df.count() == 2
    lab = prep.binarize_label(df)
    assert sorted(r.ANOMALY for r in lab.collect()) == [0, 1]
    with pytest.raises(ValueError):
        get_raw_format("nope")


def test_class_distribution_keeps_null_and_unlisted_classes(spark):
    from tripwire.operators.profile import class_distribution

    df = spark.createDataFrame([(0,), (0,), (2,), (None,)], "label int")
    got = {r.label: (r.n, r.share) for r in class_distribution(df, "label").collect()}
    assert got == {0: (2, 0.5), 1: (0, 0.0), 2: (1, 0.25), None: (1, 0.25)}


def test_markdown_keeps_every_row(spark):
    from tripwire.operators.compare import to_markdown

    df = spark.range(1500).selectExpr("'m' as model", "cast(id as string) as dataset", "0.5d as accuracy")
    assert len(to_markdown(df, ["accuracy"]).split("\n")) == 1502


def test_batches_in_any_order_are_applied_once(spark, tmp_path):
    from tripwire.operators.learners import StepResult
    from tripwire.streaming.prequential import PrequentialSink

    class Counter:
        def __init__(self):
            self.seen = 0

        def step(self, df, flag_col):
            n = df.count()
            self.seen += n
            return StepResult(n, 0, 0, 0, n, 0)

        def state(self):
            return {"seen": self.seen}

        def load(self, state):
            self.seen = state["seen"]

    def batch(b):
        return spark.range(20).selectExpr("id", f"{b} as batch_id")

    sink = PrequentialSink(spark, Counter(), str(tmp_path / "state"), "flag")
    for b in (0, 2, 1, 2):
        sink(batch(b), 0)
    assert sink.total.n == 60
    again = PrequentialSink(spark, Counter(), str(tmp_path / "state"), "flag")
    again(batch(1), 0)
    assert again.total.n == 60 and again.learner.seen == 60


def test_encoder_joins_large_dictionaries(spark, monkeypatch):
    """Shuffled dictionary with hot values, unseen values, quartiles of the codes."""
    rows = [("hot", "x")] * 400 + [(f"v{i:03d}" if i % 50 else None, f"b{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "p string, q string").repartition(6)
    codes = {v: i for i, v in enumerate(sorted({p or "nan" for p, _ in rows}))}
    for limit, block in ((100_000, 10_000), (10, 7)):
        monkeypatch.setattr(prep, "BROADCAST_CODES", limit)
        monkeypatch.setattr(prep, "_CODE_BLOCK", block)
        enc = prep.fit_ordinal(df, ["p", "q"])
        assert enc.sizes == {"p": len(codes), "q": 4} and enc.rows == {"p": 700, "q": 700}
        got = enc.transform(df.withColumn("raw", F.col("p")))
        assert got.columns == ["p", "q", "raw"]
        assert sorted((r.raw or "nan", r.p) for r in got.collect()) == sorted((p or "nan", codes[p or "nan"]) for p, _ in rows)
        want = np.quantile([codes[p or "nan"] for p, _ in rows], [0.25, 0.5, 0.8])
        assert np.allclose([enc.code_percentiles(["p"], [0.25, 0.5, 0.8])["p", q] for q in (0.25, 0.5, 0.8)], want)
        new = spark.createDataFrame([("hot", "b0"), ("new", "b1")], "p string, q string")
        enc.unseen = "keep"
        assert {r.p for r in enc.transform(new).collect()} == {codes["hot"], len(codes)}
        enc.unseen = "error"
        with pytest.raises(Exception, match="unseen label in p: new"):
            enc.transform(new).collect()
    assert prep.encode_independent(df, ["q"]).agg(F.max("q")).first()[0] == 3


def test_exact_percentiles_narrow_in_groups(spark):
    """Many passes: few rows may be fetched, ties, infinities, gaps, groups of their own."""
    rng = np.random.default_rng(4)
    vals = np.concatenate([rng.normal(size=4000), np.repeat([0.5, -1.0], 1500), [np.inf, -np.inf, 1e308]])
    rows = [("a" if i % 3 else "b", float(v), float(i % 5)) for i, v in enumerate(vals)] + [("c", None, float("nan")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    for limit in (3, 100_000):
        got = exact_percentiles(df, ["v", "w"], qs, group_col="g", collect_limit=limit)
        assert not any(k[0] == "c" for k in got)
        for g in "ab":
            for c, k in (("v", 1), ("w", 2)):
                own = sorted(r[k] for r in rows if r[0] == g)
                for q in qs:
                    pos = q * (len(own) - 1)
                    lo, hi = own[int(pos)], own[min(int(pos) + 1, len(own) - 1)]
                    want = lo if pos == int(pos) or lo == hi else lo + (hi - lo) * (pos - int(pos))
                    assert got[g, c, q] == want, (g, c, q, limit)
