"""Processed tables, detectors and learners kept and taken again; raw files end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.plans.cascade import load_learner, run_stage1
from tripwire.plans.experiment import Dataset, compare_phase, load_corpus, run_all
from tripwire.plans.pipeline import prepare, split_flows
from tripwire.plans.raw_pipeline import prepare_raw
from tripwire.sources.catalog import KDD_COLUMNS, LINEITEM
from tripwire.sources.store import Store, exists


def test_processed_table_is_written_once(spark, sf_dir, tmp_path):
    store = Store(spark, str(tmp_path))
    first = prepare(spark, sf_dir, LINEITEM, store=store)
    rows = {tuple(r) for r in first.table.collect()}
    held = store.manifest(first.folder)
    again = prepare(spark, sf_dir, LINEITEM, store=store)
    assert again.folder == first.folder and store.manifest(again.folder) == held
    assert {tuple(r) for r in again.table.collect()} == rows
    assert again.scaling == first.scaling and again.encoding.sizes == first.encoding.sizes
    assert prepare(spark, sf_dir, LINEITEM, seed=7, store=store).folder != first.folder
    plan = again.split("test")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    plan = again.benign_train()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ANOMALY), EqualTo(ANOMALY,0)]" in plan
    parts = split_flows(spark, sf_dir, LINEITEM, store=store)
    assert parts.where("split = 'test'").agg(F.max("ord")).first()[0] == parts.where("split = 'test'").count() - 1
    assert store.manifest(store.folder("processed", "lineitem", {"x": 1})) is None


def test_scratch_is_cleared(spark):
    from tripwire import session

    session._WRITTEN.clear()
    df = session.materialize(spark.range(5).toDF("x"), "gone")
    path = session._WRITTEN[0]
    assert df.count() == 5 and exists(spark, path)
    assert session.clear_scratch(spark) == 1 and not exists(spark, path)


def _kdd(path, rng, n):
    lines = []
    for _ in range(n):
        attack = rng.random() < 0.3
        row = []
        for c in KDD_COLUMNS[:-1]:
            row.append(rng.choice(["tcp", "udp"]) if c in ("protocol_type", "service", "flag") else
                       f"{rng.random():.2f}" if c.endswith("_rate") else str(int(rng.integers(0, 900 if attack else 9))))
        lines.append(",".join([*row, "smurf." if attack else "normal."]))
    path.write_text("\n".join([*lines, "broken,line", lines[0] + ",1,2,3", lines[1].replace("tcp", "tcp", 1), ""]))
    return str(path)


def _cores(path, rng, n):
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append(",".join([str(i)] + [f"{rng.normal(3 * y, 1):.3f}" for _ in range(18)] + [str(y)]))
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def _netflow(path, rng, n, extra=()):
    out = ["FLOW_ID,ID,ALERT,f_num_0,f_num_1,f_cat_0,ANOMALY"]
    out += [f"{i},{i},a,{rng.random():.3f},{rng.integers(0, 50)},{rng.choice(['x', 'y'])},{int(rng.random() < 0.3)}" for i in range(n)]
    path.write_text("\n".join([*out, *extra]) + "\n")
    return str(path)


def test_three_raw_formats_rerun_from_the_store(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [Dataset("kdd", train=_kdd(tmp_path / "kdd1", rng, 400), test=_kdd(tmp_path / "kdd2", rng, 200)),
            Dataset("cores_iot", train=_cores(tmp_path / "cores", rng, 300)),
            Dataset("netflow", train=str(tmp_path / "missing"), test=str(tmp_path / "missing")),
            Dataset("nothing", sf_dir=str(tmp_path))]
    store, options = Store(spark, str(tmp_path / "store")), {"models": ("sgd",), "batch_sweep": {"sgd": [100]}, "n_trees": 20}
    first = run_all(spark, data, str(tmp_path / "out"), store, **options)
    assert "error" in first["netflow"] and "error" in first["nothing"]      # the others ran
    folder = tmp_path / "project" / "datasets" / "raw" / "netflow"
    folder.mkdir(parents=True)
    _netflow(folder / "train_net.csv", rng, 300)
    _netflow(folder / "test_net.csv", rng, 150)
    data[2] = Dataset("netflow", root=str(tmp_path / "project"))
    second = run_all(spark, data[:3], str(tmp_path / "out2"), store, **options)
    timed = {"warmup_time_sec", "test_time_sec", "total_time_sec", "total_training_time_sec"}
    for name in ("kdd", "cores_iot"):
        assert not first[name]["reused"] and second[name]["reused"]
        a, b = ({k: v for k, v in x[name]["records"]["sgd"][0].items() if k not in timed} for x in (first, second))
        assert a == b
    both = load_corpus(spark, str(tmp_path / "out2"))
    assert {(r.model, r.dataset) for r in both.select("model", "dataset").collect()} == {
        (m, d) for m in ("sgd", "isolation_forest") for d in ("kdd", "cores_iot", "netflow")}
    sweep = both.where("model = 'isolation_forest' and dataset = 'kdd'")
    assert sweep.count() == 12 and sweep.select("contamination").distinct().count() == 12
    assert compare_phase(spark, str(tmp_path / "out2"), str(tmp_path / "report")).count() == 6
    series = spark.read.option("header", "true").csv(str(tmp_path / "report" / "by_contamination"))
    assert series.where("dataset = 'kdd'").count() == 12 and "f1_macro" in series.columns
    prep = data[1].prepare(spark, store)
    learner = load_learner(store, prep, "sgd", {"batch_size": 100, "contamination": 0.45, "seed": 42})
    assert learner.updates > 0 and learner.evaluate(prep.split("test"), None).n == 60
    with pytest.raises(FileNotFoundError):
        load_learner(store, prep, "mlp", {"batch_size": 1})
    # one forest, taken again, scores alike
    s1 = run_stage1(prep, [0.45], 20, store=store)
    s2 = run_stage1(prep, [0.45], 20, store=store)
    assert s2.reused and s1.cutoffs == s2.cutoffs


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = prepare_raw(spark, "kdd", _kdd(tmp_path / "a", rng, 50), _kdd(tmp_path / "b", rng, 50), store=Store(spark, str(tmp_path / "s")))
    assert p.rejected == {"train": 2, "test": 2}
    assert {r.split: r["count"] for r in p.table.groupBy("split").count().collect()} == {"train": 41, "test": 41}   # 0.8 of 51
    # one schema for both: text in a column that was a number in the train file is malformed
    bad = "7,7,a,word,3,x,1"
    p = prepare_raw(spark, "netflow", _netflow(tmp_path / "c", rng, 80), _netflow(tmp_path / "d", rng, 40, [bad]),
                    store=Store(spark, str(tmp_path / "s")))
    assert p.rejected == {"train": 0, "test": 1} and "f_num_0" in p.spec.numeric


def test_raw_draw_does_not_depend_on_splits(spark, tmp_path):
    """Exact copies too are drawn alike under another split size."""
    rng = np.random.default_rng(5)
    path = tmp_path / "cores"
    _cores(path, rng, 400)
    path.write_text(path.read_text() + (path.read_text().split("\n")[0] + "\n") * 300)
    old, keys = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("4k", "8m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        p = prepare_raw(spark, "cores_iot", str(path), store=Store(spark, str(tmp_path / size)))
        keys.append({(r.row_key, r.split, r.ord) for r in p.table.select("row_key", "split", "ord").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert keys[0] == keys[1] and len(keys[0]) == 700


def test_result_files_are_read_by_header(spark, tmp_path):
    from tripwire.sources.readers import find_result_files, load_result_files

    for i in range(60):
        for model, head in (("sgd", "accuracy,f1_macro"), ("mlp", "f1_macro,accuracy,extra")):
            d = tmp_path / "r" / model / f"set{i}"
            d.mkdir(parents=True)
            (d / "x.csv").write_text(f"{head}\n0.{i:02d},0.5{',1' if model == 'mlp' else ''}\n")
    for name, text in (("empty", ""), ("head", "accuracy,f1_macro\n"), ("junk", "\x00\x01\x02\nno,table\n")):
        d = tmp_path / "r" / "odd" / name
        d.mkdir(parents=True)
        (d / "x.csv").write_text(text)
    frames = load_result_files(spark, find_result_files(spark, str(tmp_path / "r")))
    assert len(frames) == 2
    rows = [r for f in frames for r in f.collect()]
    assert len(rows) == 120 and {r.model for r in rows} == {"sgd", "mlp"}
    one = next(r for r in rows if r.model == "sgd" and r.dataset == "set7")
    assert one.accuracy == 0.07 and one.source_file.endswith("set7/x.csv")
    assert not exists(spark, str(tmp_path / "nowhere"))
