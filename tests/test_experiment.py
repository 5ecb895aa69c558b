"""Entry A (experiment) and entry C (comparison) on the smallest tables."""

import os

from pyspark.sql import functions as F

from tripwire.operators import compare
from tripwire.plans.experiment import compare_phase, run_experiment
from tripwire.sources.readers import find_result_files


def test_experiment_then_compare(spark, sf_dir, tmp_path):
    out = str(tmp_path / "evaluation")
    summary = run_experiment(spark, sf_dir, out, models=("sgd", "ensemble"),
                             batch_sweep={"sgd": [300, 500], "ensemble": [600]})
    assert len(summary["records"]["sgd"]) == 2            # L9: one record per size
    files = find_result_files(spark, out).collect()
    assert {(r.model, r.dataset) for r in files} == {
        ("isolation_forest", "lineitem"), ("sgd", "lineitem"), ("ensemble", "lineitem")}
    best = compare_phase(spark, out, str(tmp_path / "report"))
    rows = best.collect()
    assert len(rows) == 3
    assert "total_time_sec" in best.columns                # elapsed_sec renamed (F11)
    md = open([os.path.join(dp, f) for dp, _, fs in os.walk(tmp_path / "report" / "summary.md")
               for f in fs if f.startswith("part-")][0]).read()
    assert "| model | dataset |" in md and "N/A" in md     # stage-1 has no balanced accuracy


def test_missing_results_dir(spark, tmp_path):
    assert find_result_files(spark, str(tmp_path / "nope")).count() == 0
    assert compare_phase(spark, str(tmp_path / "nope"), str(tmp_path / "r")) is None


def test_report_helpers(spark):
    df = spark.createDataFrame(
        [("isolation_forest", "a", 0.5, None, 3.0), ("sgd", "a", 0.7, 2.0, None),
         ("mlp", "a", 0.7, 1.0, None)],
        "model string, dataset string, f1_macro double, total_time_sec double, elapsed_sec double")
    assert compare.exclude_stage1(df).count() == 2
    t = {r.model: r.time_sec for r in compare.time_fallback(df).collect()}
    assert t == {"isolation_forest": 3.0, "sgd": 2.0, "mlp": 1.0}
    assert compare.best_model_by_name(df).first().best_model == "mlp"   # tie → by name
    assert compare.config_lookup(df, "f1_macro", 0.7).first().model == "mlp"
    names = {r.model_display for r in compare.display_names(df, {"sgd": "SGD"}).collect()}
    assert names == {"SGD", "mlp", "isolation_forest"}
    tab = compare.model_table(df, ["f1_macro", "batch_size"]).collect()
    assert all(r.batch_size == "-" for r in tab)
