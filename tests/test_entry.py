import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert r["total_processed"] == r["support_normal"] + r["support_anomaly"]
    # cascade identity (G2): stage-2 calls = rows flagged by the forest
    assert r["stage2_calls"] <= r["total_processed"]
    assert r["confusion_tn"] + r["confusion_fp"] + r["confusion_fn"] + r["confusion_tp"] == \
        r["total_processed"]
