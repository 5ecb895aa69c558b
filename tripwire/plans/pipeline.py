"""Preparation pipeline: flow table → row key → stratified split → arrival
order → encoders and scaler fitted on benign train → prepared table.

The prepared table has one row per flow: ``row_key, split, ord, ANOMALY``
and the scaled features.  It is the single hand-over to stage 1 and 2 (benign
train is a filter).  It is written partitioned by ``split`` with a manifest of its
parameters, and plans that ask for the same table read it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep
from ..sources.catalog import LABEL, RANDOM_STATE, FlowSpec
from ..functions.selection import key_prefix
from ..session import materialize as write_back
from ..sources.readers import ensure_parallel, flow_frame
from ..sources.store import Store, file_state

TEST_SIZE = 0.2


@dataclass
class Prepared:
    spec: FlowSpec
    table: DataFrame                 # row_key, split, ord, ANOMALY, features...
    encoding: prep.OrdinalEncoding
    scaling: prep.RobustScaling
    n_benign_train: int | None = None
    folder: str | None = None        # where it lies in the store
    rejected: dict = field(default_factory=dict)   # malformed raw lines per file

    @property
    def features(self) -> list[str]:
        return self.spec.features

    def split(self, name: str) -> DataFrame:
        return self.table.filter(F.col("split") == name)

    def benign_train(self) -> DataFrame:
        return self.table.filter((F.col("split") == "train") & (F.col(LABEL) == 0))


def keyed_flows(spark: SparkSession, sf_dir: str, spec: FlowSpec,
                seed: int = RANDOM_STATE, materialize: bool = True) -> DataFrame:
    """Flow rows with their md5 key, label and declared features only.

    The key costs a string hash per row and every later step (class counts,
    cut-off selection, encoder and scaler fits, scoring) rescans these rows,
    so they are written once to the shared checkpoint folder; this also
    cuts the lineage for executor-loss recovery.
    """
    df = flow_frame(spark, sf_dir, spec)
    raw_cols = sorted({c for c in df.columns if any(c in k for k in spec.key_cols)}
                      | set(spec.features) | {LABEL})
    df = df.select(*raw_cols)
    if materialize:
        df = ensure_parallel(df)      # no-op for a large table; spreads one row group
    df = prep.with_row_key(df, spec.key_cols, seed)
    df = prep.drop_null_label(df.select("row_key", LABEL, *spec.features))
    if materialize:
        df = write_back(df.withColumn("row_pfx", key_prefix("row_key")), f"keyed-{spec.name}")
    return df


def _draw(spark: SparkSession, sf_dir: str, spec: FlowSpec, **params) -> dict:
    """What a prepared table depends on: the rows, the declaration and the parameters."""
    source = f"{sf_dir.rstrip('/')}/{spec.table}.parquet"
    return {"source": source, "files": file_state(spark, source), "keys": spec.key_cols, "label": spec.label_sql,
            "numeric": spec.numeric, "categorical": spec.categorical, "derived": spec.derived, **params}


def split_flows(spark: SparkSession, sf_dir: str, spec: FlowSpec, test_size: float = TEST_SIZE,
                seed: int = RANDOM_STATE, store: Store | None = None) -> DataFrame:
    """P2 + arrival order: ``split``, and ``ord`` (md5 order) on test rows.

    Train rows are never streamed, so they keep a null ``ord``; only the
    test split goes through the distributed sort.  The table is written once
    per data set and parameters, partitioned by split, and read by later plans.
    """
    return split_flows_quota(spark, sf_dir, spec, test_size, seed, store)[0]


def split_flows_quota(spark: SparkSession, sf_dir: str, spec: FlowSpec, test_size: float = TEST_SIZE,
                      seed: int = RANDOM_STATE, store: Store | None = None):
    store = store or Store(spark)
    folder = store.folder("split", spec.name, _draw(spark, sf_dir, spec, test_size=test_size, seed=seed))
    held = store.manifest(folder)
    if held is None:
        base = keyed_flows(spark, sf_dir, spec, seed)
        split, quota = prep.stratified_split_quota(base, test_size)
        train = split.filter(F.col("split") == "train").withColumn("ord", F.lit(None).cast("long"))
        test = prep.replay_order(split.filter(F.col("split") == "test"))
        store.write_split({"train": train, "test": test}, folder)
        held = {"columns": train.columns, "quota": [[k, n] for k, n in quota.items()]}
        store.finish(folder, held)
    return store.read_split(folder, held["columns"]), {k: n for k, n in held["quota"]}


def prepare(spark: SparkSession, sf_dir: str, spec: FlowSpec, test_size: float = TEST_SIZE, seed: int = RANDOM_STATE,
            unseen: str = "zero", store: Store | None = None) -> Prepared:
    """The processed table of a driver table; written once per data set and parameters."""
    store = store or Store(spark)
    draw = _draw(spark, sf_dir, spec, test_size=test_size, seed=seed, unseen=unseen)

    def make() -> Prepared:
        ordered, quota = split_flows_quota(spark, sf_dir, spec, test_size, seed, store)
        return finish(ordered, spec, unseen, quota.get(0, 0))

    return stored(store, spec, draw, make)


def stored(store: Store, spec: FlowSpec, draw: dict, make) -> Prepared:
    """The processed table of ``draw`` from the store, or made, written and read back."""
    folder = store.folder("processed", spec.name, draw)
    held = store.manifest(folder)
    if held is None:
        p = make()
        store.write_split({name: p.split(name) for name in ("train", "test")}, folder)
        enc = p.encoding
        if enc.columns:
            enc.dictionary.write.mode("overwrite").parquet(f"{folder}/encoder")
        held = {"columns": p.table.columns, "n_benign_train": p.n_benign_train, "unseen": enc.unseen, "sizes": enc.sizes,
                "rows": enc.rows, "medians": p.scaling.medians, "scales": p.scaling.scales, "params": draw,
                "features": [list(p.spec.numeric), list(p.spec.categorical)], "rejected": p.rejected}
        store.finish(folder, held)
    numeric, categorical = held["features"]
    spec = replace(spec, numeric=tuple(numeric), categorical=tuple(categorical))
    dictionary = store.spark.read.parquet(f"{folder}/encoder") if held["sizes"] else None
    return Prepared(spec, store.read_split(folder, held["columns"]),
                    prep.OrdinalEncoding(list(held["sizes"]), dictionary, held["sizes"], held["rows"], held["unseen"]),
                    prep.RobustScaling(held["medians"], held["scales"]), held["n_benign_train"], folder, held["rejected"])


def finish(ordered: DataFrame, spec: FlowSpec, unseen: str = "zero",
           n_benign_train: int | None = None) -> Prepared:
    """Fit encoder and scaler on benign train rows, transform every row.

    ``ordered`` holds ``row_key, split, ord, ANOMALY`` and the features."""
    benign_train = ordered.filter((F.col("split") == "train") & (F.col(LABEL) == 0))
    features = spec.features
    # the encoder (one count job) and the numeric quartiles (exact-percentile
    # passes) read the same benign rows and are independent: run them together
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=2) as pool:
        enc_f = pool.submit(prep.fit_ordinal, benign_train, spec.categorical, unseen)
        num_f = pool.submit(prep.fit_robust, benign_train, list(spec.numeric))
        encoding, num_scaling = enc_f.result(), num_f.result()
    cat_scaling = prep.fit_robust(benign_train, list(spec.categorical), encoding)
    scaling = prep.RobustScaling({**num_scaling.medians, **cat_scaling.medians},
                                 {**num_scaling.scales, **cat_scaling.scales})
    encoded = encoding.transform(ordered)
    table = scaling.transform(encoded).select("row_key", "split", "ord", LABEL, *features)
    if n_benign_train is None:
        n_benign_train = benign_train.count()
    return Prepared(spec, table, encoding, scaling, n_benign_train)
