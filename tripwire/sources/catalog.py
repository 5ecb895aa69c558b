"""Dataset catalog: where a flow table comes from, how its label is derived,
which columns are features and which are dropped.

Two kinds of entries:

* raw flow formats (NetFlow with a header, KDD and CORES without one) read
  from CSV with an explicit schema;
* driver tables (parquet) mapped onto the same flow model, used by the
  registered queries and the bench.

Every spec carries its label rule as a SQL expression so that the Spark job
and the DuckDB oracle use the very same text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values (must equal the reference for identical semantics) -------
# KDD Cup 99 column order, 41 features then the label.
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate", "label",
]
KDD_CATEGORICAL = ["protocol_type", "service", "flag"]
KDD_DROP = [
    "land", "num_outbound_cmds", "is_host_login", "su_attempted", "wrong_fragment",
    "num_failed_logins", "num_access_files", "rerror_rate", "srv_rerror_rate",
]
NETFLOW_DROP = [
    "FLOW_ID", "ID", "ALERT", "ANALYSIS_TIMESTAMP", "IPV4_SRC_ADDR", "IPV4_DST_ADDR",
    "L4_SRC_PORT", "L4_DST_PORT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN",
    "TOTAL_PKTS_EXP", "TOTAL_BYTES_EXP",
]
CORES_N_FEATURES = 19
CORES_DROP = ["feature_11", "feature_12", "feature_13", "feature_6", "feature_0"]
# Contamination values of the stage-1 sweep and the value whose model is kept.
CONTAMINATION_VALUES = [0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45, 0.5]
DEFAULT_CONTAMINATION = 0.45
RANDOM_STATE = 42
# Batch sizes that each stage-2 model is run with.
BATCH_SWEEP = {"sgd": [25_000], "mlp": [10_000, 15_000, 20_000, 25_000, 30_000], "ensemble": [25_000]}
# Where the raw files lie under a project folder.
RAW_FILES = {
    "netflow": {"train": "datasets/raw/netflow/train_net.csv", "test": "datasets/raw/netflow/test_net.csv"},
    "kdd": {"train": "datasets/raw/kd/kddcup.data.corrected", "test": "datasets/raw/kd/corrected/corrected"},
    "cores_iot": {"file": "datasets/raw/cores-iot/cores_iot.csv"},
}
DEFAULT_BATCH_SIZE = 20_000
# Placeholder strings searched by the profiler.
PLACEHOLDERS = ["?", "-", "NA", "N/A", "null", "None", ""]
# ---------------------------------------------------------------------------

LABEL = "ANOMALY"
#: a result file has at least one of these columns
KNOWN_METRICS = ("accuracy", "f1_macro", "balanced_accuracy")


def _kdd_type(name: str) -> T.DataType:
    if name in KDD_CATEGORICAL or name == "label":
        return T.StringType()
    if name.endswith("_rate"):
        return T.DoubleType()
    return T.LongType()


KDD_SCHEMA = T.StructType([T.StructField(c, _kdd_type(c), True) for c in KDD_COLUMNS])
CORES_SCHEMA = T.StructType(
    [T.StructField(f"feature_{i}", T.DoubleType(), True) for i in range(CORES_N_FEATURES)]
    + [T.StructField(LABEL, T.IntegerType(), True)]
)


@dataclass(frozen=True)
class FlowSpec:
    """A labelled flow table.

    ``label_sql`` turns a raw row into ANOMALY (0 benign, 1 attack);
    ``key_cols`` identify a row and feed the md5 row key used for every
    deterministic draw (sample order, split, batches).
    """

    name: str
    table: str | None
    key_cols: tuple[str, ...]
    label_sql: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    score_col: str | None = None      # a single column used by rule detectors
    derived: tuple[tuple[str, str], ...] = ()   # (name, Spark SQL) feature columns
    defaults: dict = field(default_factory=lambda: {
        "contamination": DEFAULT_CONTAMINATION, "batch_size": DEFAULT_BATCH_SIZE})

    @property
    def features(self) -> list[str]:
        return list(self.numeric) + list(self.categorical)


# Driver tables mapped onto the flow model.
LINEITEM = FlowSpec(
    name="lineitem", table="lineitem",
    key_cols=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"),
    label_sql="CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    numeric=("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_linestatus",),
    drop=("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"),
    score_col="l_extendedprice",
)
EVENTS = FlowSpec(
    name="events", table="events", key_cols=("event_id",),
    label_sql="CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    numeric=("value",), categorical=(), drop=("ts", "props", "user_id", "event_type"),
    score_col="value",
)
ORDERS = FlowSpec(
    name="orders", table="orders", key_cols=("o_orderkey",),
    label_sql="CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    numeric=("o_totalprice",), categorical=("o_orderpriority",),
    drop=("o_custkey", "o_orderdate", "o_orderstatus"), score_col="o_totalprice",
)
CUSTOMER = FlowSpec(
    name="customer", table="customer", key_cols=("c_custkey",),
    label_sql="CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END",
    numeric=("c_acctbal",), categorical=("c_nationkey",),
    drop=("c_name", "c_mktsegment"), score_col="c_acctbal",
)
PART = FlowSpec(
    name="part", table="part", key_cols=("p_partkey",),
    label_sql="CASE WHEN p_size > 25 THEN 1 ELSE 0 END",
    numeric=("p_retailprice",), categorical=("p_brand", "p_type"),
    drop=("p_name", "p_size"), score_col="p_retailprice",
)

EMBED_DIM = 64
EMBEDDINGS = FlowSpec(
    name="embeddings", table="embeddings", key_cols=("vec_id",),
    label_sql="CASE WHEN label = 0 THEN 1 ELSE 0 END",
    numeric=tuple(f"e{i}" for i in range(EMBED_DIM)),
    derived=tuple((f"e{i}", f"CAST(embedding[{i}] AS DOUBLE)") for i in range(EMBED_DIM)),
)

DRIVER_SPECS = {s.name: s for s in (LINEITEM, EVENTS, ORDERS, CUSTOMER, PART, EMBEDDINGS)}


@dataclass(frozen=True)
class RawFormat:
    """A raw CSV flow format of the reference."""

    name: str
    header: bool
    schema: T.StructType | None
    drop: tuple[str, ...]
    categorical: tuple[str, ...]
    label_col: str
    split_mode: str          # 'files' (own train/test files) or 'stratified'
    unseen: str = "zero"     # encoder policy for categories unseen in benign train
    sample_frac: float | None = None   # exact sample of each file before labelling


RAW_FORMATS = {
    # NetFlow: string columns found by type; a bare transform fails on unseen values
    "netflow": RawFormat("netflow", True, None, tuple(NETFLOW_DROP), (), LABEL, "files",
                         "error", 0.8),
    "kdd": RawFormat("kdd", False, KDD_SCHEMA, tuple(KDD_DROP), tuple(KDD_CATEGORICAL),
                     "label", "files", "zero", 0.8),
    "cores_iot": RawFormat("cores_iot", False, CORES_SCHEMA, tuple(CORES_DROP), (),
                           LABEL, "stratified", "zero", None),
}


def get_spec(name: str) -> FlowSpec:
    """Catalog lookup; unknown names raise ``ValueError``."""
    try:
        return DRIVER_SPECS[name]
    except KeyError:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DRIVER_SPECS)}") from None


def get_raw_format(name: str) -> RawFormat:
    try:
        return RAW_FORMATS[name]
    except KeyError:
        raise ValueError(f"unknown raw format {name!r}; known: {sorted(RAW_FORMATS)}") from None


def raw_paths(name: str, root: str) -> dict[str, str]:
    """The raw files of a data set under a project folder."""
    get_raw_format(name)
    return {part: f"{root.rstrip('/')}/{path}" for part, path in RAW_FILES[name].items()}


def dataset_defaults(name: str) -> dict:
    """Contamination and batch size that a data set is run with."""
    if name in RAW_FORMATS:
        return {"contamination": DEFAULT_CONTAMINATION, "batch_size": DEFAULT_BATCH_SIZE}
    return dict(get_spec(name).defaults)


def evaluation_path(root: str, model: str, dataset: str) -> str:
    """Where a model's records on a data set lie."""
    return f"{root.rstrip('/')}/{model}/{dataset}"
