"""Stage-2 online learners.

A learner keeps its parameters on the driver (a few thousand doubles at most).
Rows never leave the executors: a step predicts a batch with the parameters from
before it and then updates them from sums over all of the batch's flagged rows,
so a batch may have any size and a model does not depend on how its rows are
partitioned (up to the order of floating-point sums).

* ``SGDLogistic``: logistic loss with L2 (alpha 1e-4).  One aggregation gives a
  batch's confusion counts, gradient and squared feature sums; one synchronous
  step follows, every coordinate divided by a bound of its curvature (the
  Hessian is at most (d + 1) / 4 times the diagonal of squares, so the loss of
  the batch cannot rise).  The first pass takes ``warm_steps`` such steps.
* ``OnlineMLP``: a network with one hidden layer (100 units), warm-started from
  the weights of the batch before; every iteration sums the gradient of all
  partitions (``networks``).
* ``SEAPool``: up to 5 networks (50 units) each fitted from scratch on one batch
  (at most 30 iterations); majority vote with ties to attack; a full pool
  replaces its least accurate member on the new batch (first on ties);
  single-class batches and fits without finite weights change nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.metrics import confusion_aggs
from ..sources.catalog import LABEL
from . import networks


@dataclass
class StepResult:
    tn: int = 0
    fp: int = 0
    fn: int = 0
    tp: int = 0
    n: int = 0
    n_flagged: int = 0

    def add(self, other: StepResult) -> None:
        for k in ("tn", "fp", "fn", "tp", "n", "n_flagged"):
            setattr(self, k, getattr(self, k) + getattr(other, k))


def _total(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


class Learner:
    """L1: ``warmup(df)``, ``step(batch_df) -> StepResult`` (predict with
    the parameters before the batch, then update on its flagged rows),
    ``hyperparams()``; ``state()`` / ``load(state)`` for persistence."""

    name = "learner"

    def __init__(self, features: Sequence[str], seed: int = 42):
        self.features = list(features)
        self.seed = seed
        self.updates = 0

    def hyperparams(self) -> dict:
        return {}

    def _flag(self, flag_col: str | None) -> Column:
        return F.col(flag_col) == 1 if flag_col else F.lit(True)

    def _rows(self, df: DataFrame, flag_col: str | None) -> DataFrame:
        return df.select(*self.features, LABEL, *([flag_col] if flag_col else []))

    def _aggs(self, pred: Column, flag: Column) -> list[Column]:
        """the cascade's prediction is the learner's on flagged rows, 0 elsewhere."""
        missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in self.features]
        anywhere = F.lit(False)
        for m in missing:
            anywhere = anywhere | m
        return [*confusion_aggs(F.col(LABEL), F.when(flag, pred).otherwise(0)), F.count(F.lit(1)).alias("n"),
                _total(flag).alias("n_flagged"), _total(flag & (F.col(LABEL) == 1)).alias("n_pos"),
                _total(anywhere).alias("n_bad")]

    @staticmethod
    def _result(row) -> StepResult:
        if row.n_bad:
            raise ValueError("null or NaN features: impute or drop such rows before stage 2")
        return StepResult(*(row[k] or 0 for k in ("tn", "fp", "fn", "tp", "n", "n_flagged")))

    # -- override
    def state(self) -> dict: ...
    def load(self, state: dict) -> None: ...
    def evaluate(self, df: DataFrame, flag_col: str | None = "s1_flag") -> StepResult: ...
    def step(self, batch: DataFrame, flag_col: str | None = "s1_flag", rows: int | None = None) -> StepResult: ...
    def warmup(self, flagged_train: DataFrame) -> int: ...

    def replay(self, batches, n_batches: int) -> Iterator[StepResult]:
        """``step`` over the batches of a batch table, in order."""
        for b in range(n_batches):
            yield self.step(batches.batch(b))

    def _warned(self, n: int) -> int:
        if not n:
            warnings.warn("no flagged training rows: the learner starts without a warm-up", stacklevel=3)
        return n


class SGDLogistic(Learner):
    """L2: online logistic regression, one synchronous step per batch."""

    name = "sgd_classifier"
    alpha = 1e-4

    def __init__(self, features, seed: int = 42, warm_steps: int = 6):
        super().__init__(features, seed)
        self.warm_steps = warm_steps
        self.params = np.zeros(len(self.features) + 1)   # weights, intercept
        self._sums: dict[tuple, list[Column]] = {}       # aggregates of a pass, the same for every batch

    def hyperparams(self):
        return {"loss": "log_loss", "random_state": self.seed}

    def state(self):
        return {"params": [float(v) for v in self.params], "updates": self.updates}

    def load(self, state):
        self.params = np.asarray(state["params"], dtype=np.float64)
        self.updates = int(state["updates"])

    @cached_property
    def _inputs(self) -> Column:
        return F.array(*[F.col(c).cast("double") for c in self.features]).cast("array<double>")

    def margin(self) -> Column:
        """The intercept plus the weighted features ``_x``, from left to right.  The weights are
        one array, so a plan's generated code is the same for every batch and compiled once."""
        *w, z = (f"double('{float(v)!r}')" for v in self.params)
        return F.expr(f"aggregate(zip_with(_x, CAST(array({', '.join(w)}) AS array<double>), (x, w) -> w * x), {z}, (z, x) -> z + x)")

    def _pass_aggs(self, flag_col: str | None, train: bool) -> list[Column]:
        if (flag_col, train) not in self._sums:
            flag = self._flag(flag_col)
            aggs = self._aggs((F.col("_z") > 0).cast("int"), flag)
            if train:
                r = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))) - F.col(LABEL)
                xs = [F.col(c).cast("double") for c in self.features] + [F.lit(1.0)]
                aggs += [F.sum(F.when(flag, r * x)).alias(f"_g{i}") for i, x in enumerate(xs)]
                aggs += [F.sum(F.when(flag, x * x)).alias(f"_s{i}") for i, x in enumerate(xs)]
            self._sums[flag_col, train] = aggs
        return self._sums[flag_col, train]

    def _pass(self, df: DataFrame, flag_col: str | None, train: bool) -> StepResult:
        rows = self._rows(df, flag_col).withColumn("_x", self._inputs).withColumn("_z", self.margin())
        row = rows.agg(*self._pass_aggs(flag_col, train)).first()
        res = self._result(row)
        if train and res.n_flagged:
            k, d1 = res.n_flagged, len(self.params)
            g = np.array([row[f"_g{i}"] for i in range(d1)]) / k
            s = np.array([row[f"_s{i}"] for i in range(d1)]) / k
            ridge = np.full(d1, self.alpha)
            ridge[-1] = 0.0                              # the intercept is not shrunk
            curvature = d1 / 4 * s + ridge
            self.params = self.params - np.divide(g + ridge * self.params, curvature,
                                                  out=np.zeros(d1), where=curvature > 0)
            self.updates += 1
        return res

    def warmup(self, flagged_train: DataFrame) -> int:
        """``warm_steps`` steps over the flagged training rows."""
        n = 0
        for _ in range(self.warm_steps):
            n = self._pass(flagged_train, None, train=True).n
            if not n:
                break
        return self._warned(n)

    def step(self, batch, flag_col="s1_flag", rows=None):
        """Screen → predict flagged → combine (0 elsewhere) → update."""
        return self._pass(batch, flag_col, train=True)

    def evaluate(self, df, flag_col="s1_flag"):
        return self._pass(df, flag_col, train=False)


class Network:
    """One hidden layer and a two-way output over named feature columns."""

    tol = 1e-4                               # of a fit from scratch; a warm start takes all its iterations

    def __init__(self, features: Sequence[str], hidden: int, seed: int, iterations: int, weights: Sequence[float] | None = None):
        self.features, self.hidden, self.seed, self.iterations = list(features), hidden, seed, iterations
        self.weights = None if weights is None else np.array(weights, dtype=np.float64)

    @property
    def width(self) -> int:
        """Doubles of a packed row."""
        return len(self.features) + 1

    def packed(self, rows: DataFrame, key: Column | None = None) -> DataFrame:
        return networks.pack(rows, self.features, LABEL, F.lit(0) if key is None else key)

    def start(self, spark) -> np.ndarray:
        return networks.start_weights(spark, len(self.features), self.hidden, self.seed) if self.weights is None else self.weights

    def fit(self, rows: DataFrame, iterations: int | None = None) -> bool:
        """Fit, or go on from the present weights; False (and no change) without finite weights."""
        blocks = self.packed(rows).persist()
        try:
            w = networks.fit_together(blocks, self.width, {0: self.start(rows.sparkSession)}, iterations or self.iterations,
                                      self.tol if self.weights is None else 0.0)[0]
        finally:
            blocks.unpersist()
        if not np.isfinite(w).all():
            return False
        self.weights = w
        return True

    def predicted(self) -> Column:
        """The class of a row."""
        w, width = self.weights, self.width

        @F.pandas_udf("int")
        def predict(*cols: pd.Series) -> pd.Series:
            rows = np.zeros((len(cols[0]), width))
            for i, c in enumerate(cols):
                rows[:, i] = c.to_numpy(dtype=np.float64)
            return pd.Series(networks.predictions(w, rows))

        return predict(*[F.col(c).cast("double") for c in self.features])


def _census(learner: Learner, batches) -> dict[int, Row]:
    """Counts of every batch with 0 predicted throughout, from one scan of the batch table."""
    aggs = learner._aggs(F.lit(0), learner._flag("s1_flag"))
    out = {r.batch_id: r for r in batches.df.groupBy("batch_id").agg(*aggs).collect()}
    for r in out.values():
        learner._result(r)                       # raises on gaps before any step
    return out


def _counted(row, fp: int, tp: int) -> StepResult:
    """A batch's counts when ``fp`` and ``tp`` of its flagged rows are called."""
    res = Learner._result(row)
    return StepResult(res.tn - fp, fp, res.fn - tp, tp, res.n, res.n_flagged)


class OnlineMLP(Learner):
    """L3: one hidden layer, a few iterations from the last weights per update."""

    name = "mlp_classifier"

    def __init__(self, features, seed: int = 42, hidden: int = 100, warm_iterations: int = 20, step_iterations: int = 2):
        super().__init__(features, seed)
        self.warm_iterations, self.step_iterations = warm_iterations, step_iterations
        self.net = Network(self.features, hidden, seed, step_iterations)

    def hyperparams(self):
        return {"hidden_layer_sizes": f"({self.net.hidden},)", "activation": "logistic",
                "solver": "l-bfgs", "random_state": self.seed, "max_iter": self.step_iterations}

    @property
    def params(self) -> np.ndarray | None:
        return self.net.weights

    def state(self):
        return {"params": None if self.params is None else [float(v) for v in self.params], "updates": self.updates}

    def load(self, state):
        self.updates = int(state["updates"])
        self.net.weights = None if state["params"] is None else np.array(state["params"], dtype=np.float64)

    def evaluate(self, df, flag_col="s1_flag"):
        rows = self._rows(df, flag_col).withColumn("_p", F.lit(0) if self.params is None else self.net.predicted())
        return self._result(rows.agg(*self._aggs(F.col("_p"), self._flag(flag_col))).first())

    def step(self, batch, flag_col="s1_flag", rows=None):
        res = self.evaluate(batch, flag_col)
        if res.n_flagged and self.net.fit(self._rows(batch, flag_col).where(self._flag(flag_col))):
            self.updates += 1
        return res

    def replay(self, batches, n_batches):
        """A step needs the weights of the one before it, so the batches of a segment go one after
        the other through one task, where a batch is a task's rows anyway."""
        if batches.tasks > 1:
            yield from super().replay(batches, n_batches)
            return
        census = _census(self, batches)
        for first in range(0, n_batches, batches.seg):
            keys = range(first, min(first + batches.seg, n_batches))
            called = self._segment(batches, first) if any(census[b].n_flagged for b in keys if b in census) else {}
            for b in keys:
                yield _counted(census[b], *called.get(b, (0, 0))) if b in census else StepResult()

    def _segment(self, batches, first: int) -> dict[int, tuple[int, int]]:
        """Steps over the batches of a segment: (fp, tp) of each; the weights go on."""
        flagged = batches.segment(first).where(self._flag("s1_flag"))
        width, iterations, tol, given = self.net.width, self.net.iterations, self.net.tol, self.params
        start = self.net.start(flagged.sparkSession)

        def run(it):
            w = given
            for key, rows in networks.by_key(it, width):
                said = np.zeros(len(rows)) if w is None else networks.predictions(w, rows)
                new = networks.fitted(start if w is None else w, rows, iterations, tol if w is None else 0.0)
                moved = bool(np.isfinite(new).all())
                w = new if moved else w
                fp, tp = int(((said == 1) & (rows[:, -1] == 0)).sum()), int(((said == 1) & (rows[:, -1] == 1)).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int32()), pa.array([fp], pa.int64()), pa.array([tp], pa.int64()), pa.array([moved]),
                     pa.array([None if w is None else w.tobytes()], pa.binary())], names=["key", "fp", "tp", "moved", "w"])

        blocks = networks.in_order(self.net.packed(flagged, F.col("batch_id")))
        got = blocks.mapInArrow(run, "key int, fp long, tp long, moved boolean, w binary").orderBy("key").collect()
        self.updates += sum(r.moved for r in got)
        if got and got[-1].w is not None:
            self.net.weights = np.frombuffer(bytes(got[-1].w), dtype=np.float64)
        return {r.key: (r.fp, r.tp) for r in got}

    def warmup(self, flagged_train: DataFrame) -> int:
        """The first pass over the flagged training rows."""
        n = self.evaluate(flagged_train, None).n
        if n and self.net.fit(self._rows(flagged_train, None), self.warm_iterations):
            self.updates += 1
        return self._warned(n)


# ---------------------------------------------------------------- pool rules
def pool_vote(members: Sequence[Column]) -> Column:
    """Mean of hard votes >= 0.5 (ties → attack); an empty pool says 0."""
    if not members:
        return F.lit(0)
    votes = members[0]
    for m in members[1:]:
        votes = votes + m
    return (votes / F.lit(len(members)) >= 0.5).cast("int")


def member_accuracy(members: Sequence[Column], flag: Column | None = None) -> Column:
    """Every member's share of right votes on the flagged rows, as an array in pool order."""
    flag = F.lit(True) if flag is None else flag
    return F.array(*[F.avg(F.when(flag, (m == F.col(LABEL)).cast("double"))) for m in members])


def replaced_slot(accuracy: Column) -> Column:
    """The member with the lowest accuracy, the first one on ties."""
    return (F.array_position(accuracy, F.array_min(accuracy)) - 1).cast("int")


def warmup_chunks(indexed: DataFrame, n: int, size: int, index: str = "_w", name: str = "_chunk") -> DataFrame:
    """``size`` consecutive chunks of max(1, n // size) of the ``n`` rows; the rest is left out."""
    chunk = F.floor(F.col(index) / F.lit(max(1, n // size))).cast("int")
    return indexed.withColumn(name, chunk).where(F.col(name) < size)


@dataclass
class SEAPool(Learner):
    """Streaming ensemble of small networks."""

    features: list = field(default_factory=list)
    seed: int = 42
    size: int = 5
    hidden: int = 50
    max_iter: int = 30
    name: str = "dynamic_ensemble"

    def __post_init__(self):
        self.members: list[Network] = []
        self.updates = 0

    def _member(self, weights: Sequence[float] | None = None, ahead: int = 0) -> Network:
        return Network(self.features, self.hidden, self.seed + self.updates + ahead, self.max_iter, weights)

    def state(self):
        return {"members": [m.weights.tolist() for m in self.members], "updates": self.updates}

    def load(self, state):
        self.updates = int(state["updates"])
        self.members = [self._member(w) for w in state["members"]]

    def hyperparams(self):
        return {"pool_size": self.size, "base_hidden_layers": f"({self.hidden},)",
                "base_activation": "logistic", "base_solver": "l-bfgs", "base_max_iter": self.max_iter}

    def _screen(self, df: DataFrame, flag_col: str | None):
        """One pass: pool predictions (cascade counts), the slot to replace and class presence."""
        rows, flag = self._rows(df, flag_col), self._flag(flag_col)
        rows = rows.select("*", *[m.predicted().alias(f"_m{i}") for i, m in enumerate(self.members)])
        votes = [F.col(f"_m{i}") for i in range(len(self.members))]
        aggs = self._aggs(pool_vote(votes), flag)
        if votes:
            aggs.append(replaced_slot(member_accuracy(votes, flag)).alias("slot"))
        row = rows.agg(*aggs).first()
        return self._result(row), row.n_pos, row.slot if votes else None

    def _join(self, new: Network, slot: int | None) -> None:
        """A fitted member joins the pool or takes a slot."""
        if len(self.members) < self.size:
            self.members.append(new)
        else:
            self.members[slot] = new
        self.updates += 1

    def step(self, batch, flag_col="s1_flag", rows=None):
        res, n_pos, slot = self._screen(batch, flag_col)
        if 0 < n_pos < res.n_flagged:               # single-class batch: no-op
            new = self._member()
            if new.fit(self._rows(batch, flag_col).where(self._flag(flag_col))):
                self._join(new, slot)               # a fit without finite weights is a no-op
        return res

    def _fitted(self, spark, fit, keys: Sequence[int]) -> dict[int, Network]:
        """A new member for each key, in their order.  A fit sees neither the pool nor another
        fit, so all run side by side (``fit``: starting weights by key to weights by key); one
        without finite weights is a no-op, and those after it start from the seed before theirs."""
        out, todo = {}, list(keys)
        while todo:
            new = {k: self._member(ahead=len(out) + i) for i, k in enumerate(todo)}
            got = fit({k: m.start(spark) for k, m in new.items()})
            bad = next((i for i, k in enumerate(todo) if not np.isfinite(got[k]).all()), len(todo))
            for k in todo[:bad]:
                new[k].weights = got[k]
                out[k] = new[k]
            todo = todo[bad + 1:]
        return out

    def replay(self, batches, n_batches):
        """The members of a segment's batches are fitted side by side; votes and replacements
        then go through its batches in order."""
        if batches.tasks > 1:
            yield from super().replay(batches, n_batches)
            return
        census = _census(self, batches)
        for first in range(0, n_batches, batches.seg):
            keys = [b for b in range(first, min(first + batches.seg, n_batches)) if b in census]
            called = self._segment(batches, first, [b for b in keys if 0 < census[b].n_pos < census[b].n_flagged]) \
                if any(census[b].n_flagged for b in keys) else {}
            for b in range(first, min(first + batches.seg, n_batches)):
                yield _counted(census[b], *called.get(b, (0, 0))) if b in census else StepResult()

    def _segment(self, batches, first: int, mixed: Sequence[int]) -> dict[int, tuple[int, int]]:
        """Steps over the batches of a segment (``mixed``: those of both classes): (fp, tp) of each."""
        flagged = batches.segment(first).where(self._flag("s1_flag"))
        net = self._member()
        width, iterations, tol, size = net.width, net.iterations, net.tol, self.size
        blocks = net.packed(flagged, F.col("batch_id")).persist()
        try:
            new = self._fitted(flagged.sparkSession, lambda starts: networks.fit_apart(blocks, width, starts, iterations, tol), mixed)
            pool, fits = [m.weights for m in self.members], {k: m.weights for k, m in new.items()}

            def run(it):
                now = list(pool)
                for key, rows in networks.by_key(it, width):
                    y = rows[:, -1]
                    said = [networks.predictions(w, rows) for w in now]
                    call = np.mean(said, axis=0) >= 0.5 if said else np.zeros(len(y), dtype=bool)
                    slot = int(np.argmin([(v == y).mean() for v in said])) if said else -1
                    if key in fits:
                        if len(now) < size:
                            now.append(fits[key])
                        else:
                            now[slot] = fits[key]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.int32()), pa.array([int((call & (y == 0)).sum())], pa.int64()),
                         pa.array([int((call & (y == 1)).sum())], pa.int64()), pa.array([slot], pa.int32())],
                        names=["key", "fp", "tp", "slot"])

            got = networks.in_order(blocks).mapInArrow(run, "key int, fp long, tp long, slot int").orderBy("key").collect()
        finally:
            blocks.unpersist()
        for r in got:
            if r.key in new:
                self._join(new[r.key], r.slot)
        return {r.key: (r.fp, r.tp) for r in got}

    def warmup(self, flagged_train: DataFrame, order_col: str = "row_key") -> int:
        """Five consecutive chunks in arrival order, each through the same update.  The
        rows are written once by chunk; the chunks' members are fitted side by side, a job
        for a round of all."""
        from ..functions.rowkey import ordered_index
        from ..session import scratch_path

        spark = flagged_train.sparkSession
        indexed = ordered_index(flagged_train.select(order_col, *self.features, LABEL), [order_col], name="_w")
        n = indexed.count()
        path = scratch_path(spark, f"warmup-{id(self):x}-{self.updates}")
        warmup_chunks(indexed, n, self.size).drop("_w", order_col).write.mode("overwrite").partitionBy("_chunk").parquet(path)
        if n:
            chunks = spark.read.parquet(path)
            # one job gives each chunk's class mix; a single-class chunk is a no-op
            mix = {r["_chunk"]: r for r in chunks.groupBy("_chunk").agg(
                F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("n_pos")).collect()}
            net, mixed = self._member(), [i for i in sorted(mix) if 0 < mix[i].n_pos < mix[i].n]
            blocks = net.packed(chunks, F.col("_chunk")).persist()
            try:
                new = self._fitted(spark, lambda starts: networks.fit_together(blocks, net.width, starts, net.iterations, net.tol), mixed)
            finally:
                blocks.unpersist()
            for i in mixed:
                if i in new:
                    # the pool is not full during a learner's first warm-up; later ones replace by accuracy
                    slot = None if len(self.members) < self.size else self._screen(chunks.where(F.col("_chunk") == i), None)[2]
                    self._join(new[i], slot)
        return self._warned(n)

    def evaluate(self, df, flag_col="s1_flag"):
        return self._screen(df, flag_col)[0]


LEARNERS = {"sgd": SGDLogistic, "mlp": OnlineMLP, "ensemble": SEAPool}


def make_learner(kind: str, features: Sequence[str], seed: int = 42) -> Learner:
    if kind == "ensemble":
        return SEAPool(features=list(features), seed=seed)
    return LEARNERS[kind](features, seed)
