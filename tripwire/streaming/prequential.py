"""Structured Streaming form of the cascade.

The test split lands in one write, one parquet file per batch in a folder
``batch_id=<b>``.  A file-source ``readStream`` with ``maxFilesPerTrigger`` turns
each file, or the next ``FILES_PER_TRIGGER`` files, into one micro-batch, and
``foreachBatch`` runs the very same prequential step as the replay loop, batch by
batch.  Files may arrive in any order: the sink applies a batch when all batches
before it are applied, so the model depends on the batches alone.  With a landing
folder a micro-batch only tells which batches came; each is read from its own folder
when its turn comes, so a step is a scan of one file however many came together.

State (Z3) is a parquet table partitioned by ``batch_id`` with one version per batch;
the versions of a micro-batch are one write, and writing a batch's state replaces
its partition.  After a restart the learner resumes from the last stored
version, batches already applied are skipped and early arrivals are found again, so
a replayed micro-batch does not update the model twice.

Progress (Z5) comes from metrics observed on the stream and a query listener; it
counts micro-batches, so that with a listener each file is one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.learners import Learner, StepResult
from ..session import scratch_path
from ..sources.store import exists, file_system


def write_arrivals(batches, n_batches: int, path: str) -> None:
    """Land all batches in one job, one file each."""
    width = max(1, min(n_batches, 10_000))
    batches.df.drop("segment").repartition(width, "batch_id").write.mode("append").partitionBy("batch_id").parquet(path)


FILES_PER_TRIGGER = 32      # batches of a micro-batch without a listener

#: ``seq`` counts applied batches
STATE_SCHEMA = ("batch_id int, n long, n_flagged long, tn long, fp long, fn long, tp long, "
                "state string, seq int")


class PrequentialSink:
    """``foreachBatch`` body: screen, predict, combine, update, record.

    With ``landing`` (the folder of ``write_arrivals``) batches are applied in order of
    their number, else as they come.  ``tasks`` is the number of partitions of a batch
    that is read from there (its scan's, if not given)."""

    def __init__(self, spark: SparkSession, learner: Learner, state_path: str,
                 flag_col: str = "s1_flag", landing: str | None = None, tasks: int | None = None):
        self.spark = spark
        self.learner = learner
        self.state_path = state_path
        self.flag_col = flag_col
        self.landing = landing
        self.tasks = tasks
        self.unsaved: list[tuple] = []           # versions that the state table lacks
        self.total = StepResult()
        self.applied: set[int] = set()
        self.arrived: set[int] = set()
        self.rows: list[tuple] = []
        self._restore()

    @property
    def last_batch(self) -> int:
        return max(self.applied, default=-1)

    def _restore(self) -> None:
        if not exists(self.spark, self.state_path):
            return                               # no state yet; any other failure is raised
        st = self.spark.read.schema(STATE_SCHEMA).parquet(self.state_path)
        # totals as one aggregate row; only the newest state version is loaded
        tot = st.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp", "n", "n_flagged")],
                     F.max("seq").alias("last")).first()
        if tot is None or tot.last is None:
            return
        self.total.add(StepResult(tot.tn, tot.fp, tot.fn, tot.tp, tot.n, tot.n_flagged))
        self.applied = {r.batch_id for r in st.select("batch_id").collect()}
        latest = st.filter(F.col("seq") == tot.last).select("state").first()
        self.learner.load(json.loads(latest.state))
        if self.landing:                         # what came before the restart
            fs, p = file_system(self.spark, self.landing)
            names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
            self.arrived = {int(n.split("=")[1]) for n in names if n.startswith("batch_id=")} - self.applied

    def __call__(self, df: DataFrame, epoch_id: int) -> None:
        try:
            if self.landing:
                self._take(df, lambda b: self._landed(b, df.schema))
                return
            df = df.persist()                    # read once, so that its rows are observed once
            try:
                self._take(df, lambda b: df.filter(F.col("batch_id") == b))
            finally:
                df.unpersist()
        finally:
            self._save()

    def _landed(self, b: int, schema) -> DataFrame:
        rows = self.spark.read.option("basePath", self.landing).schema(schema).parquet(f"{self.landing}/batch_id={b}")
        return rows.coalesce(self.tasks) if self.tasks else rows

    def _take(self, df: DataFrame, rows_of) -> None:
        here = {r.batch_id for r in df.select("batch_id").distinct().collect()}
        self.arrived |= here - self.applied      # a replayed micro-batch is already applied
        while self.arrived:
            b = min(self.arrived)
            if self.landing and b != self.last_batch + 1:
                break                            # an earlier batch is still to come
            self._apply(b, rows_of(b))

    def _apply(self, b: int, rows: DataFrame) -> None:
        res = self.learner.step(rows, self.flag_col)
        self.total.add(res)
        self.applied.add(b)
        self.arrived.discard(b)
        row = (b, res.n, res.n_flagged, res.tn, res.fp, res.fn, res.tp)
        self.rows.append(row)
        self.unsaved.append((*row, json.dumps(self.learner.state()), len(self.applied)))

    def _save(self) -> None:
        """The versions since the last write, each in place of its batch's partition."""
        if self.unsaved:
            state = self.spark.createDataFrame(self.unsaved, STATE_SCHEMA)
            state.coalesce(len(self.unsaved)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("batch_id").parquet(self.state_path)
            self.unsaved = []


class Progress(StreamingQueryListener):
    """Observed metrics of every ``every``-th micro-batch: (micro-batch, rows, flagged)."""

    def __init__(self, every: int = 10):
        self.every = every
        self.seen: list[tuple[int, int, int]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get("arrivals")
        if got is not None and got.rows and (event.progress.batchId + 1) % self.every == 0:
            self.seen.append((event.progress.batchId, got.rows, got.flagged))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def stream(spark: SparkSession, schema, src: str, sink: PrequentialSink, ckpt: str, flag_col: str = "s1_flag",
           files: int = 1):
    """The query over a landing folder, ``files`` files per micro-batch, until all is read."""
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src)
    observed = arrivals.observe("arrivals", F.count(F.lit(1)).alias("rows"),
                                F.coalesce(F.sum(F.col(flag_col).cast("long")), F.lit(0)).alias("flagged"))
    q = observed.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_stream(spark: SparkSession, batches, n_batches: int, learner: Learner,
               run_id: str | None = None, progress: Progress | None = None) -> tuple[StepResult, float, list]:
    """Land arrivals, stream them through the prequential sink."""
    run_id = run_id or uuid.uuid4().hex[:12]
    src = scratch_path(spark, f"stream-src-{run_id}")
    ckpt = scratch_path(spark, f"stream-ckpt-{run_id}")
    state = scratch_path(spark, f"stream-state-{run_id}")
    write_arrivals(batches, n_batches, src)
    sink = PrequentialSink(spark, learner, state, landing=src, tasks=batches.tasks)
    t0 = time.time()
    if progress:
        spark.streams.addListener(progress)
    try:
        stream(spark, batches.df.drop("segment").schema, src, sink, ckpt, files=1 if progress else FILES_PER_TRIGGER)
    finally:
        if progress:
            spark.streams.removeListener(progress)
    return sink.total, time.time() - t0, sink.rows
