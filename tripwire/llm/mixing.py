"""Mixing sources to target weights by temperature (operator 10, native).

Token shares of the sources are raised to an exponent t in [0, 1] and
normalised.  t is the largest exponent whose entropy reaches
``entropy_share`` of the maximum, raised further if some source would be
repeated more than ``most_epochs`` times.  The weights are realised as budgeted
block permutations: a source of quota Q passes floor(Q / tokens) whole epochs,
and of one more epoch as many documents as the rest of the quota holds, blocks
in permuted order and documents in permuted order within the block that is cut.

* One scan counts tokens per (source, block).  A source has at most ``BLOCKS``
  blocks, so the window over blocks holds ``BLOCKS`` rows per source even if
  one source has a third of all rows; only the blocks that are cut (one per
  source) are ordered document by document.
* What is taken is kept as one bit a block, ``GROUP`` blocks to a row: a few
  rows per source, which Spark broadcasts unless there are very many sources.
  The documents then meet them where they are read; no text is shuffled.
* t comes from a section search: each round evaluates ``POINTS`` exponents
  over the table of sources in one job and returns ``POINTS`` rows.

Defined results: a token is a run of non-blank characters; null text has none.
A null source is a source of its own.  A source without tokens gets no copies.
Rows with equal ids share one permutation key and are taken or left together.
No rows in, no rows out.  Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, table

BLOCKS = 4096
GROUP = 64      # blocks to a row of decisions, a bit each
POINTS = 33
ENTROPY_SHARE = 0.9
MOST_EPOCHS = 4.0
SEED = "mix-1"


def key(*parts: Column) -> Column:
    """A 60-bit permutation key: the leading hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 15), 16, 10).cast("long")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the frame has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def exponent(sources: DataFrame, entropy_share: float, most_epochs: float, budget: float | None) -> float:
    """The largest t in [0, 1] that meets the entropy, or the smallest above it
    that meets the repetition limit; ``sources`` has one row (n) per source."""
    total, k = sources.agg(F.sum("n"), F.count("n")).first()
    if not total:
        return 1.0
    p = F.col("n") / F.lit(float(total))
    scale = (budget or float(total)) / float(total)

    def measure(points: list[float]) -> list[tuple[float, float]]:
        at = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("t"))
        z = at.groupBy("t").agg(F.sum(F.pow("p", "t")).alias("z"),
                                F.sum(F.pow("p", "t") * F.log("p")).alias("a"),
                                F.max(F.pow(F.col("p"), F.col("t") - 1)).alias("r"))
        got = {r["t"]: (math.log(r["z"]) - r["t"] * r["a"] / r["z"], r["r"] * scale / r["z"])
               for r in z.collect()}
        return [got[x] for x in points]

    def search(below) -> float:
        """The boundary of a condition that holds from 0 on, or from 1 down."""
        lo, hi = 0.0, 1.0
        for _ in range(6):
            points = [lo + (hi - lo) * i / (POINTS - 1) for i in range(POINTS)]
            flags = [below(x) for x in measure(points)]
            if flags[-1]:
                return points[-1]
            first = flags.index(False)
            if not first:
                return points[0]
            lo, hi = points[first - 1], points[first]
        return (lo + hi) / 2

    goal = entropy_share * math.log(k) if k > 1 else 0.0
    by_entropy = search(lambda x: x[0] >= goal - 1e-12)
    by_limit = search(lambda x: x[1] > most_epochs)
    return round(max(by_entropy, by_limit), 6)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        entropy_share: float = ENTROPY_SHARE, most_epochs: float = MOST_EPOCHS,
        budget: float | None = None) -> DataFrame:
    """The mixture: the rows of ``docs``, once per copy, with the added columns
    ``epoch`` (from 0) and ``mix_key`` (the order within an epoch).  ``budget``
    is in tokens, by default those of the input.  The added columns are renamed
    with a trailing underscore if the input has such columns."""
    tok, blk, src, idc, epoch, mkey = (fresh(docs, x) for x in
        ("_tokens", "_block", "_src", "_id", "epoch", "mix_key"))
    rows = docs.withColumns({tok: n_tokens(F.col(f"`{text}`")), src: F.col(f"`{source}`").cast("string"),
                             idc: F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))})
    rows = rows.withColumn(blk, F.pmod(key(F.lit("block"), F.col(idc)), F.lit(BLOCKS)))
    blocks = materialize(rows.groupBy(F.col(src).alias("s"), F.col(blk).alias("b"))
                         .agg(F.sum(tok).alias("n")), "mix-blocks")
    sources = blocks.groupBy("s").agg(F.sum("n").alias("n")).where("n > 0")
    t = exponent(sources, entropy_share, most_epochs, budget)
    total = sources.agg(F.sum("n")).first()[0] or 0
    amount = float(budget or total)
    mass = sources.agg(F.sum(F.pow(F.col("n") / F.lit(float(total or 1)), F.lit(t)))).first()[0] or 1.0
    quota = sources.select(
        F.col("s").alias("qs"), F.col("n").alias("qn"),
        F.floor(F.round(F.pow(F.col("n") / F.lit(float(total or 1)), F.lit(t)) / F.lit(mass) * F.lit(amount), 3))
        .alias("q"))
    quota = quota.select("qs", F.floor(F.col("q") / F.col("qn")).alias("full"),
                         (F.col("q") - F.floor(F.col("q") / F.col("qn")) * F.col("qn")).alias("rest"))
    order = Window.partitionBy("s").orderBy(
        key(F.lit("order"), F.col("full").cast("string"), F.col("b").cast("string")), "b")
    placed = blocks.join(quota, F.col("s").eqNullSafe(F.col("qs"))).drop("qs") \
        .withColumn("before", F.sum("n").over(order) - F.col("n")) \
        .withColumn("cut", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    placed = materialize(placed.drop("n"), "mix-placed")
    # the documents of the cut blocks, in permuted order, up to the rest of the quota
    cut = placed.where("cut").select(F.col("s").alias("cs"), F.col("b").alias("cb"), "full", "rest", "before")
    inner = rows.select(F.col(src).alias("s"), F.col(blk).alias("b"), F.col(tok).alias("n"), F.col(idc).alias("i")) \
        .join(cut, F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb"))) \
        .groupBy("s", "b", "full", "rest", "before", "i").agg(F.sum("n").alias("n")) \
        .withColumn("k", key(F.col("full").cast("string"), F.col("i")))
    run = Window.partitionBy("s", "b").orderBy("k", "i")
    last = inner.withColumn("upto", F.col("before") + F.sum("n").over(run)).where("upto <= rest") \
        .groupBy(F.col("s").alias("ls"), F.col("b").alias("lb")) \
        .agg(F.max(F.struct("k", "i")).alias("last"))
    # a row for each source and group of blocks: the bits of the blocks taken, and the block that is cut
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % GROUP).cast("int"))
    decided = placed.join(last, F.col("s").eqNullSafe(F.col("ls")) & (F.col("b") == F.col("lb")), "left") \
        .groupBy(F.col("s").alias("_ds"), F.floor(F.col("b") / GROUP).alias("_dg")) \
        .agg(F.max("full").alias("_df"),
             F.bit_or(F.when(F.col("before") < F.col("rest"), bit).otherwise(F.lit(0).cast("long"))).alias("_dw"),
             F.max(F.when(F.col("cut"), F.col("b"))).alias("_dc"), F.max("last").alias("_dl"))
    decided = materialize(decided, "mix-decided")   # its size is known before the join is planned
    mine = rows.alias("r").join(decided.alias("d"), F.col(f"r.{src}").eqNullSafe(F.col("d._ds"))
                                & (F.floor(F.col(f"r.{blk}") / GROUP) == F.col("d._dg")))
    own = F.struct(key(F.col("d._df").cast("string"), F.col(f"r.{idc}")).alias("k"), F.col(f"r.{idc}").alias("i"))
    extra = F.when(F.col(f"r.{blk}").eqNullSafe(F.col("d._dc")), F.coalesce(own <= F.col("d._dl"), F.lit(False))) \
        .otherwise(F.getbit("d._dw", (F.col(f"r.{blk}") % GROUP).cast("int")) == 1)
    copies = (F.col("d._df") + F.when(extra, 1).otherwise(0)).cast("int")
    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))
    return mine.select(*[F.col(f"r.`{c}`") for c in docs.columns], F.col(f"r.{tok}").alias(tok),
                       F.col(f"r.{idc}").alias(idc), F.explode(epochs).alias(epoch)) \
        .withColumn(mkey, key(F.col(epoch).cast("string"), F.col(idc))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.col(tok).alias(fresh(docs, "n_tokens")), epoch, mkey)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")) \
        .select("doc_id", "source", "n_tokens", "epoch", "mix_key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def _key(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 15))::BIGINT"


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n,
         {_key("'block'", "doc_id::VARCHAR")} % {BLOCKS} AS b FROM documents),
blocks AS (SELECT source AS s, b, sum(n)::BIGINT AS n FROM d GROUP BY ALL),
sources AS (SELECT s, sum(n)::BIGINT AS n FROM blocks GROUP BY s HAVING sum(n) > 0),
shares AS (SELECT n / (SELECT sum(n) FROM sources)::DOUBLE AS p FROM sources),
goal AS (SELECT {ENTROPY_SHARE} * ln(count(*)) - 1e-12 AS h FROM shares),
e AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN m.h >= goal.h THEN m.t ELSE lo END, CASE WHEN m.h >= goal.h THEN hi ELSE m.t END
  FROM (SELECT step, lo, hi, (SELECT struct_pack(t := (lo + hi) / 2,
          h := ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p))
               / sum(p ** ((lo + hi) / 2))) FROM shares) AS m FROM e WHERE step < 40), goal),
l AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN m.r > {MOST_EPOCHS} THEN m.t ELSE lo END, CASE WHEN m.r > {MOST_EPOCHS} THEN hi ELSE m.t END
  FROM (SELECT step, lo, hi, (SELECT struct_pack(t := (lo + hi) / 2,
          r := max(p ** ((lo + hi) / 2 - 1)) / sum(p ** ((lo + hi) / 2))) FROM shares) AS m FROM l WHERE step < 40)),
x AS (SELECT round(greatest((SELECT (lo + hi) / 2 FROM e WHERE step = 40),
                            (SELECT (lo + hi) / 2 FROM l WHERE step = 40)), 6) AS t),
q AS (SELECT s, n, floor(round(p ** t / z * tot, 3))::BIGINT AS q FROM (
  SELECT s, n, n / sum(n) OVER ()::DOUBLE AS p, t, sum(n) OVER ()::DOUBLE AS tot,
         sum((n / (SELECT sum(n) FROM sources)::DOUBLE) ** t) OVER () AS z FROM sources, x)),
placed AS (SELECT b.s, b.b, b.n, q // q.n AS fulls, q - (q // q.n) * q.n AS rest,
  sum(b.n) OVER (PARTITION BY b.s ORDER BY {_key("'order'", "(q // q.n)::VARCHAR", "b.b::VARCHAR")}, b.b)
    - b.n AS before
  FROM blocks b JOIN q ON b.s IS NOT DISTINCT FROM q.s),
docs AS (SELECT d.doc_id, d.source, d.n, p.fulls, p.rest,
  p.before + sum(d.n) OVER (PARTITION BY d.source, d.b
    ORDER BY {_key("p.fulls::VARCHAR", "d.doc_id::VARCHAR")}, d.doc_id::VARCHAR) AS upto,
  p.before, p.n AS bn FROM d JOIN placed p ON d.source IS NOT DISTINCT FROM p.s AND d.b = p.b),
copies AS (SELECT doc_id, source, n,
  fulls + CASE WHEN before >= rest THEN 0 WHEN before + bn <= rest OR upto <= rest THEN 1 ELSE 0 END AS c FROM docs),
out AS (SELECT doc_id, source, n, unnest(range(c))::INTEGER AS epoch FROM copies WHERE c > 0)
SELECT doc_id, source, n AS n_tokens, epoch, {_key("epoch::VARCHAR", "doc_id::VARCHAR")} AS mix_key FROM out
"""
