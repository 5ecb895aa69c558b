"""Benchmark decontamination by question templates (operator 4, native).

Texts are canonicalised: numbers, units after a number and names (capitalised words)
become typed placeholders, the rest is lower-cased; signs of arithmetic that stand
alone are tokens.  Windows of ``WINDOW`` template tokens of the documents are
hash-joined with those of the benchmark; beside them windows of the plain tokens
(lower-cased, with their numbers) are, so that a verbatim item is found whatever its
placeholders.

An item is found in a document

* verbatim, if at least ``COVERAGE`` of its distinct plain windows occur in it; an
  item of under ``WINDOW`` tokens has one window of its own length, and one of under
  ``LEAST_INSIDE`` tokens is found only in a text that consists of it;
* asked again with other values, if at least ``COVERAGE`` of its distinct template
  windows occur in it and, at the best alignment, its names are consistent: a name
  that stands at several places of the item should stand as one name in the document;
  at most ``CONTRADICTIONS`` of the places of such names may differ.  Numbers may change
  freely.  Template windows with fewer than ``LITERALS`` literal words say nothing and
  are left out of both sides.

An item at ``COVERAGE`` lacks at most a fifth of its windows, so it shares one of any
fifth and one more: documents are paired with items by the windows that the fewest
items have, and a frame that many items share makes no pairs if they have others.
Benchmark windows are broadcast only while there are at most ``BROADCAST_WINDOWS``;
beyond that the same join shuffles.

Defined results: null and empty texts and items have no windows and never match;
items with equal texts are each reported; repeated rows (same id and text) give one
row per item; empty tables give no rows; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .mixing import fresh

WINDOW = 5
COVERAGE = 0.8
LITERALS = 2
LEAST_INSIDE = 3
CONTRADICTIONS = 0.2
BROADCAST_WINDOWS = 1_000_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# fixed values: units that may follow a number
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "ton", "tons", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces",
         "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
         "usd", "eur", "gbp", "percent", "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts")
_SIGN = r"+*/^=×÷-"
_NAME = r"(?<!\p{L})\p{Lu}\p{L}*+"
_NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
_UNIT = rf"(?i)({NUMBER}\s*+)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})"


def _apart(kept: str) -> str:
    """What stands between tokens: all but ``kept`` and signs between white space."""
    return rf"(?:[^{kept}{_SIGN}]|(?<=\S)[{_SIGN}]|[{_SIGN}](?=\S))+"


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), NUMBER + NAME + UNIT, "   ")


def template(text: Column) -> Column:
    """The template tokens of a text."""
    t = F.regexp_replace(_plain(text), _NUMBER, f" {NUMBER} ")
    t = F.regexp_replace(t, _UNIT, rf"$1 {UNIT}")
    t = F.regexp_replace(t, _NAME, NAME)
    return F.array_remove(F.split(F.lower(t), _apart(rf"\p{{L}}{NUMBER}-{UNIT}")), "")


def values(text: Column) -> Column:
    """The tokens of a text as they stand, one for each template token."""
    t = F.regexp_replace(_plain(text), _NUMBER, " $0 ")
    return F.regexp_extract_all(t, F.lit(rf"{_NUMBER}|\p{{L}}+|(?<!\S)[{_SIGN}](?!\S)"), F.lit(0))


def plain(text: Column) -> Column:
    """The lower-cased tokens of a text, numbers included."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(F.lower(t), _apart(r"\p{L}\p{Nd}")), "")


def _literal(token: Column) -> Column:
    return ((token < NUMBER) | (token > UNIT)).cast("int")


def windows(rows: DataFrame, tokens: str, lengths: list[int], whole: bool, literals: int, kind: int) -> DataFrame:
    """``rows`` with ``pos`` and ``hash`` of every window of ``tokens`` that has one of
    the lengths; ``whole`` adds, for texts of under LEAST_INSIDE tokens, that of all.
    The windows are rows of a zipped array, so hashing stays within generated code."""
    n = max(lengths)
    kept = [c for c in rows.columns if c != tokens]
    size = F.size(tokens)
    zipped = F.arrays_zip(F.col(tokens).alias("0"), *[
        F.slice(tokens, F.lit(j + 1), F.greatest(size - j, F.lit(0))).alias(str(j)) for j in range(1, n)])
    each = rows.select(*kept, size.alias("_n"), F.posexplode(zipped).alias("pos", "_w")) \
        .select(*kept, "_n", "pos", *[F.col(f"_w.{j}").alias(f"_t{j}") for j in range(n)])
    hashes = []
    for k in sorted(lengths):
        parts = [F.col(f"_t{j}") for j in range(k)]
        enough = sum(map(_literal, parts), F.lit(0)) >= literals if literals else F.lit(True)
        inside = parts[-1].isNotNull() & enough
        if k < LEAST_INSIDE:
            inside = inside & (F.col("_n") == k) if whole else F.lit(False)
        hashes.append(F.when(inside, F.xxhash64(F.lit(kind * 16 + k), *parts)))
    if len(hashes) == 1:
        return each.select(*kept, "pos", hashes[0].alias("hash")).where("hash is not null")
    return each.select(*kept, "pos", F.explode(F.array(*hashes)).alias("hash")).where("hash is not null")


TEMPLATE, PLAIN = 1, 2


def asked_windows(benchmark: DataFrame, coverage: float) -> DataFrame:
    """(item_id, item, kind, hash, ipos, need, lead): the distinct windows of the items, how
    many each item has, and whether a document has to share one of those that lead."""
    bench = benchmark.select("item_id", F.col("text").cast("string").alias("item")).distinct() \
        .withColumns({"t": template(F.col("item")), "v": plain(F.col("item"))})
    framed = windows(bench.select("item_id", "item", "t"), "t", [WINDOW], False, LITERALS, TEMPLATE)
    length = F.least(F.size("v"), F.lit(WINDOW))
    words = None
    for k in range(1, WINDOW + 1):  # an item's windows have its own length if it is short
        own = windows(bench.where(length == k).select("item_id", "item", "v"), "v", [k], True, 0, PLAIN) \
            .withColumn("length", F.lit(k))
        words = own if words is None else words.unionByName(own)
    every = framed.withColumns({"kind": F.lit(TEMPLATE), "length": F.lit(WINDOW)}).unionByName(words.withColumn("kind", F.lit(PLAIN))) \
        .groupBy("item_id", "item", "kind", "length", "hash").agg(F.min("pos").alias("ipos"))
    shared = every.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    item = Window.partitionBy("item_id", "item", "kind")
    every = every.join(shared, "hash").withColumns({
        "need": F.count(F.lit(1)).over(item), "rank": F.row_number().over(item.orderBy("items", "hash"))})
    lacking = F.floor(F.col("need") * F.lit(1 - coverage) + F.lit(1e-9))
    return materialize(every.withColumn("lead", F.col("rank") <= lacking + 1).drop("rank", "items"), "bench-windows")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, th, item_id, coverage, slots, verbatim) of every leak; ``th`` is
    the document's text hash, ``verbatim`` whether its plain windows are covered,
    ``slots`` the aligned placeholders of an item that was asked again (else 0)."""
    asked = asked_windows(benchmark, coverage)
    n_windows = asked.count()
    lengths = sorted({r[0] for r in asked.where(F.col("kind") == PLAIN).select("length").distinct().collect()} | {WINDOW})
    hashes = asked.select("hash").distinct()
    if n_windows <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mine = rows.select("doc_id", F.xxhash64("text").alias("th"), template(F.col("text")).alias("t"))
    said = rows.select("doc_id", F.xxhash64("text").alias("th"), plain(F.col("text")).alias("v"))
    found = [windows(mine, "t", [WINDOW], False, LITERALS, TEMPLATE).withColumn("kind", F.lit(TEMPLATE)),
             windows(said, "v", lengths, True, 0, PLAIN).withColumn("kind", F.lit(PLAIN))]
    hits = materialize(found[0].join(hashes, "hash", "left_semi").unionByName(found[1].join(hashes, "hash", "left_semi")), "bench-hits")
    once = hits.groupBy("doc_id", "th", "hash").agg(F.min("pos").alias("pos"))
    once = materialize(once, "bench-once")
    # candidates by leading windows, then all shared windows of a candidate
    pairs = once.join(asked.where("lead").select("hash", "item_id", "item", "kind"), "hash") \
        .select("doc_id", "th", "item_id", "item", "kind").distinct()
    p, a = pairs.alias("p"), asked.alias("a")
    wanted = p.join(a, F.col("p.item_id").eqNullSafe(F.col("a.item_id")) & (F.col("p.item") == F.col("a.item"))
                    & (F.col("p.kind") == F.col("a.kind"))) \
        .select("p.*", "a.hash", "a.ipos", "a.need").alias("q")
    shared = wanted.join(once.alias("h"), F.col("q.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("q.th") == F.col("h.th"))
                         & (F.col("q.hash") == F.col("h.hash"))).select("q.*")
    key = ["doc_id", "th", "item_id", "item"]
    pairs = shared.groupBy(*key, "kind").agg((F.count(F.lit(1)) / F.first("need")).alias("coverage")) \
        .where(F.col("coverage") >= coverage)
    kinds = pairs.groupBy(*key).agg(F.max(F.when(F.col("kind") == PLAIN, F.col("coverage"))).alias("plain"),
                                    F.max(F.when(F.col("kind") == TEMPLATE, F.col("coverage"))).alias("framed"))
    kinds = materialize(kinds, "bench-pairs")
    verbatim = kinds.where("plain is not null").select(
        *key, F.col("plain").alias("coverage"), F.lit(0).alias("slots"), F.lit(True).alias("verbatim"))
    again = asked_again(rows, kinds.where("plain is null").withColumnRenamed("framed", "coverage").drop("plain"), asked, hits)
    return verbatim.unionByName(again).drop("item")


def asked_again(rows: DataFrame, pairs: DataFrame, asked: DataFrame, hits: DataFrame) -> DataFrame:
    """The pairs whose names agree at the best alignment of item and document."""
    key = ["doc_id", "th", "item_id", "item"]
    p, a, h = pairs.alias("p"), asked.where(F.col("kind") == TEMPLATE).alias("a"), hits.where(F.col("kind") == TEMPLATE).alias("h")
    aligned = p.join(a, F.col("p.item_id").eqNullSafe(F.col("a.item_id")) & (F.col("p.item") == F.col("a.item"))) \
        .select("p.*", "a.hash", "a.ipos").alias("q") \
        .join(h, F.col("q.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("q.th") == F.col("h.th"))
              & (F.col("q.hash") == F.col("h.hash"))) \
        .select("q.doc_id", "q.th", "q.item_id", "q.item", "q.coverage", (F.col("h.pos") - F.col("q.ipos")).alias("shift")) \
        .groupBy(*key, "coverage", "shift").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy(*key, "coverage").agg(F.max_by("shift", F.struct(F.col("n"), -F.col("shift"))).alias("shift"))
    found = rows.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("kh"), "text") \
        .join(pairs.select(F.col("doc_id").alias("wk"), F.col("th").alias("wh")).distinct(),
              F.col("k").eqNullSafe(F.col("wk")) & (F.col("kh") == F.col("wh")), "left_semi") \
        .dropDuplicates(["k", "kh"]).select("k", "kh", template(F.col("text")).alias("dt"), values(F.col("text")).alias("dv"))
    both = aligned.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("kh"))) \
        .withColumns({"it": template(F.col("item")), "iv": values(F.col("item"))})
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("it") - 1, F.lit(0))), lambda i: F.get("it", i).isin(NUMBER, NAME))
    slots = F.filter(F.transform(places, lambda i: F.struct(
        F.get("it", i).alias("type"), F.lower(F.get("iv", i)).alias("i"), F.lower(F.get("dv", i + F.col("shift"))).alias("d"),
        F.get("it", i).eqNullSafe(F.get("dt", i + F.col("shift"))).alias("same"))), lambda x: x["same"])
    slot = both.select(*key, "coverage", F.size(slots).alias("slots"), F.explode_outer(slots).alias("s")) \
        .groupBy(*key, "coverage", "slots", F.col("s.type").alias("type"), F.col("s.i").alias("i"), F.col("s.d").alias("d")) \
        .agg(F.count("s").alias("n"))
    # places of a name beyond its most frequent counterpart contradict
    name = slot.groupBy(*key, "coverage", "slots", "type", "i").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    several = (F.col("type") == NAME) & (F.col("n") > 1)
    wrong, places = (F.sum(F.when(several, x).otherwise(0)) for x in (F.col("n") - F.col("most"), F.col("n")))
    return name.groupBy(*key, "coverage", "slots").agg(wrong.alias("wrong"), places.alias("places")) \
        .where(F.col("wrong") <= CONTRADICTIONS * F.col("places")).drop("wrong", "places").withColumn("verbatim", F.lit(False))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "item_id", "coverage", "slots", "verbatim")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")) \
        .select(F.col("doc_id").alias("_leak_id"), F.col("th").alias("_leak_th")).distinct()
    h = fresh(docs, "_text_hash")
    return docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))) \
        .join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("_leak_id")) & (F.col(h) == F.col("_leak_th")),
              "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
