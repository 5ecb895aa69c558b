"""Personal data by bootstrapped contextual extraction (operator 6, native).

* **Seeds.** Emails, IP addresses, payment cards and phone numbers that match
  the fixed expressions below; those are spans in any case.
* **Identifiers.** Runs of digit groups (joined by a space, dot, hyphen or bracket,
  with a leading plus or bracket) and other tokens with a digit, whole.
* **Patterns.** An identifier has two lexical patterns: the word on its left and what
  stands between them, with its shape (runs of digits and of letters collapsed), and
  the same with its class (digits, with an @, or mixed) in place of the shape.
* **Graph.** Distinct (pattern, identifier) edges.  Identifiers that a seed covers by
  half or more have score 1 for its kind.  In each of ``ROUNDS`` rounds the
  confidence of a pattern for a kind is the mean score of its identifiers, and
  an identifier takes the best confidence among its patterns with at least
  ``SUPPORT`` identifiers and ``CONFIDENCE``.
* **Discovery.** An identifier outside every base span becomes a span if one of its
  patterns reaches ``CONFIDENCE`` for a kind and it can be of that kind (``PLAUSIBLE``).

The text is scanned once, with JVM expressions; what follows works on the
identifiers.  Sums over hot patterns are aggregated before they are shuffled.
The expressions use possessive groups and start only where a run starts, so they
are linear in the length of a text and do not recurse.

Defined results: null text is empty and has no spans; offsets are code points,
ends exclusive; a text's spans depend on the text and the corpus, so repeated
rows have equal results; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .mixing import fresh

ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.9
KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"A-Za-z0-9._%+-"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind: (guard character or None, expression that finds exactly the leftmost non-overlapping matches)
BASE = {
    "email": ("@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: kind: least and most digits of a discovered identifier, and its form
PLAUSIBLE = {"email": (0, 64, r"^[^@]+@[^@]+$"), "ip": (3, 32, rf"^{_BYTE}(?:\.{_BYTE}){{2,}}$"),
             "card": (12, 19, r"^[0-9\x20.-]+$"), "phone": (7, 15, r"^[+0-9\x20().-]+$")}
_LEFT = r"(?<![\p{L}\p{N}])(?:(\p{L}++)([^\p{L}\p{N}]++))?+"
_GROUPS = r"[0-9]++(?:(?:[\x20.-]|\x20?\(|\)[\x20-]?)[0-9]++)*+(?![A-Za-z0-9@_])"
_TOKEN = rf"({_GROUPS}|(?=[A-Za-z._%@=/+-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._%@=/+-]*+)"
_SPAN = "array<struct<start:int,stop:int,value:string>>"


def matches(text: Column, expression: str) -> Column:
    return F.regexp_extract_all(text, F.lit(expression), F.lit(0))


def places(text: Column, found: Column, expression: str) -> Column:
    """Start, stop and text of every match; ``found`` is the column of ``matches``."""
    gaps = F.slice(F.split(text, expression, -1), 1, F.size(found))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(
            F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, zero, add, lambda acc: acc["out"])) \
        .otherwise(F.array().cast(_SPAN))


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _named(kind: str, got: Column) -> Column:
    return F.transform(F.filter(got, lambda x: accepted(kind, x["value"])),
                       lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, th, base (kind, start, stop) and near, the places of a word, a
    separator and a token with a digit; one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("raw")) \
        .select("doc_id", F.xxhash64("raw").alias("th"), F.coalesce("raw", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    text = F.col("text")
    found = {k: matches(text, x) if guard is None else F.when(F.contains(text, F.lit(guard)), matches(text, x))
             .otherwise(none) for k, (guard, x) in BASE.items()}
    rows = rows.select("*", *[x.alias(f"m_{k}") for k, x in found.items()],
                       F.when(text.rlike("[0-9]"), matches(text, _LEFT + _TOKEN)).otherwise(none).alias("m_near"))
    placed = rows.select("doc_id", "th", *[places(text, F.col(f"m_{k}"), x).alias(k) for k, (_, x) in BASE.items()],
                         places(text, F.col("m_near"), _LEFT + _TOKEN).alias("near"))
    return materialize(placed.select("doc_id", "th", F.concat(*[_named(k, F.col(k)) for k in KINDS]).alias("base"), "near"),
                       "pii-scan")


def _candidates(scanned: DataFrame) -> DataFrame:
    """Two rows per identifier, one for each pattern: its place, pattern, value, the kind of
    the base span that covers half of it or more, whether any meets it, and the kinds it can be."""
    full = _LEFT + _TOKEN
    x = F.col("x")
    got = scanned.where(F.size("near") > 0).select("doc_id", "th", "base", F.explode("near").alias("x"))
    gap = F.regexp_extract(x["value"], full, 2)
    lead = F.regexp_extract(gap, r"\+?\(?\z", 0)  # of the gap's end, what begins the identifier
    got = got.select("doc_id", "th", "base", x["stop"].alias("stop"), F.lower(F.regexp_extract(x["value"], full, 1)).alias("word"),
                     F.regexp_replace(F.substring(gap, F.lit(1), F.length(gap) - F.length(lead)), r"\s+", " ").alias("gap"),
                     F.concat(lead, F.regexp_extract(x["value"], full, 3)).alias("value")) \
        .withColumn("start", F.col("stop") - F.length("value"))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    can = F.array_compact(F.array(*[
        F.when(digits.between(least, most) & F.col("value").rlike(form), F.lit(k)) for k, (least, most, form) in PLAUSIBLE.items()]))
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), "[A-Za-z]+", "a")
    kind = F.when(F.contains(F.col("value"), F.lit("@")), "@").when(F.col("value").rlike("[A-Za-z]"), "a").otherwise("9")
    meets = F.filter("base", lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start")))
    covers = F.filter(meets, lambda b: 2 * (F.least(b["stop"], F.col("stop")) - F.greatest(b["start"], F.col("start")))
                      >= F.col("stop") - F.col("start"))
    named = F.explode(F.array(F.concat(F.lit("shape\x1f"), shape), F.concat(F.lit("class\x1f"), kind)))
    return got.select("doc_id", "th", "start", "stop", F.md5(F.col("value").cast("binary")).alias("item"), can.alias("can"),
                      F.get(covers, F.lit(0))["kind"].alias("kind"), (F.size(meets) > 0).alias("met"), "word", "gap", named.alias("form")) \
        .withColumn("pattern", F.md5(F.concat_ws("\x1f", "word", "gap", "form").cast("binary"))).drop("word", "gap", "form")


def patterns(candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT,
             confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that reach both limits."""
    edges = materialize(candidates.groupBy("pattern", "item").agg(F.max("kind").alias("kind")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    edges = edges.join(size, "pattern")
    seeds = edges.where("kind is not null").groupBy("item", "kind").agg(F.lit(1.0).alias("score"))
    links = edges.select("pattern", "item", "n")
    score = seeds
    for step in range(rounds):
        rated = links.join(score, "item").groupBy("pattern", "kind") \
            .agg((F.sum("score") / F.first("n")).alias("confidence")).where(F.col("confidence") >= confidence)
        rated = materialize(rated, "pii-patterns")
        if step + 1 < rounds:
            score = links.join(rated, "pattern").groupBy("item", "kind").agg(F.max("confidence").alias("score")) \
                .union(seeds).groupBy("item", "kind").agg(F.max("score").alias("score"))
    return rated


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), base and all
    spans (kind, start, stop), by kind and start."""
    scanned = scan(docs)
    found = materialize(_candidates(scanned), "pii-identifiers")
    rated = patterns(found).withColumnRenamed("kind", "as")
    more = found.where("not met").join(rated, "pattern").where(F.array_contains("can", F.col("as"))) \
        .groupBy("doc_id", "th", "start", "stop").agg(F.max_by("as", F.struct("confidence", "as")).alias("as")) \
        .groupBy(F.col("doc_id").alias("mk"), F.col("th").alias("mh")) \
        .agg(F.collect_set(F.struct(F.col("as").alias("kind"), "start", "stop")).alias("more"))
    both = scanned.select("doc_id", "th", "base").join(
        more, F.col("doc_id").eqNullSafe(F.col("mk")) & (F.col("th") == F.col("mh")), "left")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    ordered = F.concat(*[F.sort_array(_of(every, k)) for k in KINDS])
    return both.select("doc_id", "th", "base", ordered.alias("spans"))


def _of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[F.size(_of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap the one that starts first (then the longer) is named."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        name = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], -x["back"]).alias("at"), F.concat(acc["out"], F.array(gap, name)).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(order, zero, add, rest)).otherwise(text)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans found masked and ``n_chars`` counted again."""
    spans = find(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_k"), F.col("th").alias("_h")) \
        .agg(F.first("spans").alias("_spans"))
    h = fresh(docs, "_text_hash")
    got = docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).join(
        spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_k")) & (F.col(h) == F.col("_h")), "left")
    text = F.when(F.col("_spans").isNotNull(), masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length(text)).otherwise(F.col("n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    return got.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
