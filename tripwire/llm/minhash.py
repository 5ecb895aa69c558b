"""Near-duplicate documents by ProbMinHash, banding and verification (operator 3).

* **Weights.** A document is its multiset of ``SHINGLE``-word shingles; the
  weight of a shingle is how often it occurs.  The similarity of two documents
  is the probability Jaccard index, sum over common i of
  1 / sum_j max(w_j / w_i, v_j / v_i), which for equal weights is the usual one.
* **Sketch.** Every shingle starts a Poisson process whose rate is its weight;
  each arrival goes to a random register, which keeps its earliest arrival.
  All shingles advance together, one arrival a round, and a shingle stops once
  its time is past the latest register of its document (early termination).
* **Banding.** ``SLOTS`` registers in bands of ``ROWS``; a pair at similarity
  0.8 shares no band with a probability of 3e-6.
* **Verification in two rounds.** Documents with equal word sequences become one
  node first.  In every bucket each node is held against the bucket's leader,
  the node that meets most others in all its buckets, by the exact similarity;
  components of the links follow.  Then the pairs of a bucket that are still in
  different components are verified, unless an upper bound already excludes
  them: shingles that no other node has cannot be shared, so a node of s
  shingles with u private ones has at most s - u in common with any other.  The
  nodes still open also get a second, independent sketch of ``SIGN_BITS`` one-bit
  registers; a pair that differs in more than ``most_different`` of them is not
  at 0.8 (at 0.8 a tenth differs on average; the bound is over five standard
  deviations higher, a chance below 1e-6).  So every pair that shares a band is
  verified (once, in the first bucket that it shares), excluded by a bound, or
  in one class already; a large group of copies costs a star, and copies that
  were edited too far are excluded one by one rather than pair by pair.

Defined results: null text is empty; texts without a word are of one class if
they are equal; texts of under ``SHINGLE`` words have one shingle, all their
words; null ids count as the largest; a class takes the smallest id; repeated
rows are of one class; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, codes_of, lower_table, materialize, mix64, table

SHINGLE = 5
THRESHOLD = 0.8
SLOTS = 96
ROWS = 4
DEALT = 256  # open nodes of a bucket that one task compares with the others
SIGN_BITS = 1024
MOST_DIFFERENT_SDS = 5.2
HASH_BITS = 48
CHARS = 500_000     # code points sketched at once: a task holds some seven longs for each
SHINGLES = 500_000  # shingles signed at once
LAST_ID = (1 << 63) - 1
U = np.uint64


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For every code point, whether it is part of a word."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased word, and its document."""
    code = codes_of("\n".join(texts) + "\n")
    at = np.flatnonzero(word_table()[code])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    size = np.diff(opens, append=len(at))
    place = np.arange(len(at)) - np.repeat(opens, size)
    value = mix64(lower_table()[code[at]].astype(np.uint64) + U(0x9E3779B97F4A7C15))
    value *= powers(0x5851F42D4C957F2D, int(size.max()))[place]
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(offset, at[opens], side="right") - 1
    return mix64(np.add.reduceat(value, opens)), doc


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int):
    """Sorted distinct shingle hashes with counts, and where each document's start."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    each = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(n_docs), each)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + first[owner]
    end = (first + count)[owner]
    total = np.zeros(len(owner), np.uint64)
    for j, k in enumerate(powers(0xD1342543DE82EF95, SHINGLE + 1)[1:]):
        inside = start + j < end
        total += np.where(inside, words[np.minimum(start + j, len(words) - 1)] if len(words) else U(0), U(0)) * k
    key = np.sort((owner.astype(np.uint64) << U(HASH_BITS)) | (mix64(total) >> U(64 - HASH_BITS)))
    new = np.flatnonzero(np.diff(key, prepend=key[:1] + U(1)) != 0) if len(key) else np.empty(0, np.int64)
    weight = np.diff(new, append=len(key))
    value = key[new] & U((1 << HASH_BITS) - 1)
    owner = (key[new] >> U(HASH_BITS)).astype(np.int64)
    return value, weight, owner


def sketch(value: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash registers (n_docs x slots); a document without shingles has zeros."""
    when = np.full(n_docs * slots, np.inf)
    held = np.zeros(n_docs * slots, np.uint64)
    time = np.zeros(len(value))
    base, rate, who, item = mix64(value + U(1)), 1.0 / weight, owner, value
    step = 0
    while len(who):
        step += 1
        draw = mix64(base + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) * rate
        slot = who * slots + ((draw & U(0x7FF)) * U(slots) >> U(11)).astype(np.int64)
        near = time < when[slot]
        slot_n, time_n = slot[near], time[near]
        np.minimum.at(when, slot_n, time_n)
        won = when[slot_n] == time_n
        held[slot_n[won]] = item[near][won]
        going = time < when.reshape(n_docs, slots).max(1)[who]
        time, base, rate, who, item = time[going], base[going], rate[going], who[going], item[going]
    return held.reshape(n_docs, slots)


def bands(held: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each document; the band is part of the key."""
    n, slots = held.shape
    k = powers(0xA0761D6478BD642F, rows + 1)[1:]
    key = (mix64(held + U(7)).reshape(n, slots // rows, rows) * k).sum(2, dtype=np.uint64)
    return mix64(key + mix64(np.arange(slots // rows, dtype=np.uint64) + U(99))).view(np.int64)


def signs(value: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """``SIGN_BITS`` one-bit registers of an independent sketch, 64 to a long."""
    held = sketch(mix64(value ^ U(0x5BD1E9955BD1E995)), weight, owner, n_docs, SIGN_BITS)
    salt = mix64(np.arange(SIGN_BITS, dtype=np.uint64) + U(13))   # else a shingle has one bit in all registers
    bit = (mix64(held + salt) >> U(63)).astype(np.uint8)
    return np.packbits(bit, axis=1, bitorder="little").view("<i8")


def most_different(threshold: float) -> int:
    """The most one-bit registers in which a pair at the threshold may differ."""
    p = (1.0 - threshold) / 2
    return int(SIGN_BITS * p + MOST_DIFFERENT_SDS * (SIGN_BITS * p * (1 - p)) ** 0.5)


def node_names(words: np.ndarray, doc: np.ndarray, texts: list[str]) -> list[str]:
    """A 128-bit name of each text's word sequence; of the text if it has no word."""
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    some = np.flatnonzero(count)
    place = np.arange(len(words)) - np.repeat(first, count)
    parts = [np.add.reduceat(mix64(words ^ U(salt)) * powers(base, int(count.max()))[place], first[some])
             for salt, base in ((0x1234567, 0x9E3779B97F4A7C15), (0x89ABCDE, 0xC2B2AE3D27D4EB4F))] \
        if len(some) else [[], []]
    out = [""] * len(texts)
    for i, a, b in zip(some, *parts):
        out[i] = f"{a:016x}{b:016x}"
    for i in np.flatnonzero(count == 0):
        out[i] = "t" + hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).hexdigest()
    return out


def _texts(column: pd.Series) -> list[str]:
    return ["" if t is None else t for t in column]


def _sketched(batches):
    for pdf in batches:
        texts = _texts(pdf["text"])
        for group in chunks(texts, CHARS):
            own = [texts[i] for i in group]
            words, doc = word_hashes(own)
            value, weight, owner = shingles(words, doc, len(own))
            keys = bands(sketch(value, weight, owner, len(own)))
            some = np.bincount(doc, minlength=len(own)) > 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[group].to_numpy(), "th": pdf["th"].iloc[group].to_numpy(),
                                "node": node_names(words, doc, own),
                                "bands": [k if s else [] for k, s in zip(keys, some)]})


def _weighted(batches):
    for pdf in batches:
        texts = _texts(pdf["text"])
        for group in chunks(texts, CHARS):
            own = [texts[i] for i in group]
            words, doc = word_hashes(own)
            value, weight, owner = shingles(words, doc, len(own))
            cut = np.searchsorted(owner, np.arange(len(own) + 1))
            value = value.astype(np.int64)
            yield pd.DataFrame({"node": pdf["node"].iloc[group].to_numpy(),
                                "value": [value[a:b] for a, b in zip(cut, cut[1:])],
                                "weight": [weight[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]})


def _signed(batches):
    """Signs of every node, a bounded number of shingles and nodes at once."""
    for pdf in batches:
        sizes = pdf["value"].map(len).to_numpy()
        part = np.maximum.accumulate(np.maximum(np.cumsum(sizes) // SHINGLES, np.arange(len(pdf)) // 500)) \
            if len(pdf) else sizes
        for _, own in pdf.groupby(part):
            n = own["value"].map(len).to_numpy()
            got = signs(np.concatenate(own["value"].tolist()).astype(np.int64).view(np.uint64),
                        np.concatenate(own["weight"].tolist()), np.repeat(np.arange(len(own)), n), len(own))
            yield pd.DataFrame({"node": own["node"].to_numpy(), "sign": list(got)})


def similarity(av, aw, bv, bw) -> float:
    """The probability Jaccard index of two weighted sets (sorted values)."""
    both, ia, ib = np.intersect1d(av, bv, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if aw.max(initial=1) == 1 and bw.max(initial=1) == 1:
        return len(both) / (len(av) + len(bv) - len(both))
    w, v = aw[ia].astype(float), bw[ib].astype(float)
    order = np.argsort(v / w, kind="stable")
    w, v, ratio = w[order], v[order], (v / w)[order]
    # of every j: w_j / w_i if its ratio is not above that of i, else v_j / v_i
    upto = np.searchsorted(ratio, ratio, side="right")
    low = aw.sum() - w.sum() + np.append(0, np.cumsum(w))[upto]
    high = bw.sum() - np.append(0, np.cumsum(v))[upto]
    return float((1.0 / (low / w + high / v)).sum())


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    sets = sets.where(F.size("value") > 0)
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("value").alias("av"), F.col("weight").alias("aw")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("value").alias("bv"), F.col("weight").alias("bw")), "b") \
        .where(F.size("av") > 0)

    def verify(batches):
        for pdf in batches:
            ok = [similarity(*x) >= threshold - 1e-12 for x in zip(pdf["av"], pdf["aw"], pdf["bv"], pdf["bw"])]
            yield pdf.loc[ok, ["a", "b"]]

    return full.mapInPandas(verify, "a long, b long")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every linked node but the roots, by alternating large and
    small stars; each round is a table in the shared folder."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), name)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).distinct()
        edges = materialize(small, name)
        n, nodes = edges.agg(F.count("u"), F.count_distinct("u")).first()
        if n == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shared_most(sets: DataFrame) -> DataFrame:
    """For every node its number s and weight w of shingles, the number u and
    weight uw of those that no other node has, and whether all weights are 1."""
    each = sets.select("node", F.explode(F.arrays_zip("value", "weight")).alias("x")) \
        .select("node", "x.value", F.col("x.weight").cast("long").alias("weight"))
    own = each.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")) \
        .where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"), F.sum("weight").alias("uw"))
    total = F.aggregate("weight", F.lit(0).cast("long"), lambda a, x: a + x)
    return sets.select("node", F.size("value").cast("long").alias("s"), total.alias("w"),
                       (F.array_max("weight") == 1).alias("flat")).join(own, "node", "left") \
        .select("node", "s", "w", "flat", F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("uw", F.lit(0)).alias("uw"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), class_id (smallest
    doc_id of its class), kept (whether the row's (doc_id, th) stands for the class)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = rows.withColumn("th", F.xxhash64("text"))
    # ids as text, since pandas would turn a nullable long into a float
    sketched = keyed.withColumn("doc_id", F.col("doc_id").cast("string")) \
        .mapInPandas(_sketched, "doc_id string, th long, node string, bands array<long>")
    seen = materialize(sketched.withColumn("doc_id", F.col("doc_id").cast("long")), "sketched")
    ident = F.coalesce("doc_id", F.lit(LAST_ID))
    # nodes are numbered once: the number, fixed by the write, is what the joins below carry instead of the name
    nodes = materialize(seen.groupBy(F.col("node").alias("name"))
                        .agg(F.min(F.struct(ident.alias("first"), "th")).alias("row"), F.first("bands").alias("bands"))
                        .select(F.monotonically_increasing_id().alias("node"), "name", "row.first", "row.th", "bands"), "nodes")
    member = nodes.where(F.size("bands") > 0).select("node", F.explode("bands").alias("bucket"))
    shared = materialize(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    member = materialize(member.join(shared, "bucket"), "met")
    weight = member.groupBy("node").agg(F.sum("n").alias("met"))
    lead = member.join(weight, "node").groupBy("bucket") \
        .agg(F.max_by("node", F.struct("met", "node")).alias("a"))
    member = materialize(member.join(lead.select("bucket", "a"), "bucket").select("bucket", "node", "a"), "members")
    stars = member.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    wanted = member.select("node").distinct()
    # a node's text is that of its first row; a repeated row counts once
    heads = nodes.select("node", F.col("first").alias("k"), "th").join(wanted, "node", "left_semi")
    sets = keyed.select(ident.alias("k"), "th", "text").join(heads, ["k", "th"]).dropDuplicates(["k", "th"]) \
        .select("node", "text").mapInPandas(_weighted, "node long, value array<long>, weight array<int>")
    sets = materialize(sets, "sets")
    found = materialize(_links(stars, sets, threshold), "star-links")
    part = components(found, "star-parts")
    # pairs of a bucket that the first round left in different components
    at = member.join(part, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    open_ = at.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    at = materialize(at.join(open_, "bucket", "left_semi"), "open")
    known = materialize(shared_most(sets.join(at.select("node").distinct(), "node", "left_semi")), "bounds") \
        .where(F.when(F.col("flat"), F.col("s") - F.col("u") >= threshold * F.col("s"))
               .otherwise(F.col("w") - F.col("uw") >= threshold * F.col("w")))
    own = at.groupBy("node").agg(F.collect_set("bucket").alias("own"))
    sign = sets.join(known.select("node"), "node", "left_semi").mapInPandas(_signed, "node long, sign array<long>")
    at = materialize(at.join(known.join(own, "node").join(sign, "node"), "node"), "still-open")
    # a crowded bucket's nodes are dealt to several tasks, each against all nodes of the bucket
    width = at.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("width"))
    dealt = at.join(width, "bucket")
    x = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("width")).cast("int")).alias("x")
    y = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).alias("y")
    most = F.least(F.col("x.s") - F.col("x.u"), F.col("y.s") - F.col("y.u"))
    able = ~(F.col("x.flat") & F.col("y.flat")) | (most >= threshold * (F.col("x.s") + F.col("y.s") - most) - 1e-9)
    differ = sum((F.bit_count(F.col("x.sign")[i].bitwiseXOR(F.col("y.sign")[i])) for i in range(1, SIGN_BITS // 64)),
                 F.bit_count(F.col("x.sign")[0].bitwiseXOR(F.col("y.sign")[0])))
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt"))
                  & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.part") != F.col("y.part")) & able & (differ <= most_different(threshold))
                  & (F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.bucket"))) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")) \
        .join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    part = components(found.union(_links(rest, sets, threshold)), "parts")
    placed = nodes.select("node", "name", "first").join(part, "node", "left") \
        .select("name", "first", F.coalesce("root", "node").alias("root"))
    lead = placed.groupBy("root").agg(F.min("first").alias("class_id"))
    final = placed.join(lead, "root").select("name", "class_id")
    out = seen.select("doc_id", "th", F.col("node").alias("name")).join(final, "name")
    pick = out.where(ident == F.col("class_id")).groupBy(F.col("class_id").alias("c")).agg(F.min("th").alias("t"))
    out = out.join(pick, F.col("class_id") == F.col("c"), "left")
    return out.select("doc_id", "th", F.when(F.col("class_id") != LAST_ID, F.col("class_id")).alias("class_id"),
                      ((ident == F.col("class_id")) & (F.col("th") == F.col("t"))).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    from .mixing import fresh

    keep = near_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_keep_id"),
                                                      F.col("th").alias("_keep_th")).distinct()
    k, h, n = fresh(docs, "_doc_key"), fresh(docs, "_text_hash"), fresh(docs, "_copy")
    rows = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), h: F.xxhash64("text")})
    left = rows.join(keep, (F.col(k) == F.col("_keep_id")) & (F.col(h) == F.col("_keep_th")), "left_semi")
    order = Window.partitionBy(k, h).orderBy(F.lit(1))
    return left.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
