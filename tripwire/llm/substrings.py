"""Removal of repeated substrings, sorted column by column (operator 8).

A byte goes if some ``LENGTH``-byte string that covers it also starts elsewhere.

* **Segments.** Every window of ``LENGTH`` bytes has an anchor, the
  ``GRAM``-byte string of smallest hash in it.  Windows in a row with one anchor
  form a segment.  Equal windows have equal anchors at equal offsets, so only
  segments with equal anchor strings can hold equal windows, and segments whose
  anchor string occurs once are done.
* **Equal segments** collapse to one before anything is compared: their windows
  all repeat, however many copies there are.
* **Columns.** The different segments of an anchor are a small collection of
  aligned strings.  It is sorted as in multi-document construction of a
  Burrows-Wheeler transform: from the last column to the first, each round puts
  one more symbol in front of every string, updates the order of the collection
  by a stable sort and the common prefixes by minima over the order before.  A
  window repeats if a neighbour's common prefix reaches ``LENGTH``.
* **Crowded anchors** (more than ``CROWD`` different segments) are divided by
  longer anchors (``FINE_GRAM`` bytes).  Equal parts collapse again; only
  different parts of one fine anchor are counted window by window, with partial
  sums before the shuffle.  The result is the same, and no anchor is ever one
  task's load.

The original construction keeps one transform of the whole collection and reads
it once per round, with as many rounds as the longest document has bytes; the
anchors make each collection as short as ``LENGTH`` plus its windows.  The
sequential files are Spark's sorted shuffle streams.

Segments and windows are compared by pairs of 64-bit hashes (anchor and
content); the columns compare bytes.

Defined results: null text is empty; texts of under ``LENGTH`` bytes lose
nothing; overlapping occurrences count, also within one document; repeated rows
repeat each other's bytes; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, table
from .minhash import powers

LENGTH = 400
GRAM = 200
SPAN = LENGTH - GRAM + 1
FINE_GRAM = 380
PIECE = 2_000_000
CROWD = 256
BATCH = 20_000
HELD = 16_000_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POSITION = U(22)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of the base and its inverse."""
    n = PIECE + 2 * LENGTH + 1
    inverse = pow(_BASE, -1, 1 << 64)
    return mix64(np.arange(1, 257, dtype=np.uint64) * U(_BASE)), powers(_BASE, n), powers(inverse, n)


class Hashes:
    """Hashes of all substrings of a byte array, by differences of prefix sums."""

    def __init__(self, data: np.ndarray):
        value, up, self.down = _tables()
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(value[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start])


def segments(data: np.ndarray, until: np.ndarray, size: int = GRAM):
    """Segments of a piece of at most ``PIECE`` windows, with anchors of ``size``
    bytes; ``until`` is, for each byte, the end of its document.  Arrays: anchor
    hash, content hash, first window, number of windows, offset of the first
    window to the anchor."""
    span = LENGTH - size + 1
    empty = np.empty(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    hashes = Hashes(data)
    at = np.arange(len(data) - size + 1)
    gram = hashes.of(at, at + size)
    key = (gram >> _POSITION << _POSITION) | at.astype(np.uint64)
    rows = -(-len(key) // span)
    block = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    block[:len(key)] = key
    block = block.reshape(rows, span)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[span - 1:span - 1 + n])
    anchor = (least & ((U(1) << _POSITION) - U(1))).astype(np.int64)
    start = np.flatnonzero(np.arange(n) + LENGTH <= until[:n])
    if not len(start):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    new = np.flatnonzero((np.diff(anchor[start], prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    first, count = start[new], np.diff(new, append=len(start))
    content = hashes.of(first, first + count + LENGTH - 1) + (count + (first - anchor[first]) * 1024).astype(np.uint64)
    return gram[anchor[first]], mix64(content), first, count, first - anchor[first]


def pieces(texts: list[bytes]):
    """Groups of (document, offset, bytes) of at most ``PIECE`` windows in all;
    the pieces of a long text overlap by ``LENGTH - 1`` bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[offset:offset + PIECE + LENGTH - 1]
            if group and size + len(part) > PIECE + LENGTH:
                yield group
                group, size = [], 0
            group.append((i, offset, part))
            size += len(part)
    if group:
        yield group


def _bytes(column: pd.Series) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column]


def _cut(batches):
    for pdf in batches:
        texts = _bytes(pdf["text"])
        ids, hashes = pdf["doc_id"].to_numpy(), pdf["th"].to_numpy()
        for group in pieces(texts):
            data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
            size = np.array([len(p) for _, _, p in group])
            end = np.cumsum(size)
            m, ch, first, count, shift = segments(data, np.repeat(end, size))
            who = np.searchsorted(end, first, side="right")
            doc = np.array([i for i, _, _ in group])[who]
            move = (np.array([o for _, o, _ in group]) - (end - size))[who]
            yield pd.DataFrame({"m": m.view(np.int64), "ch": ch.view(np.int64), "doc_id": ids[doc], "th": hashes[doc],
                                "first": first + move, "n": count.astype(np.int16), "shift": shift.astype(np.int16)})


def repeated_columns(anchor: np.ndarray, strings: list[bytes], shift: np.ndarray) -> list[np.ndarray]:
    """For each string the windows that also occur in another string of its anchor.

    ``anchor`` is sorted; ``shift`` is the column of a string's first byte,
    counted from the anchor, between 1 - SPAN and 0.
    """
    n = len(strings)
    width = SPAN - 1 + LENGTH
    low = shift + SPAN - 1
    high = low + np.array([len(s) for s in strings])
    symbol = np.zeros((width, n), np.uint8)
    for k, s in enumerate(strings):
        symbol[low[k]:high[k], k] = np.frombuffer(s, np.uint8)
    group = np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0).astype(np.int64)
    repeats = np.zeros((width, n), bool)
    order = np.empty(0, np.int64)
    common = np.empty(0, np.int32)
    joins = [np.flatnonzero(high - 1 == c) for c in range(width)]
    for c in range(width - 1, -1, -1):
        # strings that end here have an empty suffix so far: first in the order
        order = np.concatenate([joins[c], order])
        common = np.concatenate([np.zeros(len(joins[c]), np.int32), common])
        place = np.flatnonzero(low[order] <= c)
        here = order[place]
        if not len(here):
            order, common = here, np.empty(0, np.int32)
            continue
        key = group[here] * 256 + symbol[c, here]
        sort = np.argsort(key, kind="stable")
        key, place, here = key[sort], place[sort], here[sort]
        pair = np.flatnonzero(key[1:] == key[:-1])
        now = np.zeros(len(here), np.int32)
        if len(pair):
            edge = np.empty(2 * len(pair), np.int64)
            edge[0::2], edge[1::2] = place[pair] + 1, place[pair + 1] + 1
            now[pair + 1] = np.minimum.reduceat(np.append(common, np.int32(0)), edge)[0::2] + 1
        order, common = here, now
        full = now >= LENGTH
        repeats[c, here] = full | np.append(full[1:], False)
    return [repeats[low[k]:high[k] - LENGTH + 1, k] for k in range(n)]


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _sorted_columns(batches):
    """Rows sorted by anchor; whole anchors at a time, about ``BATCH`` strings."""
    held: list[tuple] = []

    def done(rows):
        got = repeated_columns(np.array([r[0] for r in rows]), [r[3] for r in rows], np.array([r[2] for r in rows]))
        out = [(r[0], r[1], a, b) for r, flags in zip(rows, got) for a, b in _intervals(flags)]
        return pd.DataFrame(out, columns=["m", "ch", "lo", "hi"])

    for pdf in batches:
        for row in zip(pdf["m"], pdf["ch"], pdf["shift"], pdf["data"]):
            if len(held) >= BATCH and held[-1][0] != row[0]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def _fetch(batches):
    """The bytes of a document's segments; crowded ones in parts by fine anchor,
    with the hash of each window."""
    for pdf in batches:
        out = []
        for text, parts in zip(_bytes(pdf["text"]), pdf["parts"]):
            for p in parts:
                first, n = int(p["first"]), int(p["n"])
                data = text[first:first + n + LENGTH - 1]
                if not p["crowded"]:
                    out.append((p["m"], p["ch"], int(p["copies"]), int(p["shift"]), data, 0, n, 0, 0, None))
                    continue
                raw = np.frombuffer(data, np.uint8)
                fine, content, lo, count, _ = segments(raw, np.full(len(raw), len(raw)), FINE_GRAM)
                at = np.arange(n)
                seen = Hashes(raw).of(at, at + LENGTH).view(np.int64)
                for f, c, x, k in zip(fine.view(np.int64).tolist(), content.view(np.int64).tolist(),
                                      lo.tolist(), count.tolist()):
                    out.append((p["m"], p["ch"], int(p["copies"]), int(p["shift"]), None, x, k, f, c, seen[x:x + k]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")])


FETCHED = ("m long, ch long, copies long, shift int, data binary, lo int, k int, fine long, part long, "
           "seen array<long>")


def crowded_repeats(parts: DataFrame) -> DataFrame:
    """(m, ch, lo, hi): repeated windows of the parts of crowded segments."""
    kinds = materialize(parts.groupBy("fine", "part").agg(F.sum("copies").alias("c"), F.first("seen").alias("seen")),
                        "fine-parts")
    several = kinds.groupBy("fine").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fine")
    windows = kinds.join(several, "fine").select("fine", "part", "c", F.posexplode("seen").alias("j", "w"))
    twice = windows.groupBy("fine", "w").agg(F.sum("c").alias("n")).where("n > 1").select("fine", "w")
    single = windows.where("c = 1").join(twice, ["fine", "w"], "left_semi") \
        .groupBy("fine", "part").agg(F.collect_list("j").alias("at"))
    whole = kinds.where("c > 1").select("fine", "part", F.lit(None).cast("array<int>").alias("at"))
    got = parts.select("m", "ch", "lo", "k", "fine", "part").join(whole.unionByName(single), ["fine", "part"])
    every = F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("k")).alias("b")))
    some = F.transform("at", lambda j: F.struct((F.col("lo") + j).alias("a"), (F.col("lo") + j + 1).alias("b")))
    return got.select("m", "ch", F.explode(F.coalesce(some, every)).alias("x")) \
        .select("m", "ch", F.col("x.a").alias("lo"), F.col("x.b").alias("hi"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): removed byte ranges of the documents that have any;
    ``th`` is the text's hash.  Ranges may touch or overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text"))
    # ids as text, since pandas would turn a nullable long into a float
    cut = rows.where(F.octet_length("text") >= LENGTH).withColumn("doc_id", F.col("doc_id").cast("string")) \
        .mapInPandas(_cut, "m long, ch long, doc_id string, th long, first long, n short, shift short")
    cut = materialize(cut.withColumn("doc_id", F.col("doc_id").cast("long")), "segments")
    again = materialize(cut.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m"), "again")
    cut = materialize(cut.join(again, "m", "left_semi"), "repeated-anchors")
    content = cut.groupBy("m", "ch").agg(F.count(F.lit(1)).alias("copies"),
                                         F.first(F.struct("doc_id", "th", "first", "n", "shift")).alias("one"))
    content = materialize(content, "contents")
    mixed = content.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1") \
        .select("m", (F.col("k") > CROWD).alias("crowded"))
    parts = content.join(mixed, "m").select("one.doc_id", "one.th", F.struct(
        "m", "ch", "copies", "crowded", "one.first", "one.n", "one.shift").alias("p")) \
        .groupBy(F.col("doc_id").alias("pk"), F.col("th").alias("ph")).agg(F.collect_list("p").alias("parts"))
    texts = rows.join(parts, F.col("doc_id").eqNullSafe(F.col("pk")) & (F.col("th") == F.col("ph")))
    texts = texts.select("text", "parts", "pk", "ph")
    fetched = materialize(texts.mapInPandas(_fetch, FETCHED).dropDuplicates(["m", "ch", "lo"]), "fetched")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = fetched.where("data is not null").select("m", "ch", "shift", "data") \
        .repartition(width, "m").sortWithinPartitions("m", "ch").mapInPandas(
            _sorted_columns, "m long, ch long, lo int, hi int")
    crowded = crowded_repeats(fetched.where("seen is not null"))
    partly = columns.unionByName(crowded).groupBy("m", "ch").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))
    whole = content.where("copies > 1").select("m", "ch", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("at"))
    partly = partly.join(whole.select("m", "ch"), ["m", "ch"], "left_anti")
    hit = materialize(whole.unionByName(partly), "repeats")
    found = cut.join(hit, ["m", "ch"]).select(
        "doc_id", "th", F.coalesce(F.transform("at", lambda x: F.struct(
            (F.col("first") + x["lo"]).alias("a"), (F.col("first") + x["hi"] + (LENGTH - 1)).alias("b"))),
            F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") + (LENGTH - 1)).alias("b")))).alias("s"))
    return found.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("s")).alias("spans"))  # repeated rows find the same


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The digest columns and the remaining text (``kept``, as bytes) of every row;
    a task hands on about ``HELD`` bytes of texts at once."""
    found = find_repeats(docs).select(F.col("doc_id").alias("fk"), F.col("th").alias("fh"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("fk")) & (F.xxhash64("text") == F.col("fh")), "left") \
        .select("doc_id", "text", F.transform("spans", lambda x: x["a"]).alias("a"), F.transform("spans", lambda x: x["b"]).alias("b"))

    def apply(batches):
        for pdf in batches:
            out, size = [], 0
            for doc_id, text, a, b in zip(pdf["doc_id"], _bytes(pdf["text"]), pdf["a"], pdf["b"]):
                spans = merged(list(zip(a.tolist(), b.tolist()))) if a is not None else []
                kept, at = [], 0
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
                size += len(rest)
                if size >= HELD:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return both.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(apply, RESULT) \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, then ``text``: what remains, where a code point that lost
    some of its bytes shows as U+FFFD (``kept_sha256`` is of the bytes)."""
    return remove_repeats(table(spark, sf_dir, "documents")) \
        .withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
