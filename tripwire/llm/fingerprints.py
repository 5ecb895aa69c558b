"""Document fingerprints by locally consistent parsing (operator 2).

Each level of a text's hierarchy is parsed as follows.  Runs of one symbol
become one symbol; deterministic coin tossing (the lowest bit in which a symbol
differs from its left neighbour, and that bit) is iterated until labels are
below six; phrases start at the local maxima of the labels; the name of a phrase
is a hash of its symbols, and the names are the symbols of the next level, up to
one symbol, the root.  A boundary depends on a few neighbours only, so equal
substrings get equal phrases but for a margin, at whatever offset they stand.

A text's marks are its root and the distinct names of all phrases from level
``FROM_LEVEL`` up, and the likeness of two texts is the share of common names among
all names of both (1 for equal roots): a shared passage counts for its length, however
long the texts.  The fingerprint that is written holds the root and the ``KEPT``
smallest names.

The query also needs each document's successor in descending doc_id.  Ids are
cut into ranges (splits from an approximate quantile of the ids alone), every
range is sorted in one task's stream, and the first document of each range is
sent to the range before it as well, so texts are shuffled once.

Defined results: null text is empty; a null id counts as the smallest; of rows
with equal ids the smaller text comes first; a single row is its own successor;
the likeness of two empty texts is 1, of an empty and another text 0; empty
tables give empty results; other columns pass.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, codes_of, mix64, table
from .minhash import powers

KEPT = 64
FROM_LEVEL = 2
RANGE_ROWS = 500
MOST_RANGES = 10_000
FIRST_ID = -(1 << 63)
BASE = 0x5851F42D4C957F2D
MOST_POWERS = 1 << 22
U = np.uint64
_LOW_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def toss(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six by deterministic coin tossing; neighbours differ in ``symbol``."""
    one = symbol.dtype.type(1)
    differ = np.empty_like(symbol)
    differ[0] = 1
    np.bitwise_xor(symbol[1:], symbol[:-1], out=differ[1:])
    differ[first] = 1
    if not differ.all():  # two names that collide
        differ[differ == 0] = 1
    low = np.bitwise_count((differ & (~differ + one)) - one)
    label = (low << 1) | ((symbol >> low.astype(symbol.dtype)) & one).astype(np.uint8)
    for _ in range(3):
        differ8 = np.empty_like(label)
        differ8[0] = 1
        np.bitwise_xor(label[1:], label[:-1], out=differ8[1:])
        differ8[first] = 1
        low = _LOW_BIT[differ8]
        label = (low << 1) | ((label >> low) & 1)
    return label


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2**64."""
    return powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)


def parse(symbol: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of a level, and where each document's begin; ``bounds`` are the
    documents' first places in ``symbol`` (32-bit code points or 64-bit names)."""
    first = np.zeros(len(symbol), bool)
    first[bounds] = True
    head = first.copy()
    head[1:] |= symbol[1:] != symbol[:-1]
    at = np.flatnonzero(head)
    size = np.diff(at, append=len(symbol))
    code = symbol.dtype == np.uint32
    run = np.flatnonzero(size > 1)
    if len(at) < len(symbol):
        bounds = np.searchsorted(at, bounds)
        symbol, first = symbol[at], first[at]
    symbol = _code_names()[symbol] if code else symbol.copy()
    symbol[run] = mix64(symbol[run].astype(np.uint64) + size[run].astype(np.uint64) * U(0x9E3779B97F4A7C15)).astype(symbol.dtype)
    label = toss(symbol, first)
    left = np.empty(len(label), bool)
    left[0] = False
    left[1:] = label[1:] > label[:-1]
    right = np.ones(len(label), bool)
    right[:-1] = (label[:-1] >= label[1:]) | first[1:]
    begin = first | (left & right)
    begin[1:] &= ~(begin[:-1] & ~first[1:])  # a phrase has two symbols at least
    start = np.flatnonzero(begin)
    length = np.diff(start, append=len(symbol))
    # a phrase's name: the sum of its symbols times powers by their place in it
    if len(symbol) <= MOST_POWERS:  # as a difference of sums over all before, with less memory traffic
        up, down = _powers(1 << max(16, int(len(symbol) - 1).bit_length()))
        sums = np.cumsum(symbol * up[:len(symbol)], dtype=np.uint64)
        part = sums[start + length - 1]
        part[1:] -= sums[start[1:] - 1]
        part *= down[start]
    else:
        place = np.arange(len(symbol)) - np.repeat(start, length)
        part = np.add.reduceat(symbol * powers(BASE, int(length.max()))[place], start)
    return mix64(part + length.astype(np.uint64)), np.searchsorted(start, bounds)


@lru_cache(maxsize=1)
def _code_names() -> np.ndarray:
    """A 32-bit name of every code point."""
    return (mix64(np.arange(0x110000, dtype=np.uint64) + U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.uint32)


def fingerprints(texts: list[str]) -> tuple[list[int], list[np.ndarray]]:
    """Root and all sorted names (from ``FROM_LEVEL`` up, 32 bits) of every text."""
    roots: list[int] = [0] * len(texts)
    held: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    for group in chunks(texts, 1_000_000):
        size = np.array([len(texts[i]) for i in group])
        live = np.flatnonzero(size)
        if not len(live):
            continue
        symbol = codes_of("".join(texts[i] for i in group))
        bounds = (np.cumsum(size) - size)[live]
        names = []
        level = 0
        while len(live):
            symbol, bounds = parse(symbol, bounds)
            level += 1
            count = np.diff(bounds, append=len(symbol))
            alone = count == 1
            for d, x in zip(live[alone], symbol[bounds[alone]]):
                roots[group[d]] = int(x)
            if level >= FROM_LEVEL or alone.any():
                doc = np.repeat(live, count)
                use = slice(None) if level >= FROM_LEVEL else np.repeat(alone, count)
                names.append((doc[use].astype(np.uint64) << U(32)) | (mix64(symbol[use] ^ U(0xABCDEF)) >> U(32)))
            if alone.any():
                symbol = symbol[np.repeat(~alone, count)]
                live, count = live[~alone], count[~alone]
                bounds = np.cumsum(count) - count
        key = np.unique(np.concatenate(names))
        cut = np.searchsorted(key >> U(32), np.arange(len(group) + 1, dtype=np.uint64))
        value = key.astype(np.uint32)
        for j, i in enumerate(group):
            held[i] = value[cut[j]:cut[j + 1]]
    return roots, held


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of common names among all names of two texts; 1 for equal roots."""
    if a[0] == b[0]:
        return 1.0
    x, y = (a[1], b[1]) if len(a[1]) <= len(b[1]) else (b[1], a[1])
    if not len(x):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return both / (len(x) + len(y) - both)


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _write(root: int, names: np.ndarray) -> str:
    return f"{root:016x}:{names[:KEPT].astype('>u4').tobytes().hex()}"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of (doc_id, text, next text); equal strings are parsed once."""
    index: dict[str, int] = {}
    third = [(index.setdefault(t, len(index)), index.setdefault(edited(t, n), len(index)),
              index.setdefault(n, len(index))) for _, t, n in rows]
    texts = list(index)
    marks = list(zip(*fingerprints(texts)))
    out = [(len(t), hashlib.sha256(texts[e].encode("utf-8", "surrogatepass")).hexdigest(),
            _write(*marks[a]), _write(*marks[e]), likeness(marks[a], marks[e]), likeness(marks[a], marks[b]))
           for (_, t, _), (a, e, b) in zip(rows, third)]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")][1:])
    frame.insert(0, "doc_id", pd.array([i if i != FIRST_ID else None for i, _, _ in rows], "Int64"))
    return frame


def _compare(batches):
    """Rows come sorted by range, the visiting row of each range last."""
    rows: list[tuple] = []
    size = 0
    before = None
    for pdf in batches:
        for rng, tail, doc_id, text in zip(pdf["rng"], pdf["tail"], pdf["id"], pdf["text"]):
            if before is not None and before[0] == rng:
                rows.append((before[1], before[2], text))
                size += 2 * len(before[2])
                if size > 8_000_000:
                    yield _frame(rows)
                    rows, size = [], 0
            before = None if tail else (rng, doc_id, text)
            if tail:  # further visitors repeat the first one's id
                before = None
    if rows:
        yield _frame(rows)


def with_successors(docs: DataFrame) -> DataFrame:
    """The fingerprint columns for every row and its successor."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("id")
    n = ids.count()
    parts = max(1, min(n // RANGE_ROWS, MOST_RANGES))
    splits = np.unique(ids.select(F.col("id").cast("double").alias("id"))
                       .approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else np.empty(0)

    def range_of(values: pd.Series) -> pd.Series:  # the largest ids are in range 0
        return pd.Series(len(splits) - np.searchsorted(splits, values.to_numpy().astype(float), side="left")).astype("int64")

    range_of.__annotations__ = {"values": pd.Series, "return": pd.Series}
    ranged = F.pandas_udf(range_of, "long")
    top = {r[0]: r[1] for r in ids.select(ranged("id").alias("rng"), "id").groupBy("rng").agg(F.max("id")).collect()}
    order = sorted(top)
    visits = {top[r]: order[k - 1] for k, r in enumerate(order)}

    def visited(values: pd.Series) -> pd.Series:
        return values.map(visits).astype("int64")

    visited.__annotations__ = {"values": pd.Series, "return": pd.Series}
    guests = rows.where(F.col("id").isin(list(visits))) \
        .select(F.pandas_udf(visited, "long")("id").alias("rng"), F.lit(1).alias("tail"), "id", "text")
    own = rows.select(ranged("id").alias("rng"), F.lit(0).alias("tail"), "id", "text")
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return own.unionByName(guests).repartition(width, "rng") \
        .sortWithinPartitions("rng", "tail", F.desc("id"), "text").mapInPandas(_compare, RESULT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(table(spark, sf_dir, "documents"))
