"""Packing documents into sequences of at most ``SEQUENCE`` tokens (operator 13).

A document's ids come from a public tokenizer, followed by ``END``.  Its full
``SEQUENCE``-token pieces are sequences of their own; what is left over (shorter
than a sequence) is packed by first-fit decreasing.  Every leftover falls in a
randomised group of about ``GROUP_TOKENS`` tokens; a group is packed on its own,
with a tournament tree over its bins' free room: the leftmost bin with enough
room is found by descending from the root.  Bins that stay neither full nor at a
power of two are levelled: the emptiest give their pieces, cut where needed, to
the gaps of the fullest, and the last bin of a group is cut into sequences of
powers of two.  So no sequence is padded.

Ids are found word by word: a text may be cut before a single space that stands
between two characters that are no white space, for this pre-tokeniser never
joins across such a place.  A task remembers the ids of about ``CACHED`` words.
A text is handled whole; a group holds its leftovers' ids only, two bytes each.
Groups are dealt in a written table, so a lost executor repeats the same groups.

Defined results: a null or empty text is the id ``END`` alone; special tokens'
strings in a text are ordinary text; a null doc_id stays null; repeated rows are
packed each on its own; an empty table gives no pieces; other columns are not
read.  Sequence ids are unique, not dense.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, table

SEQUENCE = 1024
END = 0
GROUP_TOKENS = 1 << 22
CACHED = 1_500_000  # about 300 MB in a task
LONGEST_CACHED = 64
SEED = 13
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
_DOUBLE = re.compile(r"\s\s").search
_PARTS = re.compile(r"(?<=\S) (?=\S)").split

PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder(dict):
    """Ids of texts by a byte-level tokenizer: a dictionary of words and their ids as
    32-bit numbers, filled as words come."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer):
            raise ValueError("words are cut for byte-level tokenizers without a normalizer")
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model.tokenize
        self.shown = {c: self.cut(chr(c))[0][0] for c in range(0x250) if chr(c).isalpha()}  # letters in the model's alphabet
        self.shown[32] = "\u0120"

    @staticmethod
    def words(text: str) -> list[str]:
        """The text in parts that are tokenised independently of each other."""
        if not text:
            return []
        if _DOUBLE(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = _PARTS(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def __missing__(self, part: str) -> bytes:
        core = part.rstrip(_MARKS)  # marks after a letter are a pre-token of their own
        if _WORD(core):
            if len(core) < len(part):
                ids = self[core] + self[part[len(core):]]
            else:
                ids = array("I", [t.id for t in self.model(core.translate(self.shown))]).tobytes()
        else:
            ids = array("I", [t.id for p, _ in self.cut(part) for t in self.model(p)]).tobytes()
        if len(part) <= LONGEST_CACHED:
            self[part] = ids
        return ids

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text, without the closing one."""
        for text in texts:
            if len(self) > CACHED:
                self.clear()
            yield np.frombuffer(b"".join(map(self.__getitem__, self.words(text))), "<u4")


class Tournament:
    """Free room of bins in a complete binary tree: a node holds the most of its two."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The leftmost bin with that much room (the caller has made sure of one)."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        return node - self.size

    def take(self, place: int, need: int) -> None:
        room, node = self.room, place + self.size
        room[node] -= need
        node >>= 1
        while node:
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node >>= 1


def first_fit_decreasing(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers; longest items first, ties by number."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree = Tournament(len(lengths), size)
    bins: list[list[int]] = []
    for i in order:
        place = tree.first(lengths[i])
        tree.take(place, lengths[i])
        if place == len(bins):
            bins.append([])
        bins[place].append(i)
    return bins


def _even(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def level(bins: list[list[int]], lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to): bins that need no padding stay whole, the gaps of
    the others are filled from the emptiest, and the last is cut at powers of two."""
    out, open_ = [], []
    for items in bins:
        held = sum(lengths[i] for i in items)
        (out if _even(held) else open_).append([(i, 0, lengths[i]) for i in items])
    open_.sort(key=lambda pieces: -sum(b - a for _, a, b in pieces))
    left, right = 0, len(open_) - 1
    while left < right:
        gap = size - sum(b - a for _, a, b in open_[left])
        while gap and left < right:
            i, a, b = open_[right].pop()
            take = min(gap, b - a)
            open_[left].append((i, a, a + take))
            gap -= take
            if a + take < b:
                open_[right].append((i, a + take, b))
            if not open_[right]:
                right -= 1
        if not gap:
            left += 1
    out += open_[:left]
    if left == right:  # one bin is left
        rest, part, held = list(open_[left]), [], 0
        total = sum(b - a for _, a, b in rest)
        want = 1 << (total.bit_length() - 1)
        while rest:
            i, a, b = rest.pop(0)
            take = min(want - held, b - a)
            part.append((i, a, a + take))
            held += take
            if a + take < b:
                rest.insert(0, (i, a + take, b))
            if held == want:
                out.append(part)
                total -= want
                want, part, held = 1 << max(total.bit_length() - 1, 0), [], 0
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """Every full piece, with its sequence, and every leftover, with its ids and a
    random number that decides its group."""

    def run(batches):
        encode = _encoder(path)
        kind = np.uint16 if encode.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        made = 0
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode([x or "" for x in pdf["text"]])):
                ids = np.append(ids, np.uint32(END))
                full = len(ids) // SEQUENCE * SEQUENCE
                for a in range(0, full, SEQUENCE):
                    made += 1
                    rows.append((doc_id, a, SEQUENCE, _crc(ids[a:a + SEQUENCE]), len(ids),
                                 (1 << 62) + (part << 40) + made, None, None))
                if full < len(ids):
                    made += 1
                    deal = int(mix64(np.array([(part << 40) + made + (seed << 56)], np.uint64))[0] >> np.uint64(1))
                    rows.append((doc_id, full, len(ids) - full, None, len(ids), None, deal, ids[full:].astype(kind).tobytes()))
            # nullable columns apart, for a frame of tuples would turn them into floats
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pd.DataFrame({
                name: pd.array(column, "Int64") if name in ("ids_crc32", "sequence_id", "deal") else list(column)
                for name, column in zip(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "deal", "ids"], columns)})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, PIECE + ", sequence_id long, deal long, ids binary")


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    group = int(pdf["group"].iloc[0])
    pdf = pdf.sort_values("deal")  # the same order whatever the shuffle
    lengths = pdf["length"].tolist()
    starts, totals, doc_ids, raw = pdf["start"].tolist(), pdf["doc_tokens"].tolist(), pdf["doc_id"].tolist(), pdf["ids"].tolist()
    ids = [np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32) for x, n in zip(raw, lengths)]
    rows = []
    for k, sequence in enumerate(level(first_fit_decreasing(lengths), lengths)):
        offset = 0
        for i, a, b in sequence:
            rows.append((doc_ids[i], starts[i] + a, b - a, _crc(ids[i][a:b]), totals[i], (group << 32) + k, offset))
            offset += b - a
    return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of every document (doc_id, text): where it lies and in which sequence."""
    cut = materialize(pieces(docs, path), "pieces")
    rest = cut.where("deal is not null")
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    packed = rest.withColumn("group", F.col("deal") % F.lit(groups)) \
        .select("group", "deal", "doc_id", "start", "length", "doc_tokens", "ids") \
        .groupBy("group").applyInPandas(_pack_group, PIECE + ", sequence_id long, offset long")
    whole = cut.where("deal is null").drop("deal", "ids").withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
