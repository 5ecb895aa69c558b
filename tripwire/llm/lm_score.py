"""Cross-entropy difference scores of documents (operator 7).

Two interpolated bigram models share one vocabulary: every word of the corpus,
plus one class for unseen words and one for the start of a text.  The target
model counts the documents labelled of high quality and not toxic, the
background model counts every document; order, smoothing and vocabulary are the
same.  A document's score is the mean over its tokens of target loss minus
background loss, so lower is more like the target.

The counts are never in one place.  Documents are put in chunks of about
``CHUNK_TOKENS`` tokens, written once as word numbers.  A chunk sends each of its
distinct words and bigrams once, with its own counts, to the range of hashes
(bucket) the word or bigram falls in; a bucket adds up what all chunks sent and
answers each chunk with the totals.  A chunk then scores its documents from the
totals of its own words and bigrams.  A bucket gets a word or bigram at most once
per chunk, however frequent it is, so no key is one task's load; the number of
buckets follows the number of entries sent.  The driver holds five numbers.

Words and bigrams are told apart by 63-bit hashes.

Defined results: null and wordless texts have no tokens and null score and
losses; without target documents the target model is uniform; null labels do
not count; a document labelled more than once is a target if any of its labels
is; repeated rows get equal scores; empty tables give empty results; other
columns pass.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, table

VOCABULARY = None  # words with a class of their own: all
BIGRAM_SHARE = 0.7
ADDED = 0.5
CHUNK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 20
LEAST_BUCKETS = 64
COUNTS = ("n", "target", "n_last", "target_last")
_WORDS = re.compile(r"\w+").findall
_START = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes plane by plane, compressed (the upper planes are nearly constant)."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def spread(held: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after one byte that says how many."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + squeeze(counts.astype(kind))


def unpack(held: bytes) -> np.ndarray:
    return spread(held[1:], np.dtype(f"u{held[0]}")).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes: five random byte planes as they are, the upper three compressed."""
    planes = keys.view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def unpack_keys(held: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(held[:5 * size] + zlib.decompress(held[5 * size:]), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def chunked(docs: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """Documents (doc_id, text) in chunks of word numbers; number 0 is the start."""

    def chunk(batches):
        part, made = TaskContext.get().partitionId(), 0
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1
        doc_ids, ids, held = [], [], 0

        def row():
            sizes = np.array([len(x) for x in ids], np.int64)
            words = pd.util.hash_array(np.array(list(number), object), categorize=False) if number else np.empty(0, np.uint64)
            return pd.DataFrame([{
                "chunk": (part << 32) + made, "n": int(sizes.sum()), "n_started": int((sizes > 0).sum()),
                "doc_ids": squeeze(np.array([0 if x is None else x for x in doc_ids], np.int64)),
                "no_id": squeeze(np.array([x is None for x in doc_ids], bool)), "sizes": squeeze(sizes),
                "words": words.tobytes(), "ids": squeeze(np.concatenate(ids))}])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                here = tokens(text)
                doc_ids.append(doc_id)
                ids.append(np.fromiter(map(number.__getitem__, here), np.int32, len(here)))
                held += len(here) + 1
                if held >= most:
                    yield row()
                    made, held = made + 1, 0
                    number.clear()
                    doc_ids, ids = [], []
        if ids:
            yield row()

    # the id as text, since pandas would turn a nullable long into a float
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        chunk, "chunk long, n long, n_started long, doc_ids binary, no_id binary, sizes binary, words binary, ids binary")


def marked(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk, place, size) of every document that the target model counts."""

    def places(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                frame = pd.DataFrame({"chunk": row.chunk, "doc_id": spread(row.doc_ids, np.int64), "size": spread(row.sizes, np.int64)})
                yield frame.assign(place=np.arange(len(frame)))[~spread(row.no_id, bool)]

    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    return chunks.select("chunk", "doc_ids", "no_id", "sizes") \
        .mapInPandas(places, "chunk long, doc_id long, size long, place int") \
        .join(good, "doc_id", "left_semi").select("chunk", "place", "size")


class Chunk:
    """The words and bigrams of a chunk: ``keys`` (words, then bigrams), their own
    counts, and where each token's word and bigram stand."""

    def __init__(self, row):
        self.sizes = spread(row.sizes, np.int64)
        self.flags = np.zeros(len(self.sizes), bool)
        if row.places is not None:
            self.flags[np.asarray(row.places)] = True
        self.ids = spread(row.ids, np.int32).astype(np.int64)
        words = np.frombuffer(row.words, np.uint64)
        self.width = len(words) + 1
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.append(0, ends[:-1])[:len(ends)]] = 0
        pairs, self.at = np.unique(before * self.width + self.ids, return_inverse=True)
        self.left, self.right = pairs // self.width, pairs % self.width
        both = np.append(_START, words)
        one, two = mix64(words), mix64(mix64(both[self.left]) * np.uint64(3) + both[self.right])
        self.keys = np.concatenate([one | np.uint64(1), two & ~np.uint64(1)])
        self.order = np.argsort(self.keys, kind="stable")
        wanted = np.repeat(self.flags, self.sizes)
        last, last_wanted = self.ids[ends - 1], self.flags[self.sizes > 0]
        none = np.zeros(len(pairs), np.int64)
        count = lambda x, size: np.bincount(x, minlength=size)
        self.counts = [np.concatenate([count(self.ids, self.width)[1:], count(self.at, len(pairs))]),
                       np.concatenate([count(self.ids[wanted], self.width)[1:], count(self.at[wanted], len(pairs))]),
                       np.concatenate([count(last, self.width)[1:], none]),
                       np.concatenate([count(last[last_wanted], self.width)[1:], none])]


def sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """What every chunk sends to every bucket, sorted by hash."""

    def send(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                c = Chunk(row)
                keys, counts = c.keys[c.order], [x[c.order] for x in c.counts]
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)) if len(keys) else np.zeros(1, np.int64)
                out = [(int(bucket[i]), row.chunk, j - i, pack_keys(keys[i:j]), *(pack(x[i:j]) for x in counts))
                       for i, j in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame(out, columns=["bucket", "chunk", "size", "keys", *COUNTS])

    return chunks.mapInPandas(send, "bucket int, chunk long, size int, keys binary, " + ", ".join(f"{c} binary" for c in COUNTS))


def totals(entries: DataFrame) -> DataFrame:
    """The entries with the counts of all other chunks in place of the chunk's own."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x, size) for x, size in zip(pdf["keys"], pdf["size"])]
        cut = np.cumsum(pdf["size"])[:-1]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        out = pdf[["bucket", "chunk"]].copy()
        for c in COUNTS:
            own = np.concatenate([unpack(x) for x in pdf[c]])
            total = np.bincount(at, weights=own, minlength=len(every)).astype(np.int64)[at]
            out[c] = [pack(x) for x in np.split(total - own, cut)]
        return out

    return entries.groupBy("bucket").applyInPandas(
        add, "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in COUNTS))


def losses(pair: np.ndarray, before: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Negative log probabilities of bigrams, interpolated with unigrams."""
    share = np.where(before > 0, BIGRAM_SHARE, 0.0)
    return -np.log(share * pair / np.maximum(before, 1) + (1 - share) * single)


def score_documents(docs: DataFrame, labels: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialize(chunked(rows, chunk_tokens), "lm-chunks")
    marks = materialize(marked(chunks, labels), "lm-targets")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    size = chunks.agg(total("n").alias("n"), total("n_started").alias("n_started")).first().asDict()
    size |= marks.agg(total("size").alias("target"), F.count_if(F.col("size") > 0).alias("target_started")).first().asDict()

    def words(batches):
        for pdf in batches:
            for held in pdf["words"]:
                yield pd.DataFrame({"word": np.frombuffer(held, np.int64)})

    size["classes"] = chunks.select("words").mapInPandas(words, "word long").distinct().count() + 2
    # the text never moves: chunks meet their marks, are sent and scored from one exchange
    chunks = chunks.join(marks.groupBy("chunk").agg(F.collect_list("place").alias("places")), "chunk", "left")
    entries = sent(chunks, max(LEAST_BUCKETS, size["n"] // BUCKET_KEYS))

    def score(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        got = got.sort_values("bucket")
        for row in mine.itertuples():
            c = Chunk(row)
            loss = []
            for k, name in ((1, "target"), (0, "n")):
                total, last = c.counts[k].copy(), c.counts[k + 2].copy()
                if len(c.keys):
                    total[c.order] += np.concatenate([unpack(x) for x in got[name]])
                    last[c.order] += np.concatenate([unpack(x) for x in got[f"{name}_last"]])
                single = np.append(0, total[:c.width - 1])
                before = np.append(size[f"{name}_started"], total[:c.width - 1] - last[:c.width - 1])
                chance = (single + ADDED) / (size[name] + ADDED * size["classes"])
                each = losses(total[c.width - 1:], before[c.left], chance[c.right])[c.at]
                doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
                loss.append(np.bincount(doc, weights=each, minlength=len(c.sizes)) / np.maximum(c.sizes, 1))
            none = c.sizes == 0
            ids = pd.array(spread(row.doc_ids, np.int64), "Int64")
            ids[spread(row.no_id, bool)] = pd.NA
            frame = pd.DataFrame({"doc_id": ids, "n_tokens": c.sizes})
            for name, x in (("target_loss", loss[0]), ("background_loss", loss[1]), ("score", loss[0] - loss[1])):
                frame[name] = pd.array(x, "Float64")
                frame.loc[none, name] = pd.NA
            out.append(frame)
        return pd.concat(out)

    return chunks.groupBy("chunk").cogroup(totals(entries).groupBy("chunk")).applyInPandas(
        score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
