"""Language identification of mixed-language text (operator 1).

Script ranges narrow the candidate languages of every word; a Viterbi pass over
the per-word scores with a switching penalty then labels spans.

* **Model.** Letter trigrams, with word boundaries, are hashed into
  ``BUCKETS`` cells; one distributed count gives cell counts per language and
  the letters per script and language.  The driver receives at most
  ``labels x (BUCKETS + scripts)`` counts, whatever the corpus size.
* **Candidates.** A language is a candidate for a word if at least
  ``SCRIPT_SHARE`` of its training letters are of the word's script.  A word
  in a script that no language uses keeps every language as a candidate.
* **Viterbi.** A state per language, no cost to stay, ``penalty`` nats to
  switch; the documents of a chunk advance together, word by word.

Defined results: null, empty or letterless text is ``und`` with score 0 and no
spans; without any training row every text is ``und``; ties go to the language
that sorts first; repeated rows get equal labels; other columns pass through; more
than ``MAX_LABELS`` labels are an error (the counts of all are on the driver).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, codes_of, letter_table, lower_table, table

BUCKETS = 1 << 16
SCRIPT_SHARE = 0.01
PENALTY = 12.0
MAX_LABELS = 1024

# fixed values: Unicode block ranges of the scripts that separate languages
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x2FA1F),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for name, lo, hi in SCRIPT_RANGES:
        out[lo:hi + 1] = SCRIPTS.index(name)
    return out


@dataclass
class Words:
    """The letters of a chunk of documents and the words that they form."""

    cell: np.ndarray    # hashed trigram of every letter
    script: np.ndarray  # script of every letter
    first: np.ndarray   # index into the letters of each word's first letter
    start: np.ndarray   # position of each word within its document
    end: np.ndarray
    doc: np.ndarray     # document of each word


def split_words(texts: list[str]) -> Words:
    code = codes_of("\n".join(texts) + "\n")
    letter = letter_table()[code]
    low = lower_table()[code].astype(np.uint32)
    low[~letter] = 0
    at = np.flatnonzero(letter)
    prev, here = low[np.maximum(at - 1, 0)], low[at]
    prev[at == 0] = 0
    nxt = low[at + 1]
    cell = (prev * np.uint32(0x9E3779B1) + here * np.uint32(0x85EBCA6B) + nxt * np.uint32(0xC2B2AE35))
    cell = ((cell ^ (cell >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    opens = prev == 0
    first = np.flatnonzero(opens)
    begin = at[first]
    close = at[np.append(first[1:], len(at)) - 1] + 1 if len(first) else begin
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(offset, begin, side="right") - 1
    return Words(cell.astype(np.int64), script_table()[code[at]], first,
                 begin - offset[doc], close - offset[doc], doc)


@dataclass
class LanguageModel:
    """Cell log-probabilities by language and the scripts that each one uses."""

    labels: list[str]
    log_p: np.ndarray
    uses: np.ndarray

    def viterbi(self, score: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
        """Best label of every word; ``counts`` words per document, in order."""
        k = len(self.labels)
        label = np.zeros(len(score), np.int16)
        order = np.argsort(-counts, kind="stable")
        base = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        if not len(length) or not length[0]:
            return label
        active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
        came = np.empty((len(score), k), np.int16)
        best = score[base[:active[0]]].copy()
        last = np.empty((len(length), k), score.dtype)
        own = np.arange(k, dtype=np.int16)
        for t in range(1, length[0]):
            n = active[t]
            if n < len(best):
                last[n:len(best)] = best[n:]
                best = best[:n]
            row = base[:n] + t
            top = best.argmax(1)
            switch = best[np.arange(n), top] - penalty
            stay = best >= switch[:, None]
            came[row] = np.where(stay, own, top[:, None])
            best = np.where(stay, best, switch[:, None]) + score[row]
        last[:len(best)] = best
        now = last.argmax(1).astype(np.int16)
        for t in range(length[0] - 1, -1, -1):
            n = active[t]
            row = base[:n] + t
            label[row] = now[:n]
            if t:
                now[:n] = came[row, now[:n]]
        return label

    def spans(self, texts: list[str], penalty: float = PENALTY, detail: bool = True):
        """Per text: label, score and (if asked) the labelled spans."""
        out: list = [("und", 0.0, [])] * len(texts)
        if not self.labels:
            return out
        for group in chunks(texts):
            w = split_words([texts[i] for i in group])
            if not len(w.first):
                continue
            score = np.stack([np.add.reduceat(p[w.cell], w.first) for p in self.log_p], 1)
            allowed = self.uses[:, w.script[w.first]].T
            score[~allowed & allowed.any(1, keepdims=True)] -= 1e6
            counts = np.bincount(w.doc, minlength=len(group))
            label = self.viterbi(score, counts, penalty)
            size = (w.end - w.start).astype(np.int64)
            mass = np.bincount(w.doc * len(self.labels) + label, size, len(group) * len(self.labels))
            mass = mass.reshape(len(group), -1)
            top, total = mass.argmax(1), mass.sum(1)
            turn = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(w.doc, prepend=-1) != 0)) \
                if detail else np.empty(0, np.int64)
            stop = np.append(turn[1:], len(label)) - 1 if len(turn) else turn
            cut = np.searchsorted(w.doc[turn], np.arange(len(group) + 1))
            for j, i in enumerate(group):
                if total[j]:
                    found = [(int(w.start[a]), int(w.end[b]), self.labels[label[a]])
                             for a, b in zip(turn[cut[j]:cut[j + 1]], stop[cut[j]:cut[j + 1]])]
                    out[i] = (self.labels[top[j]], float(mass[j, top[j]] / total[j]), found)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count the letter trigrams of the rows whose label is not null."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches):
        width = BUCKETS + len(SCRIPTS)
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for label, part in pdf.groupby("lang")["text"]:
                texts = part.tolist()
                for group in chunks(texts):
                    w = split_words([texts[i] for i in group])
                    got = np.concatenate([np.bincount(w.cell, minlength=BUCKETS),
                                          np.bincount(w.script, minlength=len(SCRIPTS))])
                    total[label] = total.get(label, np.zeros(width, np.int64)) + got
        for label, got in total.items():
            cell = np.flatnonzero(got)
            yield pd.DataFrame({"lang": label, "cell": cell, "n": got[cell]})

    counted = rows.mapInPandas(count, "lang string, cell long, n long") \
        .groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    labels = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LABELS + 1).collect())
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} language labels")
    got = counted.toPandas()
    n = np.zeros((len(labels), BUCKETS + len(SCRIPTS)))
    if len(got):
        n[got["lang"].map({x: i for i, x in enumerate(labels)}), got["cell"]] = got["n"]
    cells, scripts = n[:, :BUCKETS] + 0.1, n[:, BUCKETS:]
    log_p = np.log(cells / cells.sum(1, keepdims=True)).astype(np.float32)
    return LanguageModel(labels, log_p, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1))


RESULT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def identify(model: LanguageModel, text: Column, penalty: float = PENALTY, detail: bool = True) -> Column:
    """A struct column (lang_pred, score, spans) for a text column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        got = model.spans(["" if t is None else t for t in texts], penalty, detail)
        return pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                             "spans": [[{"start": a, "end": b, "lang": c} for a, b, c in g[2]] for g in got]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, RESULT)(text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on_rest(docs: DataFrame) -> LanguageModel:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_on_rest(docs)
    found = identify(model, F.col("text"), detail=True)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("r")).select(
        "doc_id", "held_out", "r.lang_pred", "r.score", F.size("r.spans").alias("n_spans"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keep documents whose main language holds at least ``least`` of the letters."""
    model = fit_on_rest(docs)
    keep = identify(model, F.col("text"), detail=False)
    name = "_language" + "_" * sum(c.startswith("_language") for c in docs.columns)
    got = docs.withColumn(name, keep)
    return got.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
