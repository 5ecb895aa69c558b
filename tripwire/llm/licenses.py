"""License scans with a generalised suffix automaton (operator 5).

The word sequences of all licence templates go into one generalised suffix
automaton.  A text's words are streamed through it and give matching statistics:
at every word the length of the longest suffix that occurs in some template, and
where.  Long matches of one template are chained, in the order of the template
and with small gaps, into covered spans; a template whose covered share reaches
``COVERED`` gives its label.  Templates are sections of the licences' texts
(``license_texts.py``), so a section alone is found.  Of spans that overlap by half
or more the one that covers most words stays, then the one with the larger share, so
a notice that differs from another licence's in one word is not labelled as both.
The base phrases are short templates of their own: a place counts wherever the match
is as long as the phrase and is the phrase.

Words outside the templates' vocabulary reset the automaton, so only runs of
vocabulary words are walked.  The automaton has fixed size and travels with the
function; texts are scanned where they are read, without a shuffle.

Defined results: words are runs of ASCII letters, digits and all non-ASCII
characters, with only A-Z lower-cased; null text is empty; a text without a
match has no labels, null places and score 0; repeated rows get equal results;
empty tables give empty results; other columns pass.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import SECTIONS

LEAST_MATCH = 4
MOST_GAP = 12
COVERED = 0.6

# fixed values: base phrases and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with end positions."""

    def __init__(self, sequences: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in sequences]
        for t, s in enumerate(self.sequences):
            last = 0
            for i, c in enumerate(s):
                last = self._extend(last, c)
                self.ends[last].append((t, i))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(go)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that are as long as p's, plus c."""
        half = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        self.link[q] = half
        return half

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def statistics(self, ids: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word of a run."""
        state = size = 0
        out = []
        go, link, length = self.next, self.link, self.length
        for c in ids:
            while state and c not in go[state]:
                state = link[state]
                size = length[state]
            if c in go[state]:
                state, size = go[state][c], size + 1
            out.append((state, size))
        return out


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton([p.encode().split() for p in BASE] + [words_of(t) for _, t in SECTIONS])


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Best chains of one template's matches (word, position in the template,
    length; sorted): (covered words, first word, last word + 1) of each chain.  A
    match follows any that ends at most ``MOST_GAP`` words before it."""
    best: list[tuple[int, int, int, int]] = []  # end, covered, first, template end; by end
    for word, at, size in matches:
        own = (size, word)
        for end, covered, first, upto in best[bisect_left(best, (word - MOST_GAP,)):]:
            skip = max(0, end - word, upto - at)
            if skip < size and at - upto <= MOST_GAP and first < word and (covered + size - skip, -first) > (own[0], -own[1]):
                own = (covered + size - skip, first)
        insort(best, (word + size, own[0], own[1], at + size))
    return [(c, f, e) for e, c, f, _ in best]


def apart(spans: list[tuple[int, float, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """Of (covered, share, first, end, label) those that no better one overlaps by half."""
    kept: list[tuple[str, int, int, float]] = []
    for covered, share, first, end, label in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], s[4])):
        if all(2 * (min(end, e) - max(first, f)) < min(end - first, e - f) for _, f, e, _ in kept):
            kept.append((label, first, end, share))
    return sorted(kept)


def scan(text: str) -> dict:
    """Places of base phrases and covered template spans of one text."""
    auto = automaton()
    words = words_of(text)
    get = auto.vocabulary.get
    ids = np.array([get(w, -1) for w in words], np.int32)
    known = np.flatnonzero(ids >= 0)
    places: list[tuple[int, str]] = []
    long: dict[int, list[tuple[int, int, int]]] = {}
    if len(known):
        turn = np.flatnonzero(np.diff(known, prepend=-2) != 1)
        stop = np.append(turn[1:], len(known))
        phrases = [(tuple(s), label) for s, label in zip(auto.sequences, BASE.values())]
        for a, b in zip(turn[stop - turn > 1], stop[stop - turn > 1]):
            first = int(known[a])
            run = ids[known[a:b]].tolist()
            found = auto.statistics(run)
            for i, (state, size) in enumerate(found):
                if size < 2:
                    continue
                for phrase, label in phrases:
                    k = len(phrase)
                    if size >= k and tuple(run[i - k + 1:i + 1]) == phrase:
                        places.append((first + i - k + 1, label))
                ends = i + 1 == len(found) or found[i + 1][1] <= size  # it cannot be extended
                if ends and size >= LEAST_MATCH:
                    for t, at in auto.ends[state]:
                        if t >= len(BASE):
                            long.setdefault(t, []).append((first + i - size + 1, at - size + 1, size))
    spans = []
    for t, matches in long.items():
        label, size = SECTIONS[t - len(BASE)][0], len(auto.sequences[t])
        spans += [(min(covered, size), min(1.0, covered / size), first, end, label)
                  for covered, first, end in chain(sorted(matches)) if covered >= COVERED * size]
    spans = apart(spans)
    return {"n_words": len(words), "places": sorted(places), "spans": spans}


RESULT = ("doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The digest of ``scan`` for every row (doc_id, text)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                got = scan(text or "")
                at = [p for p, _ in got["places"]]
                base = sorted({label for _, label in got["places"]})
                every = sorted({*base, *(s[0] for s in got["spans"])})
                rows.append((doc_id, got["n_words"], len(at), at[0] if at else None, at[-1] if at else None,
                             ",".join(base), ",".join(every),
                             1.0 if at else max((s[3] for s in got["spans"]), default=0.0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype(
                {"first_word": "Int64", "last_word": "Int64"})

    # ids as text, since pandas would turn a nullable long into a float
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
