"""Spelling variants of the corpus vocabulary (operator 12).

Words that differ by one inserted, deleted or replaced code point are near.  They
are found by a frontier of states (word, position, node, edits) in a trie: level
by level the states are joined with the distributed table of the trie's edges; a
state that has read its whole word with one edit at a terminal node names a
neighbour.  A pair is sought from one side: from the longer word, which drops a code
point, or from the word that is smaller where the two differ.

One edit lies in the first or in the second half of a word, so there are two
tries, of the words and of the words read backwards, and in each a word starts at
the node of its first half, where edits begin; the dense upper levels need no
states.  After its edit a state must find the rest of its word unchanged below its
node, so a node keeps two bitmaps of (length of the rest, last three code points)
of the words below it, and states that they exclude are dropped at once.  Nodes are 64-bit hashes of prefixes; a node is kept where words start,
end or part, and an edge carries the text between two kept nodes, so the number
of levels follows the branching of the vocabulary and not the length of its
longest word.  Every neighbour is compared with its word once more, so a
collision of hashes adds none.

Skew: words are counted in the tasks before the shuffle.  Nodes that many words
pass have their edges repeated under several salts, and a state picks one by its
word; while the trie is built such nodes (at most ``MOST_HOT``) are broadcast.
The frontier is written after every level, so a lost executor repeats one level.

Defined results: a null text has no words; a null doc_id is written as nothing
before the colon; repeated rows count again; words are compared as code points,
without normalisation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes_of, materialize, mix64, table

LEAST_LENGTH = 7
LEAST_COUNT = 2
SLIP = 31  # one (document, run) in this many loses a code point
FORM_RATIO = 10
HELD_WORDS = 150_000
SALT_WORDS = 20_000  # states of a node under one salt
MOST_HOT = 2_000
BROADCAST_BYTES = 4 << 20  # of a frontier that is counted
TAIL = 3  # code points of a word's end that a node's bitmaps tell apart
TAIL_BASE = 331
_RUNS = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH).findall
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def slips(doc_id: str, text: str) -> Counter:
    """Occurrences of a text's runs, lower-cased, some with one code point less."""
    counts: Counter = Counter()
    for run, n in Counter(_RUNS(text)).items():
        counts[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    start = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1:]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(wid, word, n): the words of ``docs`` (doc_id, text) that occur often enough."""

    def count(batches):
        held: Counter = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                if text:
                    held.update(slips(doc_id or "", text))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    # written, so that a number stays with its word
    return materialize(words.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")


def prefixes(words: DataFrame) -> DataFrame:
    """(wid, back, depth, node, next, starts, rest, tail): the nodes a word passes from
    the first half on, in both tries; ``next`` is the code point that follows, -1 at the
    word's end; ``starts`` where the word's frontier begins; ``tail`` stands for the last
    of the ``rest`` code points that follow."""

    def walk(batches):
        for pdf in batches:
            sizes = pdf["word"].str.len().to_numpy()
            for size in np.unique(sizes):
                here = pdf[sizes == size]
                codes = np.stack([codes_of(w) for w in here["word"]]).astype(np.int64)
                wid = here["wid"].to_numpy()
                for back in (0, 1):
                    line = codes[:, ::-1] if back else codes
                    node = np.full(len(here), 0x51ED27 + back, np.uint64)
                    tails = [np.zeros(len(here), np.int64)]
                    for j in range(TAIL):
                        tails.append(tails[-1] + line[:, -1 - j] * TAIL_BASE ** j)
                    for depth in range(size + 1):
                        ends = depth == size
                        if depth >= (size - 1) // 2:  # shorter neighbours start one level above
                            yield pd.DataFrame({
                                "wid": wid, "back": back, "depth": depth, "node": node.view(np.int64),
                                "next": -1 if ends else line[:, depth], "starts": depth == size // 2,
                                "rest": size - depth, "tail": tails[min(TAIL, size - depth)]})
                        if not ends:
                            node = mix64(node * np.uint64(0x9E3779B97F4A7C15) + line[:, depth].astype(np.uint64) + np.uint64(1))

    def joined(batches):  # one frame per task's batch, not one per level
        held, size = [], 0
        for frame in walk(batches):
            held.append(frame)
            size += len(frame)
            if size > 100_000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    return words.select("wid", "word").mapInPandas(
        joined, "wid long, back int, depth int, node long, next int, starts boolean, rest int, tail long")


def _bits(rest, tail):
    """The places of a (rest, tail) in a node's two bitmaps."""
    h = F.xxhash64(rest, tail)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.pmod(x, F.lit(64)).cast("int")) for x in (h, F.shiftright(h, 20))]


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first frontier and the edges of both tries.

    Frontier: (wid, left, node, width, edits), ``left`` what follows the state's position
    in its word, read in the trie's direction.  Edges: (node, salt, first, label, child, child_width, child_on, near,
    below0, below1): ``first`` begins the label, ``child_on`` if edges leave the
    child, ``near`` the word that ends there, ``below`` its bitmaps."""
    passed = prefixes(words)
    nodes = materialize(
        passed.groupBy("node").agg(F.count("*").alias("words"), F.min("next").alias("least"), F.max("next").alias("most"),
                                   F.max("starts").alias("starts"), F.max(F.when(F.col("next") == -1, F.col("wid"))).alias("near"),
                                   *[F.bit_or(b).alias(f"below{k}") for k, b in enumerate(_bits(F.col("rest"), F.col("tail")))])
        .where("starts or least = -1 or least <> most")
        .select("node", "words", F.ceil(F.col("words") / SALT_WORDS).cast("int").alias("width"),
                (F.col("most") >= 0).alias("on"), "near", "below0", "below1"), "nodes")
    total = nodes.agg(F.sum("words")).first()[0] or 0
    crowd = max(SALT_WORDS, total // MOST_HOT)  # fewer than MOST_HOT nodes hold that many
    hot, cold = nodes.where(F.col("words") > crowd), nodes.where(F.col("words") <= crowd)
    at = passed.select("wid", "back", "depth", "node", "starts")
    if hot.isEmpty():
        steps = at.join(nodes.hint("shuffle_hash"), "node")
    else:
        steps = at.join(F.broadcast(hot), "node").unionByName(
            at.join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold.hint("shuffle_hash"), "node"))
    paths = steps.groupBy("wid").agg(F.collect_list(F.struct(
        "back", "depth", "node", "width", "on", "near", "starts", "below0", "below1")).alias("steps")) \
        .join(words, "wid") \
        .select("wid", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), "steps", "word") \
        .select("wid", "back", F.when(F.col("back") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"),
                F.sort_array(F.filter("steps", lambda s: s["back"] == F.col("back"))).alias("steps"))
    paths = materialize(paths, "paths")

    def edge(a, b):
        return F.struct(
            a["node"].alias("node"), a["width"].alias("width"),
            F.substring(F.col("word"), a["depth"] + 1, b["depth"] - a["depth"]).alias("label"),
            b["node"].alias("child"), b["width"].alias("child_width"), b["on"].alias("child_on"),
            b["near"].alias("near"), b["below0"].alias("below0"), b["below1"].alias("below1"))

    count = F.size("steps")
    pairs = F.zip_with(F.slice("steps", F.lit(1), count - 1), F.slice("steps", F.lit(2), count - 1), edge)
    edges = paths.select(F.explode(pairs).alias("e")).select("e.*").distinct() \
        .withColumn("first", F.substring("label", 1, 1)) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).drop("width")
    begin = F.filter("steps", lambda s: s["starts"])[0]
    frontier = paths.select("wid", F.substring(F.col("word"), begin["depth"] + 1, F.length("word")).alias("left"),
                            begin["node"].alias("node"), begin["width"].alias("width"), F.lit(0).alias("edits"))
    return frontier, materialize(edges, "edges")


def advance(frontier: DataFrame, edges: DataFrame, small: bool = False) -> DataFrame:
    """The frontier one level below; ``near`` where a state names a neighbour.
    A state with its edit done goes on where the label is what it reads next; any other
    does so too, or with one edit within the label.  ``small``: the frontier is
    broadcast, else edges and states are shuffled by node and salt."""
    left, label, taken, edits = F.col("left"), F.col("label"), F.col("taken"), F.col("edits")
    size, m = F.length("left"), F.length("label")
    states = frontier.withColumn("salt", F.pmod(F.hash("wid"), F.col("width"))).drop("width")
    pairs = edges.join(F.broadcast(states), ["node", "salt"]) if small else states.join(edges.hint("shuffle_hash"), ["node", "salt"])
    # next: what the state reads next is how the label begins
    pairs = pairs.withColumn("next", F.substring(left, 1, 1) == F.col("first")) \
        .where((edits == 0) | (F.col("next") & F.startswith(left, label)))
    sums = [F.lit(0).cast("long")]  # of the last code points, as in prefixes()
    for j in range(TAIL):
        sums.append(sums[-1] + F.ascii(F.substring(left, -1 - j, 1)).cast("long") * F.lit(TAIL_BASE ** j))
    reads = F.when(edits == 1, F.array(m)).when(F.col("next"), F.array(F.lit(-1), m, m + 1)) \
        .otherwise(F.array(m, m + 1))  # -1: the label as it is, no edit; m: one replaced; m + 1: one dropped
    pairs = pairs.withColumn("tails", F.array(*sums)).withColumn("taken", F.explode(reads))
    bits = _bits(size - taken, F.get("tails", F.least(size - taken, F.lit(TAIL))))
    fits = (taken <= size) & (F.col("below0").bitwiseAND(bits[0]) != 0) & (F.col("below1").bitwiseAND(bits[1]) != 0)
    read = F.substring(left, F.lit(1), taken)
    smaller = (taken > m) | (read < label)
    within = F.levenshtein(read, label, 1) == 1
    # the edit is the label's first code point, the rest of the label follows
    at_first = F.substring(left, F.lit(2), F.when(taken > m, m).otherwise(m - 1)) \
        == F.when(taken > m, label).otherwise(F.substring(label, F.lit(2), m))
    moved = pairs.where(F.when(taken == -1, F.startswith(left, label)).otherwise(
        fits & F.when(edits == 1, True).otherwise(smaller & F.when(F.col("next"), within).otherwise(at_first)))) \
        .withColumn("edits", F.when(taken == -1, 0).otherwise(1)) \
        .withColumn("left", F.substring(left, F.when(taken == -1, m).otherwise(taken) + 1, size))
    rest = F.length("left")
    names = F.col("near").isNotNull() & (rest + edits == 1)  # an edit done and nothing left, or one code point too many
    on = F.col("child_on") & (rest > 0)
    return moved.select(
        "wid", "left", F.col("child").alias("node"), F.col("child_width").alias("width"), "edits", on.alias("on"),
        F.when(names, F.col("near")).alias("near")).where("on or near is not null")


def neighbours(words: DataFrame) -> DataFrame:
    """(wid, near, near_n) of every pair of near words of ``words`` (wid, word, n), both ways."""
    frontier, edges = trie(words)
    found, small = [], False
    while True:
        level = materialize(advance(frontier, edges, small), f"level{len(found)}")
        found.append(level.where("near is not null").select("wid", "near"))
        frontier = level.where("on").drop("on", "near")
        states, chars = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("left")), F.lit(0))).first()
        if not states:
            break
        small = states * 64 + 4 * chars <= BROADCAST_BYTES
    pairs = found[0]
    for level in found[1:]:
        pairs = pairs.unionByName(level)
    one = words.select("wid", F.struct("wid", "word", "n").alias("a"))
    two = words.select(F.col("wid").alias("near"), F.struct("wid", "word", "n").alias("b"))
    both = pairs.distinct().join(one, "wid").join(two, "near").where(F.levenshtein("a.word", "b.word") == 1)
    ways = F.explode(F.array(F.struct(F.col("a.wid").alias("wid"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")),
                             F.struct(F.col("b.wid").alias("wid"), F.col("a.word").alias("near"), F.col("a.n").alias("near_n"))))
    return both.select(ways.alias("x")).select("x.*")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (wid, word, n)."""
    best = neighbours(words).groupBy("wid").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    known = F.col("best.n") <= -FORM_RATIO * F.col("n")
    forms = materialize(
        words.join(best, "wid", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(known, F.col("best.word")).alias("form"), F.when(known, -F.col("best.n")).alias("form_n")), "forms")
    links = forms.where("form is not null").select("word", "form")
    step = links.select(F.col("word").alias("root"), F.col("form").alias("further"))
    roots, k = links.withColumnRenamed("form", "root"), 0
    while True:  # a form occurs ten times as often, so a chain is short
        moved = materialize(roots.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{k}")
        roots, k = moved.drop("moved"), k + 1
        if moved.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
