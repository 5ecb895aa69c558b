"""Repair of the turn structure of conversations (operator 11).

A conversation's turns are rewritten with the cheapest edits that make its role
initials fit ``(s?(ua)+)?``: Keep 0, Rerole 2, Delete 3, Insert 2; a turn that is
blank or repeats an earlier one must go, and a truncated turn that stays costs 1
more.  The edits form a lattice over (turns read, role state); its shortest path
is found by a Dijkstra search from both ends.  The heaps meet; every crossing of
the same cost is finished, and the crossing whose forward and backward audits
join to the least text (ASCII) decides.

Two prefixes of equal cost that reach one lattice node are never prefixes of one
another (the second would return to the node at no cost, and only edits that read
a turn are free), so the least prefix and the least suffix of a node give the least
audit through it.  For the same reason long conversations are solved in blocks of
``BLOCK`` turns: each block gives the best path for every pair of role states at
its ends, and the blocks are put together in order.

A task reads the sorted turns of a conversation as a stream and holds one byte per
turn, the audit and one batch, never the texts.  Repeats are found by a window over
text hashes, which streams as well.

Order: by turn, nulls first, then role, then SHA-256 of the text.  Defined results:
null roles and texts are one space (so a null text is blank); a null turn counts for
no gap; a null conv_id is a conversation of its own; an empty role has no initial
and cannot be kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 512
#: role states: nothing yet, after a system, user or assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, SHORT, GONE = 0, 4, 8  # a turn's code: initial + fault
NAMES = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def after(state: int, initial: int) -> int | None:
    """The role state after a turn of that initial; None if the turn may not stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if state == USER and initial == 2 else None


def _steps(codes: bytes, i: int, state: int):
    """(cost, letter, i, state) of the edits that leave a lattice node."""
    wanted = ASSISTANT if state == USER else USER
    yield INSERT, "I", i, wanted
    if i == len(codes):
        return
    initial, fault = codes[i] & 3, codes[i] & 12
    yield DELETE, "D", i + 1, state
    if fault != GONE:
        extra = TRUNCATED if fault == SHORT else 0
        kept = after(state, initial)
        if kept is not None:
            yield extra, "K", i + 1, kept
        yield REROLE + extra, "R", i + 1, wanted


def _steps_back(codes: bytes, i: int, state: int):
    """(cost, letter, i, state) of the edits that arrive at a lattice node."""
    if state in NAMES:
        sources = (USER,) if state == ASSISTANT else (START, SYSTEM, ASSISTANT)
        for s in sources:
            yield INSERT, "I", i, s
    else:
        sources = ()
    if not i:
        return
    initial, fault = codes[i - 1] & 3, codes[i - 1] & 12
    yield DELETE, "D", i - 1, state
    if fault != GONE:
        extra = TRUNCATED if fault == SHORT else 0
        for s in range(4):
            if after(s, initial) == state:
                yield extra, "K", i - 1, s
        for s in sources:
            yield REROLE + extra, "R", i - 1, s


@lru_cache(maxsize=100_000)
def shortest(codes: bytes, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit from role state ``begin`` to one of ``ends``; None without a path.

    Costs settle in order in both heaps; a heap's entries of equal cost come by audit,
    so a node settles with its least audit (backward audits grow at the front, so they
    settle by cost and compare whole).  Edits that cost nothing read a turn, so forward
    entries of one cost come by turns read, backward ones by turns left.
    """
    n = len(codes)
    forward: dict[tuple[int, int], tuple[int, str]] = {}
    backward: dict[tuple[int, int], tuple[int, str]] = {}
    ahead = [(0, 0, "", begin)]
    behind = [(0, -n, "", s) for s in ends]
    heapq.heapify(behind)
    best: tuple[int, str] | None = None

    def meet(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best[0]):
        if ahead[0][0] <= behind[0][0]:
            cost, i, audit, state = heapq.heappop(ahead)
            if (i, state) in forward:
                continue
            forward[i, state] = (cost, audit)
            if (i, state) in backward:
                more, rest = backward[i, state]
                meet(cost + more, audit + rest)
            for price, letter, j, to in _steps(codes, i, state):
                if (j, to) in backward:
                    more, rest = backward[j, to]
                    meet(cost + price + more, audit + letter + rest)
                if (j, to) not in forward:
                    heapq.heappush(ahead, (cost + price, j, audit + letter, to))
        else:
            cost, i, audit, state = heapq.heappop(behind)
            i = -i
            if (i, state) in backward:
                continue
            backward[i, state] = (cost, audit)
            if (i, state) in forward:
                more, rest = forward[i, state]
                meet(cost + more, rest + audit)
            for price, letter, j, source in _steps_back(codes, i, state):
                if (j, source) in forward:
                    more, rest = forward[j, source]
                    meet(more + price + cost, rest + letter + audit)
                if (j, source) not in backward:
                    heapq.heappush(behind, (cost + price, -j, letter + audit, source))
    return best


def audit_of(codes: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation of any length."""
    if len(codes) <= BLOCK:
        return shortest(codes, START, ENDS)
    reached = {START: (0, "")}
    for a in range(0, len(codes), BLOCK):
        block = codes[a:a + BLOCK]
        further: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in reached.items():
            for to in range(4):
                got = shortest(block, state, (to,))
                if got and (to not in further or (cost + got[0], audit + got[1]) < further[to]):
                    further[to] = (cost + got[0], audit + got[1])
        reached = further
    return min(reached[s] for s in ENDS if s in reached)


def turns(conversations: DataFrame) -> DataFrame:
    """The turns with nulls replaced, faults and order (``key``): conv_id stays as it is,
    ``conv`` is its text, null too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"))
    return rows.withColumn("key", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, key, initial, fault) of every turn, without the texts."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.select(
        "conv", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"),
        (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "key").orderBy(F.col("turn").asc_nulls_first()))
    return marked.withColumn("seen", seen > 1).select(
        "conv", "turn", "role", "key", "initial",
        F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(F.col("truncated"), 3).otherwise(0).cast("int").alias("fault"))


SUMMARY = ("conv string, turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` rows: its faults and its cheapest audit."""

    def one(conv, n, codes, first, last, known, counts, illegal):
        cost, audit = audit_of(bytes(codes))
        gaps = last - first + 1 - known if known else 0
        return (conv, n, gaps, counts[1], counts[2], counts[3], illegal, cost, audit)

    def run(batches):
        columns = [c.split()[0] for c in SUMMARY.split(", ")]
        conv, open_ = None, False
        for pdf in batches:
            done = []
            for name, turn, initial, fault in zip(pdf["conv"], pdf["turn"], pdf["initial"], pdf["fault"]):
                if not open_ or name != conv:
                    if open_:
                        done.append(one(conv, len(codes), codes, first, last, known, counts, illegal))
                    conv, open_, before, last = name, True, None, None
                    codes, first, known, counts, illegal = bytearray(), None, 0, [0] * 4, 0
                if turn is not None:
                    turn = int(turn)
                    known += turn != last
                    first, last = turn if first is None else first, turn
                if before is not None:
                    illegal += before + initial not in ("su", "ua", "au")
                before = initial
                counts[fault] += 1
                codes.append(INITIALS.get(initial, OTHER) + (GONE if fault in (1, 2) else SHORT if fault == 3 else FINE))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if open_:
            yield pd.DataFrame([one(conv, len(codes), codes, first, last, known, counts, illegal)], columns=columns)

    # the turn as text, since pandas would turn a nullable long into a float
    return faults(rows).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key") \
        .select("conv", F.col("turn").cast("string").alias("turn"), "initial", "fault").mapInPandas(run, SUMMARY)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns after the audits, conversation after
    conversation in every partition; removed turns have a null place."""

    def run(batches):
        for pdf in batches:
            out = []
            for conv, audit, role, text in zip(pdf["conv"], pdf["audit"], pdf["role"], pdf["text"]):
                if audit is not None:
                    todo, at, state, place = audit, 0, START, 0
                    own = False
                else:
                    own = True
                while at < len(todo):
                    letter = todo[at]
                    if letter != "I" and not own:
                        break
                    at += 1
                    if letter == "D":
                        out.append((conv, None, letter, role, text))
                        own = False
                        continue
                    if letter == "K":
                        state = after(state, INITIALS.get(role[:1], OTHER))
                        out.append((conv, place, letter, role, text))
                    else:
                        state = ASSISTANT if state == USER else USER
                        out.append((conv, place, letter, NAMES[state], text if letter == "R" else ""))
                    place += 1
                    own = own and letter == "I"
            columns = list(zip(*out)) if out else [()] * 5
            yield pd.DataFrame({"conv": list(columns[0]), "place": pd.array(columns[1], "Int64"),
                                "edit": list(columns[2]), "role": list(columns[3]), "text": list(columns[4])})

    first = audited.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), "audit")
    body = rows.select("conv", F.lit(1).alias("part"), "turn", "role", "key", "text", F.lit(None).cast("string").alias("audit"))
    return first.unionByName(body).repartition("conv") \
        .sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "key") \
        .select("conv", "audit", "role", "text").mapInPandas(run, "conv string, place long, edit string, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of ``repaired`` rows as they come, ``role:text`` joined by newlines."""

    def run(batches):
        conv, open_ = None, False
        for pdf in batches:
            done = []
            for name, place, role, text in zip(pdf["conv"], pdf["edit"] != "D", pdf["role"], pdf["text"]):
                if not open_ or name != conv:
                    if open_:
                        done.append((conv, state.hexdigest()))
                    conv, open_, state, some = name, True, hashlib.sha256(), False
                if place:
                    state.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
            yield pd.DataFrame(done, columns=["conv", "sha256"])
        if open_:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha256"])

    return lines.mapInPandas(run, "conv string, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2
    removes its [.!?], 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = turns(damage(given))
    audited = materialize(audits(rows), "audits")
    hashes = digests(repaired(rows, audited))
    every = given.select(F.col("conv_id").cast("string").alias("conv")).distinct()
    result = every.join(audited, every["conv"].eqNullSafe(audited["conv"]), "left").drop(audited["conv"])
    result = result.join(hashes, result["conv"].eqNullSafe(hashes["conv"]), "left").drop(hashes["conv"])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
               ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return result.select(
        F.col("conv").cast("long").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
