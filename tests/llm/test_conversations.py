"""Conversation repair against a plain search over all edits."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

from tripwire.llm import conversations as c

SPACE = set(" \t\n\x0b\x0c\r")


def plain_audit(rows):
    """Cheapest, then least: ``rows`` of (initial, fault)."""

    def after(state, initial):
        text = state + initial
        return text if re.fullmatch("s?(ua)*u?", text) and initial in ("s", "u", "a") else None

    short = {"": "", "s": "s"}

    @functools.cache
    def best(i, state, inserts):
        # a state is its shortest equal text: '', s, u or ua (what follows is the same)
        found = []
        if i == len(rows) and state in ("", "ua"):
            found.append((0, ""))
        if inserts < 2:
            to = "ua" if state == "u" else "u"
            cost, audit = best(i, to, inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for letter, role, price in (("K", initial, 0), ("R", "u", 2), ("R", "a", 2)):
                    to = after(state, role)
                    if to is None:
                        continue
                    to = short.get(to, "ua" if to[-1] == "a" else "u")
                    cost, audit = best(i + 1, to, 0)
                    found.append((cost + price + extra, letter + audit))
        return min(found) if found else (10 ** 9, "")

    return best(0, "", 0)


def plain(given):
    """The contract's columns of rows (conv_id, turn, role, text)."""
    held = collections.defaultdict(list)
    for conv_id, turn, role, text in given:
        here = held[conv_id]
        show = lambda x: " " if x is None else x
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for turn, role, text in rows:
            kept = [x for x in text if x not in SPACE]
            fault = ("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = plain_audit(marked)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines, left, state = [], iter(rows), ""
        for letter in audit:
            if letter == "I":
                state = "assistant" if state == "user" else "user"
                lines.append(state + ":")
                continue
            turn, role, text = next(left)
            if letter == "D":
                continue
            state = role if letter == "K" else "assistant" if state == "user" else "user"
            lines.append(f"{state}:{text}")
            state = {"u": "user", "a": "assistant", "s": "system"}[state[0]]
        number = collections.Counter(f for _, f in marked)
        pairs = [a + b for (a, _), (b, _) in itertools.pairwise(marked)]
        out[conv_id] = (gaps, number["blank"], number["duplicate"], number["truncated"],
                        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answer(spark, folder):
    rows = c.op11_conversations(spark, str(folder)).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = answer(spark, sf_dir)
    assert got == plain(given) and any("I" in r[6] for r in got.values())


def test_edge_cases(spark, tmp_path):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", None, "User"], ["Yes.", "No!", "cut", " \t", "", None, "Why? ", "a.\n", "…"]
    big = (1 << 60) + 1
    rows = [(rng.choice([None, big, big + 1, *range(200)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += [(500, t, "user", f"Turn {t}.") for t in range(40)] + [(501, 3, "user", "Same.")] * 30
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, cost string")
    df.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    assert answer(spark, tmp_path) == plain(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert answer(spark, f"{tmp_path}/none") == {}


def test_search_and_blocks(monkeypatch):
    rng = random.Random(2)
    names = {0: "", c.SHORT: "truncated", c.GONE: "blank"}
    for k in range(400):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, c.SHORT, c.GONE]) for _ in range(rng.randint(0, 14)))
        want = plain_audit(tuple(("suax"[x & 3], names[x & 12]) for x in codes))
        assert c.shortest(codes, c.START, c.ENDS) == want, codes
        monkeypatch.setattr(c, "BLOCK", rng.randint(1, 5))
        assert c.audit_of(codes) == want
