"""Spelling variants against a search by deletions over a plain vocabulary."""

import collections
import random
import re
import zlib

from tripwire.llm import spelling


def plain_words(docs):
    total = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain(words):
    groups = collections.defaultdict(set)
    for w in words:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1:]].add(w)
    links = collections.defaultdict(set)
    for members in groups.values():
        for a in members:
            links[a].update(b for b in members if near(a, b))
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in links[w]), default=(0, ""))
        if -best[0] >= 10 * n:
            form[w] = best[1]
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(links[w]), words.get(form.get(w))))
    return out


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in spelling.op12_spelling(spark, sf_dir).collect()]
    want = plain(plain_words(docs))
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] for r in want)


def test_edge_cases(spark, monkeypatch):
    """Long words, doubled letters, crowded prefixes under several salts, no ids, no texts."""
    monkeypatch.setattr(spelling, "SALT_WORDS", 5)
    rng = random.Random(3)
    long = "".join(rng.choices("abc", k=4000))
    words = [long, long[:2000] + "z" + long[2000:], long[:-1], "a" * 9, "a" * 10, "a" * 11, "b" + "a" * 9, "aaaaaaab", "ÀÉÎÕÜßÿ", "Àéîõüßÿ"]
    words += ["prefixed" + "".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(60)]
    words += ["".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(150)]
    docs = [(k if k % 5 else None, " ".join(rng.choices(words, k=40)) + " AAAAAAAAA. word12word") for k in range(60)]
    docs += [((1 << 60) + 1, "prefixed " * 500), (5, None), (6, ""), (7, "7 ..."), (7, "prefixed"), (7, "prefixed")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int").repartition(5)
    got = {tuple(r) for r in spelling.variants(spelling.vocabulary(df)).collect()}
    assert got == plain(plain_words(docs))
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
