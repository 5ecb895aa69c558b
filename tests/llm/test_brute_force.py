"""Every corpus operator against a plain computation on the smallest tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.llm import decontaminate, fingerprints, language_id, licenses, lm_score, minhash, mixing, pii, registry, substrings
from tripwire.plans.oracle import compare


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, duck, sf_dir, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), duck, registry.SQL[name])["ok"]


def test_language_held_out(spark, sf_dir):
    got = registry.QUERIES["op1_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_spans(spark, texts, sf_dir):
    model = language_id.fit_on_rest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = {r.lang: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 400").collect()}
    en, de = " ".join(docs["en"].split()[:40]), " ".join(docs["de"].split()[:40])
    (label, score, spans), = model.spans([f"{en} {de}"])
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - len(en)) < 40
    score = np.random.default_rng(1).normal(size=(40, 3)).astype(np.float32)
    counts = np.array([25, 0, 15])
    model.labels = ["a", "b", "c"]
    got = model.viterbi(score, counts, 1.5)
    for a, b in ((0, 25), (25, 40)):  # by all predecessors
        best, back = score[a].astype(float), []
        for row in score[a + 1:b]:
            step = best[None, :] - 1.5 * (1 - np.eye(3))
            back.append(step.argmax(1))
            best = step.max(1) + row
        path = [int(best.argmax())]
        for f in reversed(back):
            path.append(int(f[path[-1]]))
        assert path[::-1] == got[a:b].tolist()


def test_parsing_is_local():
    rng = np.random.default_rng(3)
    body = "".join(rng.choice(list("abcdefgh "), 4000))
    names = []
    for pad in ("", "xyz", "q" * 17):
        symbol, bounds = np.frombuffer((pad + body).encode("utf-32-le"), np.uint32), np.array([0])
        for _ in range(2):
            symbol, bounds = fingerprints.parse(symbol, bounds)
        names.append(collections.Counter(symbol.tolist()))
    assert sum((names[0] & names[1]).values()) > 0.97 * sum(names[0].values())
    assert sum((names[0] & names[2]).values()) > 0.97 * sum(names[0].values())


def plain_marks(text):
    """Root and names of one text, symbol by symbol with plain integers."""
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def labels(row):
        out = []
        for i, x in enumerate(row):
            differ = x ^ row[i - 1] if i else 1
            low = (differ & -differ).bit_length() - 1
            out.append(2 * low + ((x >> low) & 1))
        return out

    row, level, names = [ord(c) for c in text], 0, set()
    while len(row) > 1 or not level:
        if not row:
            return 0, names
        runs = []
        for x in row:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        short = 32 if not level else 64
        symbols = [mix(x + 0x2545F4914F6CDD1D & full) >> 32 if not level else x for x, _ in runs]
        symbols = [x if n == 1 else mix(x + n * 0x9E3779B97F4A7C15 & full) & ((1 << short) - 1) for x, (_, n) in zip(symbols, runs)]
        label = labels(symbols)
        for _ in range(3):
            label = labels(label)
        start = [0]
        for i in range(1, len(symbols)):
            top = label[i] > label[i - 1] and (i + 1 == len(symbols) or label[i] >= label[i + 1])
            if top and not (i - 1 == 0 or (i - 1 in peaks)):
                start.append(i)
            peaks = ({0} if i == 1 else peaks) | ({i} if top else set())
        row = [mix(sum(x * pow(fingerprints.BASE, j, 1 << 64) for j, x in enumerate(symbols[a:b])) + b - a & full)
               for a, b in zip(start, [*start[1:], len(symbols)])]
        level += 1
        if level >= fingerprints.FROM_LEVEL or len(row) == 1:
            names |= {mix(x ^ 0xABCDEF) >> 32 for x in row}
    return row[0], names


def test_fingerprints_by_plain_parsing(texts, monkeypatch):
    some = [t for t in texts.values() if len(t) < 3000][:40] + ["", "a", "aaaa", "ab" * 700, "é中" * 50, "x" * 5000 + "y", "z" * 2]
    want = [plain_marks(t) for t in some]
    for most in (fingerprints.MOST_POWERS, 1):
        monkeypatch.setattr(fingerprints, "MOST_POWERS", most)
        roots, held = fingerprints.fingerprints(some)
        assert [(r, set(h.tolist())) for r, h in zip(roots, held)] == want
    for i in range(0, len(some) - 1):
        (a, x), (b, y) = want[i], want[i + 1]
        share = 1.0 if a == b else len(x & y) / max(len(x | y), 1)
        assert fingerprints.likeness((roots[i], held[i]), (roots[i + 1], held[i + 1])) == share
    letters = [chr(c) for c in range(0x400, 0x1400)]
    body = "".join(np.random.default_rng(1).choice(letters, 3000))  # one percent of either text is shared
    far = ["".join(np.random.default_rng(k).choice(letters, 150_000)) for k in (2, 3)]
    marks = list(zip(*fingerprints.fingerprints([far[0] + body, body + far[1]])))
    assert 0.005 < fingerprints.likeness(*marks) < 0.015


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a if i in b)


def test_near_duplicates(spark, sf_dir, texts):
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op3_near_dedup"](spark, sf_dir).collect()}
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a].keys() & sets[b].keys()) >= 0.6 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in ids}


def test_weighted_similarity_and_sketch():
    rng = np.random.default_rng(5)
    av, bv = np.sort(rng.choice(900, 300, replace=False)), np.sort(rng.choice(900, 300, replace=False))
    aw, bw = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
    a, b = collections.Counter(dict(zip(av.tolist(), aw.tolist()))), collections.Counter(dict(zip(bv.tolist(), bw.tolist())))
    exact = jaccard(a, b)
    assert minhash.similarity(av, aw, bv, bw) == pytest.approx(exact)
    held = minhash.sketch(np.concatenate([av, bv]).astype(np.uint64), np.concatenate([aw, bw]), np.repeat([0, 1], 300), 2, 1920)
    assert np.mean(held[0] == held[1]) == pytest.approx(exact, abs=0.05)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(300):
        own = list(base)
        for j in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            own[j] = f"x{k}y{j}"
        docs.append((k, " ".join(own)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in docs]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(300):
        for b in range(a):
            c = len(sets[a].keys() & sets[b].keys())
            if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in range(300)}


def test_leaks(spark, sf_dir, texts):
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {(k, i) for k, t in texts.items() for i, x in items.items() if x in plain(t)} <= got


def test_changed_parameters(spark):
    bench = spark.createDataFrame([(1, "A train that leaves with Anna at 60 km covers 120 miles, so when does Anna with "
                                       "60 friends reach the far town by the sea?")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro. A train that leaves with Boris at 75 km covers 300 miles, so when does Boris with 75 friends reach "
            "the far town by the sea? End."),
        (2, "A train that leaves with Boris at 75 km covers 300 miles, so when does Clara with 80 friends reach the far "
            "town by the sea?"),
        (3, "A train is late today, and nobody in the far town by the sea knows why.")], "doc_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {1: False}


def plain_leaks(docs, items):
    """Every (doc, item) by a plain search over all windows of all pairs."""
    sign = r"+*/^=×÷-"
    alone = rf"(?<!\S)[{re.escape(sign)}](?!\S)"
    number = r"[0-9]+(?:[.,][0-9]+)*"
    units = "|".join(sorted(decontaminate.UNITS, key=len, reverse=True))

    def parts(text):
        text = re.sub(number, lambda m: f" {m[0]} ", text or "")
        out = []
        for m in re.finditer(rf"{number}|[^\W\d_]+|{alone}", text):
            word = m[0]
            kind = "N" if word[0].isdigit() else "U" if out and out[-1][1] == "N" and re.fullmatch(units, word, re.I) \
                and not text[out[-1][2]:m.start()].strip() else "P" if word[0].isupper() else word.lower()
            out.append((word.lower(), kind, m.end()))
        return out

    def plain_words(text):
        apart = rf"(?:[^\w{re.escape(sign)}]|_|(?<=\S)[{re.escape(sign)}]|[{re.escape(sign)}](?=\S))+"
        return [x for x in re.split(apart, (text or "").lower()) if x]

    def grams(words, k):
        return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]

    def framed(text):
        return {i: g for i, g in enumerate(grams([k for _, k, _ in parts(text)], 5)) if sum(x not in "NUP" for x in g) >= 2}

    found = set()
    for item_id, item in items:
        words = plain_words(item)
        k = min(5, len(words))
        mine, frame = set(grams(words, k)) if k else set(), framed(item)
        for doc_id, text in docs:
            theirs = set(grams(plain_words(text), k)) if k >= 3 else {tuple(plain_words(text))}
            if mine and len(mine & theirs) >= 0.8 * len(mine):
                found.add((doc_id, item_id, True))
                continue
            there = framed(text)
            both = set(frame.values()) & set(there.values())
            if not frame or len(both) < 0.8 * len(set(frame.values())):
                continue
            first = {g: min(i for i in frame if frame[i] == g) for g in both}
            shifts = collections.Counter(j - first[g] for j, g in there.items() if g in both)
            shift = min(shifts, key=lambda x: (-shifts[x], x))
            a, b = parts(item), parts(text)
            names = collections.defaultdict(collections.Counter)
            for i, (word, kind, _) in enumerate(a):
                if kind == "P" and 0 <= i + shift < len(b) and b[i + shift][1] == "P":
                    names[word][b[i + shift][0]] += 1
            many = [c for c in names.values() if sum(c.values()) > 1]
            if sum(sum(c.values()) - max(c.values()) for c in many) <= 0.2 * sum(sum(c.values()) for c in many):
                found.add((doc_id, item_id, False))
    return found


def test_leaks_by_plain_search(spark, sf_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = registry.QUERIES["op4_decontamination"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in got} == plain_leaks(texts.items(), items)


def test_short_numeric_and_renamed_items(spark):
    items = ["What is 25 * 48?", "Compute 12 + 34 * 56 - 78 / 3", "What is the boiling point of water?",
             "A box holds 3 red balls, 5 blue balls and 7 green balls, how many balls of any colour are in the box?",
             "Alice has 3 apples. Alice buys 4 more. How many apples does she have now?", "Yes", "The answer is",
             "Mix 5 kg of sand with 20 liters of water and wait 3 hours before you pour it."]
    docs = ["Homework: what is 25 * 48? We worked on it.", "Now compute 12 + 34 * 56 - 78 / 3 quickly",
            "Please answer this: What is the boiling point of water? Thanks.", "WHAT IS THE BOILING POINT OF WATER",
            "Exam. A box holds 4 red balls, 4 blue balls and 9 green balls, how many balls of any colour are in the box?",
            "Well, Bob has 8 apples. Bob buys 2 more. How many apples does she have now? Ok.",
            "Well, Bob has 8 apples. Carl buys 2 more. How many apples does she have now? Ok.",
            "yes", "Yes we can", "so the answer is no", "Mix 7 kg of sand with 1,000 liters of water and wait 12 hours before you pour it!",
            "What is 25 + 48?", "Compute 1 + 2 * 3 - 4 / 5", "", None, "We mix sand with water and pour it."]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.find_leaks(d, b).collect()}
    assert got == plain_leaks(list(enumerate(docs)), list(enumerate(items)))
    assert {(0, 0, True), (1, 1, True), (2, 2, True), (3, 2, True), (4, 3, False), (5, 4, False), (7, 5, True), (9, 6, True), (10, 7, False)} <= got
    assert not {d for d, _, _ in got} & {8, 11, 13, 14, 15} and (6, 4, False) not in got


def test_license_places(spark, sf_dir, texts):
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in registry.QUERIES["op5_licenses"](spark, sf_dir).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r.doc_id].translate(low))
        at = sorted((i, x) for p, x in phrases for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_automaton_statistics():
    rng = np.random.default_rng(2)
    sequences = [[bytes([97 + x]) for x in rng.integers(0, 3, 12)] for _ in range(5)]
    auto = licenses.Automaton(sequences)
    run = [auto.vocabulary[bytes([97 + x])] for x in rng.integers(0, 3, 200)]
    for i, (state, size) in enumerate(auto.statistics(run)):
        ends = {n: {(t, j) for t, s in enumerate(auto.sequences) for j in range(n - 1, len(s)) if s[j - n + 1:j + 1] == run[i - n + 1:i + 1]}
                for n in range(1, min(i + 1, 12) + 1)}
        assert size == max((n for n, e in ends.items() if e), default=0)
        assert not size or set(auto.ends[state]) == ends[size]


def test_license_sections():
    from tripwire.llm.license_texts import SECTIONS

    def labels(text):
        return {s[0] for s in licenses.scan(text)["spans"]}

    for label, text in SECTIONS:  # every section alone, changed a little, within other words
        assert labels("x y z. " + text.replace("any person", "every single person").upper() + " more words") == {label}, text
    by = {label: [t for x, t in SECTIONS if x == label] for label, _ in SECTIONS}
    assert labels("\n".join(by["mit"]) + " -- " + by["zlib"][0]) == {"mit", "zlib"}
    agpl = by["agpl"][0]
    assert labels(agpl) == {"agpl"} and licenses.scan(agpl)["places"] and labels(agpl.replace("Affero ", "")) == {"gpl"}
    assert labels("this work is licensed and you may not use it, see the software and the license") == set()


def test_license_chains():
    rng = np.random.default_rng(8)
    for _ in range(200):
        matches = sorted({(int(w), int(a), int(z)) for w, a, z in zip(rng.integers(0, 60, 25), rng.integers(0, 40, 25), rng.integers(4, 9, 25))})
        best = {}
        for m in sorted(matches):  # by all predecessors
            word, at, size = m
            best[m] = (size, word)
            for p in matches:
                if p >= m:
                    break
                covered, first = best[p]
                skip = max(0, p[0] + p[2] - word, p[1] + p[2] - at)
                if skip < size and word - p[0] - p[2] <= licenses.MOST_GAP and at - p[1] - p[2] <= licenses.MOST_GAP and first < word:
                    best[m] = max(best[m], (covered + size - skip, first), key=lambda x: (x[0], -x[1]))
        want = sorted((c, f, m[0] + m[2]) for m, (c, f) in best.items())
        assert sorted(licenses.chain(matches)) == want


def luhn(x):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans(spark, texts):
    rng = np.random.default_rng(9)
    odd = ["".join(rng.choice(list("a1. @-+4%_b()2 é"), 400)) for _ in range(150)]
    odd += ["4111 1111-1111 1111 5500000000000004 4111111111111112", "x@y.z_q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255",
            "a@b.c" + ".d" * 20_000, "1 " * 20_000]
    docs = spark.createDataFrame(list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).collect():
        assert [tuple(x) for x in r.base] == base_spans(every[r.doc_id]), every[r.doc_id][:200]
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_contextual_discovery(spark):
    docs = [(i, f"Please reach the desk. address {10 + i}.20.30.{i} ok") for i in range(40)] + [(99, "See address 300.20.30.4 ok")]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[5] == [("ip", 31, 41)] and got[99] == []
    docs = [(i, f"card: {4000000000000000 + 10 * i + k} end") for i in range(40) for k in range(10)
            if luhn(str(4000000000000000 + 10 * i + k))] + [(99, "card: 4000000000000001 end")]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[99] == [("card", 6, 22)]


def plain_spans(docs):
    """Base spans and a plain bootstrapping of the pattern graph, by loops."""
    token = r"(?:[0-9]+(?:(?:[ .-]| ?\(|\)[ -]?)[0-9]+)*(?![A-Za-z0-9@_])|(?=[A-Za-z._%@=/+-]*[0-9])[A-Za-z0-9][A-Za-z0-9._%@=/+-]*)"
    token = token.replace("[0-9]+", "[0-9]++").replace(")*(?!", ")*+(?!")
    places = []
    for doc_id, text in docs:
        base = base_spans(text)
        for m in re.finditer(rf"(?<![^\W_])(?:([^\W\d_]++)((?:[^\w]|_)++))?+({token})", text):
            word, gap, value = (m[1] or "").lower(), m[2] or "", m[3]
            lead = re.search(r"\+?\(?\Z", gap)[0]
            gap, value = re.sub(r"\s+", " ", gap[:len(gap) - len(lead)]), lead + value
            a, b = m.end() - len(value), m.end()
            over = [(k, x, y) for k, x, y in base if x < b and y > a]
            kind = next((k for k, x, y in over if 2 * (min(y, b) - max(x, a)) >= b - a), None)
            shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", value))
            form = "@" if "@" in value else "a" if re.search("[A-Za-z]", value) else "9"
            n = len(re.sub("[^0-9]", "", value))
            can = {k for k, (x, y, f) in pii.PLAUSIBLE.items() if x <= n <= y and re.search(f, value)}
            places.append((doc_id, a, b, value, [(word, gap, "s", shape), (word, gap, "c", form)], kind, bool(over), can))
    links = collections.defaultdict(set)
    seeds = {}
    for _, _, _, value, own, kind, _, _ in places:
        for pattern in own:
            links[pattern].add(value)
        if kind:
            seeds[value, kind] = 1.0
    links = {p: v for p, v in links.items() if len(v) >= pii.SUPPORT}
    score = dict(seeds)
    for _ in range(pii.ROUNDS):
        rated = {}
        for p, values in links.items():
            for k in pii.KINDS:
                mean = sum(score.get((v, k), 0) for v in values) / len(values)
                if mean >= pii.CONFIDENCE:
                    rated[p, k] = mean
        score = dict(seeds)
        for (p, k), c in rated.items():
            for v in links[p]:
                score[v, k] = max(score.get((v, k), 0), c)
    out = {doc_id: set(base_spans(text)) for doc_id, text in docs}
    for doc_id, a, b, _, own, _, met, can in places:
        kinds = [(rated[p, k], k) for p in own for k in can if (p, k) in rated]
        if kinds and not met:
            out[doc_id].add((max(kinds)[1], a, b))
    return out


def test_discovery_by_plain_bootstrapping(spark, texts):
    docs = [(i, t) for i, t in texts.items() if len(t) < 20_000]
    docs += [(20_000 + i, f"Desk phone: +1 (212) 555-0{100 + i} or mail bob{i}@mail.example.org.") for i in range(60)]
    docs += [(21_000 + i, f"Server  at\t10.{i}.0.{i}, card: 4{i:03d} {i:04d} 0000 0001; v{i}") for i in range(30)]
    docs += [(22_000, "phone: 212 555 0199 77 and phone: 3"), (22_001, "card:   4111 1111 1111 1112 x"), (22_002, "mail kim7@localhost now"),
             (22_003, "212 555"), (22_004, "at 10.20.30"), (22_005, "phone: (212) 555-0177")]
    got = {r.doc_id: {tuple(x) for x in r.spans} for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_spans(docs)
    assert got == want
    assert got[22_000] == {("phone", 7, 22)} and got[22_002] == {("email", 5, 19)} and got[22_005] == {("phone", 7, 21)} and not got[22_003]


def test_lm_scores(spark, sf_dir, texts):
    words = collections.Counter(w for t in texts.values() for w in lm_score.tokens(t))
    top = {w: k + 2 for k, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:lm_score.VOCABULARY])}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    n = len(top) + 2

    def model(ids):
        pair, before, single = collections.Counter(), collections.Counter(), np.zeros(n)
        for i in ids:
            s = [1] + [top.get(w, 0) for w in lm_score.tokens(texts[i])]
            for a, b in zip(s, s[1:]):
                pair[a, b] += 1
                before[a] += 1
                single[b] += 1
        single = (single + lm_score.ADDED) / (single + lm_score.ADDED).sum()
        share = lambda a: lm_score.BIGRAM_SHARE if before[a] else 0
        return lambda a, b: -np.log(share(a) * pair[a, b] / max(before[a], 1) + (1 - share(a)) * single[b])

    hit, back = model([i for i in texts if i in good]), model(list(texts))
    for r in registry.QUERIES["op7_lm_scoring"](spark, sf_dir).where("doc_id % 10 = 0").collect():
        s = [1] + [top.get(w, 0) for w in lm_score.tokens(texts[r.doc_id])]
        want = np.mean([hit(a, b) - back(a, b) for a, b in zip(s, s[1:])])
        assert r.score == pytest.approx(want, abs=1e-4)


def test_lm_every_word_counts(spark):
    """Words beyond the 2048 most frequent ones have counts of their own, in one chunk or many."""
    body = [" ".join(f"w{j}" for j in range(3000)) for _ in range(2)]
    docs = [(1, f"{body[0]} alpha beta alpha beta"), (2, f"{body[1]} gamma delta gamma delta"), (3, "alpha beta"),
            (4, "gamma delta"), (5, None), (None, "alpha beta")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    one = {r.doc_id: r for r in lm_score.score_documents(docs, labels).collect()}
    many = {r.doc_id: r for r in lm_score.score_documents(docs, labels, chunk_tokens=1).collect()}
    assert one[3].score < one[4].score and one[None].score == pytest.approx(one[3].score) and one[5].score is None
    assert {k: r.score for k, r in one.items()} == pytest.approx({k: r.score for k, r in many.items()})
    # 5 texts have words, 2 begin with alpha; of 6,014 tokens 4 are alpha and 4 beta, each after an alpha
    single = lambda n, whole: (n + 0.5) / (whole + 0.5 * (3004 + 2))
    start, pair = 0.7 * 2 / 5 + 0.3 * single(4, 6014), 0.7 * 4 / 4 + 0.3 * single(4, 6014)
    assert one[3].background_loss == pytest.approx(-(np.log(start) + np.log(pair)) / 2)


def removed(texts, length=400):
    seen = collections.Counter(v[i:i + length] for v in texts for i in range(len(v) - length + 1))
    out = []
    for v in texts:
        mark = bytearray(len(v))
        for i in range(len(v) - length + 1):
            if seen[v[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        out.append((len(v), sum(mark), len(re.findall(b"\1+", bytes(mark))),
                    hashlib.sha256(bytes(c for c, x in zip(v, mark) if not x)).hexdigest()))
    return out


def test_substrings(spark, monkeypatch):
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [text(n) for n in (399, 401, 450, 700, 900)]
    docs = [text(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 5))] + text(int(rng.integers(0, 300))) for _ in range(60)]
    docs += [shared[3], shared[3], shared[4][:420] + "!" + shared[4][420:], "ab" * 900, text(2000) * 2]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = removed([d.encode() for d in docs])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame).collect()}
    assert [got[i] for i in range(len(docs))] == want
    monkeypatch.setattr(substrings, "CROWD", 1)  # every anchor is crowded
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame).collect()}
    assert [got[i] for i in range(len(docs))] == want


def test_signs_keep_pairs_at_the_threshold():
    """One-bit registers differ in about (1 - similarity) / 2; no pair at 0.8 is excluded."""
    rng = np.random.default_rng(11)
    most = minhash.most_different(0.8)
    for shared, own, weight in ((400, 50, 1), (8, 1, 1), (80, 10, 3)):
        for _ in range(20):
            ids = rng.integers(0, 1 << 48, shared + 2 * own, dtype=np.uint64)
            a, b = np.sort(ids[:shared + own]), np.sort(np.concatenate([ids[:shared], ids[shared + own:]]))
            both = minhash.signs(np.concatenate([a, b]), np.full(len(a) + len(b), weight),
                                 np.repeat([0, 1], [len(a), len(b)]), 2)
            differ = int(np.bitwise_count((both[0] ^ both[1]).view(np.uint64)).sum())
            assert differ <= most
    a, b = (np.sort(rng.integers(0, 1 << 48, 500, dtype=np.uint64)) for _ in range(2))
    both = minhash.signs(np.concatenate([a, b]), np.ones(1000, int), np.repeat([0, 1], 500), 2)
    assert 420 < int(np.bitwise_count((both[0] ^ both[1]).view(np.uint64)).sum()) < 600


def test_sketch_memory_is_bounded():
    """A task sketches a bounded number of code points at once, with the same result for any grouping."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    words = np.array([f"w{i:05d}é" for i in range(3000)])
    texts = [" ".join(rng.choice(words, 1000)) for _ in range(400)]          # 3.2 million code points
    pdf = pd.DataFrame({"doc_id": [str(i) for i in range(400)], "th": range(400), "text": texts})
    list(minhash._sketched([pdf.head(1)]))                                  # tables of code points
    tracemalloc.start()
    got = list(minhash._sketched([pdf]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    alone = {i: next(minhash._sketched([pdf.iloc[[i]]])) for i in (0, 57, 399)}
    rows = pd.concat(got).set_index("doc_id")
    assert len(rows) == 400
    for i, one in alone.items():
        assert rows.loc[str(i)].node == one.node[0] and np.array_equal(rows.loc[str(i)].bands, one.bands[0])


def test_planted_passages_by_length(spark):
    """op8: of repeated passages of over 50 words those of 400 bytes and more go, whole; shorter
    ones and clean documents stay, and n_bytes is the size of the whole text in any case."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), n))
    filler = lambda: " ".join(word(7) for _ in range(90))                          # noqa: E731
    short, long = ("[" + " ".join(word(k) for _ in range(60)) + "]" for k in (4, 9))
    assert len(short.encode()) < 400 < len(long.encode())
    texts, size = [], {}
    for i in range(30):
        passage = ("", short, long)[i % 3]
        a, b = filler(), filler()
        texts.append((i, f"{a}{chr(48 + i)}({passage}){chr(48 + i)}{b}"))        # no two sides are equal
        size[i] = len(passage.encode()) + 2 if passage is long else 0              # with its round brackets
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substrings.remove_repeats(frame).collect()}
    for i, text in texts:
        data = text.encode()
        kept = data.replace(f"({long})".encode(), b"") if size[i] else data
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), size[i], int(size[i] > 0))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_remaining_texts(spark, tmp_path, monkeypatch):
    """op8: the operator hands on what remains of every text, byte for byte, and the query shows it
    as text; a planted passage is gone from it, clean and null texts are as they were."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    filler = lambda: " ".join(word(7) for _ in range(90))                          # noqa: E731
    passage = "(" + " ".join(word(8) for _ in range(60)) + ")"
    sides = [(filler(), filler()) for _ in range(4)]
    texts = {0: sides[0][0] + "0" + passage + "é" + sides[0][1], 1: sides[1][0] + "1" + passage + "è" + sides[1][1],
             2: sides[2][0] + "é" + sides[2][1], 3: None, 4: "short"}
    rest = {i: t and t.encode() for i, t in texts.items()} | {3: b""}
    for i in (0, 1):                                            # é and è begin with the same byte, which goes too
        rest[i] = rest[i].replace(passage.encode() + b"\xc3", b"")
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for held in (substrings.HELD, 1):
        monkeypatch.setattr(substrings, "HELD", held)
        got = {r.doc_id: r for r in substrings.remove_repeats(frame.coalesce(1)).collect()}
        assert {i: bytes(r.kept) for i, r in got.items()} == rest
        assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got.values())
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op8_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == {i: r.decode(errors="replace") for i, r in rest.items()}
    assert "\ufffd" in got[0].text and not any(passage in r.text for r in got.values())
    assert {i: r.n_bytes - r.n_removed for i, r in got.items()} == {i: len(r) for i, r in rest.items()}
