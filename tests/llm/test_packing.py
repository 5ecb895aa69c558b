"""Packing against a plain tokeniser and a plain first-fit search."""

import random
import zlib

import numpy as np
import pytest

from tripwire.llm import packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(rows, docs, plain):
    """Every id of every row lies in one piece; sequences are gapless and need no padding."""
    want = {}
    for doc_id, text in docs:
        want.setdefault(doc_id, []).append(plain(text))
    assert {r.doc_id for r in rows} == set(want)
    for doc_id, copies in want.items():
        mine = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == sum(map(len, copies))
        if len(copies) == 1:
            ids = np.array(copies[0], "<u4")
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                at += r.length
                assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE and at & (at - 1) == 0
    return sequences


def test_whole_table(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = packing.op13_packing(spark, sf_dir).collect()
    sequences = check(rows, docs, plain)
    total = sum(r.length for r in rows)
    assert len(sequences) <= total // packing.SEQUENCE + 11


def test_edge_cases(spark, plain):
    big = (1 << 60) + 1
    docs = [(big, None), (None, ""), (3, " two  spaces \n\n and\ttabs  "), (4, "a" * 20_000), (5, "x <|endoftext|> y"),
            (6, "z"), (6, "z"), (big + 1, "wé 中文 don't 12,3  !!\x1c x  y"), (8, "word " * 30_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string").repartition(3)
    got = packing.pack(df, packing.tokenizer_path(), group_tokens=4000)
    rows = got.withColumn("doc_id", got.doc_id.cast("long")).collect()
    check(rows, docs, plain)
    assert {r.doc_id for r in rows} >= {big, big + 1, None}
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0


def test_words_cut_only_where_the_tokenizer_does(plain):
    rng = random.Random(5)
    encode = packing.Encoder(packing.tokenizer_path())
    alphabet = ["a", "b", "'s", " ", " ", "\n", "\t", "1", "!", " ", "é", "\x1c", "\x85"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == plain(text)[:-1], repr(text)


def test_first_fit_decreasing():
    rng = random.Random(7)
    for _ in range(50):
        lengths = [rng.randint(1, 1023) for _ in range(rng.randint(0, 60))]
        bins, room = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(1024)
            bins[k].append(i)
            room[k] -= lengths[i]
        assert packing.first_fit_decreasing(lengths) == bins
        found = packing.level(bins, lengths)
        assert all(sum(b - a for _, a, b in s) in [1 << k for k in range(11)] for s in found)
        held = sorted((i, a, b) for s in found for i, a, b in s)
        for i, n in enumerate(lengths):
            mine = [(a, b) for k, a, b in held if k == i]
            assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
