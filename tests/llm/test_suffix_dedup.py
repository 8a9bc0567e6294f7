"""Induced sorting and suffix dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshweave.llm import induced_sort, queries, suffix_dedup


def ordered(text, depth, room=induced_sort.ROOM):
    blocks = list(induced_sort.suffixes(text, depth, room))
    return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 3), st.sampled_from([6, 1 << 18]), st.sampled_from([0, 9, 1 << 20]), st.sampled_from([3, 1 << 16]), st.sampled_from([2, 1 << 10]))
def test_suffixes(text, times, room, short, block, wide):
    text, held = text * times, (induced_sort.SHORT, induced_sort.BLOCK, induced_sort.WIDE)
    induced_sort.SHORT, induced_sort.BLOCK, induced_sort.WIDE = short, block, wide
    try:
        order, shared = ordered(np.array(text, np.uint16), 1000, room)
    finally:
        induced_sort.SHORT, induced_sort.BLOCK, induced_sort.WIDE = held
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[k] == n


def test_shards_over_the_room_go_to_files_and_recurse(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(300)]
    text = b" ".join(words[i] for i in np.minimum(rng.zipf(1.3, 120_000), 300) - 1)
    text += text[1000:41000] + b"q" * 3000 + text[5000:9000]
    depths, whole = [], induced_sort.suffixes

    def counted(part, *rest):
        depths.append(len(part))
        return whole(part, *rest)

    monkeypatch.setattr(induced_sort, "suffixes", counted)
    monkeypatch.setattr(induced_sort, "SHORT", 1 << 14)
    monkeypatch.setattr(induced_sort, "HELD", 1 << 14)  # arrays are files, too
    before = induced_sort.Queue.written
    data = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    order, shared = ordered(data, 60, 1 << 12)
    assert induced_sort.Queue.written - before > len(text)
    assert len(depths) >= 4 and depths == sorted(depths, reverse=True)
    assert sorted(order.tolist()) == list(range(len(text)))
    for k in range(1, len(text)):
        a, b = text[order[k - 1] : order[k - 1] + 60], text[order[k] : order[k] + 60]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(shared[k], 60) == n and (n == 60 or a[n:] < b[n:])


def test_production_shards_are_larger_than_the_queues():
    assert induced_sort.ROOM <= suffix_dedup.SHARD // 16


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_against_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    words = ["ab", "cde", "é", "f\n", "zz zz"]
    make = lambda n: "".join(words[i] for i in rng.integers(0, 5, n))
    passage = make(30)
    texts = [make(int(rng.integers(1, 60))) for _ in range(60)] + [make(10) + passage + make(10) for _ in range(12)] + ["a" * 200, "a" * 90, "", None, passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, length=40, m=8, hot=hot).collect()}
    want = brute(texts, 40)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 14


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_dedup(spark, sf).collect()}
    assert [got[d["doc_id"]] for d in docs] == brute([d["text"] for d in docs], 200)


def test_repeated_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, "x", 3)], "doc_id long, text string, th long")
    rows = suffix_dedup.dedup(df).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 300, 300]
    assert suffix_dedup.dedup(df.limit(0)).count() == 0
