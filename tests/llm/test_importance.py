"""Importance resampling against plain loops over all texts."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pathloom.llm import importance

RNG = random.Random(13)
WORDS = ["the", "Of", "and", "Größe", "x1", "日本", "alpha", "beta", "gamma", "delta", "42"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + (RNG.choice(["", "s", "ing"]) if k % 3 else "") + RNG.choice(["", ".", ",", "-"]) for k in range(n))


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plainly(docs, target, percent=5):
    own, wanted = Counter(), Counter()
    for _, t in docs:
        own.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    s, t = sum(own.values()), sum(wanted.values())
    gains = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + 10_000.0) / ((own[b] + 1.0) * (t + 10_000.0)))) for b in own}
    rows = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = {r[0]: k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(((i, n, w, s, drawn.get(i)) for i, _, n, w, s in rows), key=str)


def documents():
    texts = [prose(RNG.randrange(0, 80)) for _ in range(260)] + ["same words here"] * 130
    texts += [None, "", " ", "one", "one two", "A-b_c", "x" * 3000, prose(19), prose(20), prose(30_000), ("the " * 400_000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, prose(25))]


TARGET = [prose(40) for _ in range(5)] + ["same words", None, ""]


@pytest.mark.parametrize("most", [300, 2_000_000])
def test_equals_plain_loops(spark, most):
    docs, schema = documents(), "doc_id long, text string, block string, weight double"
    frame = spark.createDataFrame([(i, t, "b", 0.5) for i, t in docs], schema).repartition(3)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resampled(frame, target, 5, most=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plainly(docs, TARGET)
    assert {k: v for k, v in got.dtypes} == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}


def test_rows_of_one_id_and_ties(spark):
    docs = [(1, prose(30))] * 40 + [(2, prose(30))] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resampled(frame, spark.createDataFrame([(prose(30),)], "text string"), 50).collect()
    assert len(got) == 43 and sorted(r.rank for r in got if r.rank) == list(range(1, 22))
    assert len({(r.doc_id, r.weight, r.score) for r in got}) == 2


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, docs, 5).count() == 0
    assert sorted(tuple(r) for r in importance.resampled(docs, none, 5).select("doc_id", "n_features", "rank").collect()) == [(1, 3, None), (2, 0, None)]


def test_stretches_of_a_text_and_packing(monkeypatch):
    text = prose(500).encode()
    whole = importance.buckets(text)
    monkeypatch.setattr(importance, "STRETCH", 50)
    parts = importance.buckets(text)
    assert whole[0] == parts[0] and all(np.array_equal(a, b) for a, b in zip(whole[1:], parts[1:]))
    values = np.array([0, 1, 254, 255, 256, 600, 0, 100_000])
    assert importance.sums_of_gaps(importance.gaps(values)).tolist() == np.cumsum(values).tolist()
    assert importance.gaps(values[:0]) == b""


def test_nothing_is_left_behind(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(1, prose(30))], "doc_id long, text string")
    importance.resampled(docs, docs, 100).collect()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert not [d for d in os.listdir(shared) if d.startswith("importance-")]
