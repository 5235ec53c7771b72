"""The quality model against plain loops: places, ratios, the hinge-loss optimum and the score of every row; long texts for operators whose other tests have none."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import decontaminate, quality, simhash, urlfilter

RNG = random.Random(10)
MASK = (1 << 64) - 1


def prose(n, shout=0.0):
    return " ".join((w.upper() + "!!" if RNG.random() < shout else w) + RNG.choice(["", "", ",", "."]) for w in (RNG.choice(["the", "of", "Ander", "ing", "x1", "être", "zu"]) + str(RNG.randrange(30)) for _ in range(n)))


def plain_places(text):
    """Words and runs of one to three shapes, hashed one at a time."""
    words = (text or "").split()
    h = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
    s = [xxhash.xxh64_intdigest(quality.shape(w), 2) for w in words]
    m = int(quality.MULTIPLY)
    grams = h + s + [(a * m + b * 31) & MASK for a, b in zip(s, s[1:])] + [((a * m + b) * m + c * 37) & MASK for a, b, c in zip(s, s[1:], s[2:])]
    return sorted({((g ^ (g >> 29)) * m & MASK) >> (64 - quality.BITS) for g in grams})


@pytest.fixture(scope="module")
def rows():
    good = [prose(RNG.randrange(5, 60), 0.15) for _ in range(60)]
    bad = [prose(RNG.randrange(5, 60), 0.45) for _ in range(30)]
    return [(t, True) for t in good] + [(t, False) for t in bad]


def test_places_and_ratios(rows):
    texts = [t for t, _ in rows] + ["", None, "one", "one two", prose(4000)]
    assert [quality.places(t, quality.Hashes()).tolist() for t in texts] == [plain_places(t) for t in texts]
    long = prose(52_000)
    assert quality.places(long, quality.Hashes()).tolist() == plain_places(long)
    found = [quality.places(t, quality.Hashes()) for t, _ in rows]
    ratio = quality.log_count_ratio(found, np.array([y for _, y in rows]))
    n = [sum(len(x) for x, (_, y) in zip(found, rows) if y is c) + (1 << quality.BITS) for c in (False, True)]
    for place in RNG.sample(sorted({int(p) for x in found for p in x}), 200):
        c = [1 + sum(place in x for x, (_, y) in zip(found, rows) if y is k) for k in (False, True)]
        assert ratio[place] == pytest.approx(math.log((c[1] / n[1]) / (c[0] / n[0])))


def test_hinge_loss_optimum(rows):
    """The objective that dual coordinate descent reaches, against projected gradient ascent on the whole dual, and no duality gap."""
    found = [quality.places(t, quality.Hashes()) for t, _ in rows]
    good = np.array([y for _, y in rows])
    ratio = quality.log_count_ratio(found, good)
    x = np.zeros((len(rows), (1 << quality.BITS)))
    for k, f in enumerate(found):
        x[k, f] = ratio[f] / np.linalg.norm(ratio[f])
    used = np.flatnonzero(np.abs(x).sum(axis=0))
    x = np.concatenate((x[:, used], np.ones((len(rows), 1))), axis=1)
    sign, share = np.where(good, 1.0, -1.0), good.mean()
    for cost in (0.1,):
        limit = cost * np.where(good, 0.5 / share, 0.5 / (1 - share)) * 10
        loss = lambda v: 0.5 * v @ v + (limit * np.maximum(0, 1 - sign * (x @ v))).sum()
        w, b = quality.fit_margin(found, good, ratio, cost, rounds=400)
        mine = np.append(w[used], b)
        q = (x @ x.T) * np.outer(sign, sign)
        alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(6000):
            alpha = np.clip(alpha + step * (1 - q @ alpha), 0, limit)
        dual = alpha.sum() - 0.5 * alpha @ q @ alpha
        assert loss(mine) == pytest.approx(dual, rel=2e-2) and loss(mine) >= dual - 1e-9
        w, b = quality.fit_margin(found, good, ratio, cost)  # as it is used
        assert loss(np.append(w[used], b)) <= 1.1 * dual


def test_scores_by_plain_loops(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, ""), (902, prose(5000)), (3, rows[3][0])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    for r in quality.score(docs, model, ["doc_id", "text"]).collect():
        p = plain_places(r.text)
        v = [float(model["ratio"][k]) for k in p]
        norm = math.sqrt(sum(a * a for a in v))
        m = sum(float(model["weights"][k]) * a for k, a in zip(p, v)) / max(norm, 1e-12) + model["b"] if p else model["b"]
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, model["a"] * m + model["c"])))), abs=1e-9)


def test_long_texts(spark):
    """Texts of tens of thousands of words, a word of a million letters, and a long URL."""
    long, passage = prose(6000), prose(30)
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, f"{long} {passage} {long}"), (4, "x" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fp for i, r in got.items()} == {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()} and got[1].component == got[2].component == 1
    assert {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()}[2] == 1
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(docs, items).collect()}
    words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", passage.lower()))
    assert hits[3][1] >= words and hits[4] == (1, 0)
    pages = spark.createDataFrame([(k, f"http://host{k}.net/{'seg/' * (5_000 if k == 1 else 1)}{k}") for k in range(30)] + [(50, "http://spam.net/" + "a" * 20_000)], "page_id long, url string")
    verdicts = {r.page_id: r for r in urlfilter.judge_urls(pages).collect()}
    assert len(verdicts) == 31 and len(verdicts[1].path) > 20_000 and verdicts[50].host == "spam.net"
