"""Deduplication of scans larger than a task, and overlap merging in less than quadratic time, against the plain ways."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import cleaning, grouped
from pathloom.sources.scans import walks

SF = "/root/testdata/sf0.01"
POINTS = "scan_id string, seq long, x double, y double, z double"


def read(frame):
    return [(r.x, r.y, r.z) for r in frame.orderBy("seq").collect()]


def test_one_scan_in_many_chunks(spark):
    """All events as one scan: the same choice as over the whole, and no task gets more than a chunk."""
    one = walks(spark, SF).select(F.lit("all").alias("scan_id"), (F.col("scan_id") * 1000 + F.col("seq")).alias("seq"), "x", "y", "z")
    p = np.array(read(one))
    expected = p[grouped.kept_apart(p, 0.5)].tolist()
    got = grouped.deduplicate(one, 0.5, chunk=1500)
    assert [list(r) for r in read(got)] == expected and len(expected) < len(p)
    assert [r.seq for r in got.orderBy("seq").collect()] == list(range(len(expected)))


def test_chunks_of_several_scans_and_odd_points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("a", 500), ("b", 37), ("c", 1), ("d", 3)):
        p = rng.uniform(0, 4, (n, 3)) if name != "d" else np.zeros((3, 3))
        rows += [(name, k, *map(float, q)) for k, q in enumerate(p)]
    rows += [("e", 0, 0.0, 0.0, 0.0), ("e", 1, math.nan, 0.0, 0.0), ("e", 2, 0.1, 0.0, 0.0), ("e", 3, 9.0, 0.0, 0.0)]
    got = grouped.deduplicate(spark.createDataFrame(rows, POINTS).repartition(4), 0.7, chunk=50)
    for name in "abcd":
        p = np.array([r[2:] for r in rows if r[0] == name])
        assert read(got.filter(F.col("scan_id") == name)) == [tuple(q) for q in p[grouped.kept_apart(p, 0.7)].tolist()]
    assert [r[0] for r in read(got.filter("scan_id = 'e'"))][::2] == [0.0, 9.0]
    assert grouped.deduplicate(spark.createDataFrame([], POINTS), 0.5).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_overlaps_as_the_plain_way(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 250))
    kind = seed % 4
    if kind == 0:
        p = np.cumsum(rng.normal(0, 0.6, (n, 3)), axis=0)
    elif kind == 1:
        a = np.linspace(0, 12, n)
        p = np.stack([3 * np.cos(a), 3 * np.sin(a), 0 * a], axis=1) + rng.normal(0, 0.05, (n, 3))
    elif kind == 2:
        p = rng.integers(0, 5, (n, 3)).astype(float)
    else:
        there = np.stack([np.linspace(0, 20, n), np.zeros(n), np.zeros(n)], axis=1)
        p = np.concatenate([there, there[::-1] + 0.1, there + [0, 4, 0]])
    for limit in (0.3, 1.0, 2.5):
        assert grouped.overlaps_merged(p, limit) == grouped.overlaps_merged_plainly(p, limit)


def test_overlaps_of_a_walk_that_keeps_coming_back_in_time():
    a = np.linspace(0, 2 * math.pi * 1000, 200_000)
    p = np.stack([20 * np.cos(a), 20 * np.sin(a), 0.001 * np.sin(7 * a)], axis=1)
    began = time.process_time()
    keep = grouped.overlaps_merged(p, 1.0)
    assert time.process_time() - began < 60 and len(keep) > 100
    out = np.concatenate([p, p[:200] + [0, 60, 0], p[:5000]])
    began = time.process_time()
    assert grouped.overlaps_merged(out, 1.0)
    assert time.process_time() - began < 60


def test_least():
    least, plain = grouped.Least(7), [-1] * 7
    rng = np.random.default_rng(2)
    for _ in range(300):
        i, v = int(rng.integers(7)), int(rng.integers(20))
        plain[i] = max(plain[i], v)
        least.put(i, plain[i])
        bound, start = int(rng.integers(21)), int(rng.integers(7))
        assert least.under(bound, start) == next((k for k in range(start, 7) if plain[k] < bound), None)


def test_groups_are_not_put_together_for_their_few_bytes(spark):
    """A step over groups behind windows by the same keys: its tasks stay as many as there is work for."""
    rows = spark.range(640).select((F.col("id") % 64).alias("scan_id"), F.col("id").alias("seq"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    got = grouped.per_group(cleaning.renumbered(rows, ["scan_id"]), ["scan_id"], lambda p: p).select("*", F.spark_partition_id().alias("part")).collect()
    assert len(got) == 640 and len({r.part for r in got}) > 8
    assert all(r.x == r.scan_id + 64 * r.seq for r in got)


def test_small_groups_choose_as_large_ones_do(monkeypatch):
    random = np.random.default_rng(5)
    for t in range(200):
        p = np.cumsum(random.normal(size=(int(random.integers(1, 120)), 3)) * [0.6, 0.6, 0.1], axis=0)
        p = np.round(p * 2) / 2 if t % 3 == 0 else p
        if t % 10 == 9:
            p[0, 0] = np.nan
        found = []
        for small in (256, 0):
            monkeypatch.setattr(grouped, "SMALL", small)
            found.append((grouped.first_apart(p, 0.5), grouped.overlaps_merged(p, 1.0)))
        assert found[0] == found[1]
