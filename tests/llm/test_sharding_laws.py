"""Sharding: the curve against its defining property, the law, what a filter touches, and written shards."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import sharding

RNG = random.Random(4)
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("d,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_steps_to_a_neighbour(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = sharding.hilbert(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_law_slots_and_sizes(spark):
    texts = [None, "", "é" * 9, "x" * 100_000, *(f"text {RNG.randrange(40)}" for _ in range(500))]
    rows = [(i if i % 7 else None, t, RNG.choice([None, "en", "de"]), f"s{min(RNG.randrange(9), 3)}", len(t or ""), 5, "u") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long, shard int, row string")
    got = sharding.shard_rows(docs, ["lang", "source", "n_chars"], 24).collect()
    counts = [0] * 24
    slots = {}
    for r in got:
        counts[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) + 3 and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    pairs = sorted((r.size, r.text_crc32) for r in got)
    assert pairs == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts + texts[:3])
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.text_crc32, r.size) for r in order]
    assert keys == sorted(keys)
    assert sharding.shard_rows(docs.limit(0), ["lang"], 24).count() == 0


def test_filters_touch_few_shards(spark):
    """At random places nearly all 24 shards hold rows of any filter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.shard_rows(docs, ["lang", "source", "n_chars"], 24).join(docs, "doc_id")
    touched = lambda where: placed.filter(where).select("shard").distinct().count()
    assert touched("lang = 'de'") <= 18 and touched("source = 'src0'") <= 14 and touched("n_chars < 300") <= 12 and touched("lang = 'de' AND source = 'src0' AND n_chars > 1500") <= 4


def test_written_shards(spark, tmp_path):
    rows = [(i % 50, f"t{i}", RNG.choice(["en", "de"]), i) for i in range(200)]  # every id four times
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    sharding.write_shards(docs, str(tmp_path / "out"), ["lang", "n_chars"], 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "lang", "n_chars").collect())) == sorted(rows)
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {25}
    assert back.filter("shard = 3").agg(F.countDistinct("lang")).first()[0] <= 2
