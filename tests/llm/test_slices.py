"""Decontamination with its phrases in many slices, and what runs leave behind."""

import os
import random

from pathloom.llm import decontaminate

RNG = random.Random(8)


def prose(n):
    return " ".join(RNG.choice(["the", "of", "thon", "ing", "är"]) + str(RNG.randrange(60)) for _ in range(n))


def test_slices_find_what_one_finds(spark, monkeypatch):
    items = [(k, prose(RNG.randrange(3, 60))) for k in range(40)]
    rows = [(i, f"{prose(30)} {' '.join(RNG.choice(items)[1].split()[:25])} {prose(30)}" if i % 2 else prose(80)) for i in range(120)] + [(None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r.items), tuple(map(tuple, r.spans))) for r in decontaminate.contamination(docs, bench).collect())
    one = found()
    monkeypatch.setattr(decontaminate, "PHRASES", 50)
    assert found() == one and sum(r[2] > 0 for r in one) > 40


def test_no_index_is_left_behind(spark):
    docs = spark.createDataFrame([(1, prose(30))], "doc_id long, text string")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    indexes = lambda: {d for d in os.listdir(shared) if d.startswith("postings-")} if os.path.isdir(shared) else set()
    before = indexes()
    decontaminate.contamination(docs, docs.withColumnRenamed("doc_id", "item_id")).collect()
    assert indexes() == before
