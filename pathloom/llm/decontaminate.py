"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents, as search engines do: a shard holds a run of documents, and for each term the sorted
places where it stands in the shard. A term in every document is thus split over all shards. It holds every term of the
documents and is stored as Parquet, so that other phrases can be looked up later (`build_index`, `search`).

The items' phrases are a table too: each goes to the shards in which the rarest of its terms stands, by a join on that
term, and meets there the places of its other terms. The places of the rarest term in the shard, moved by its offset in the phrase, are
intersected with those of the next rarest until none are left or all terms agree. With `slop` each further term may
stand that many places off (proximity match). Nothing is broadcast but the items' distinct terms, after they were counted and
found to be few, and nothing of the items or documents passes through the driver; a task holds one shard's places and at most about PHRASES phrases at a time.

Defined cases: null and empty texts have no words and no hits; texts of any length are read whole; an item without words
has no window, one with fewer than `size` words is one window; items of one id count as one; equally rare terms are taken in the
phrase's order; repeated rows, and rows with a null id, are answered each; other columns are ignored; an empty table of
documents gives an empty result, an empty table of items no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, in_batches, removed, shared_folder, table

#: Letters A-Z become small, digits, small letters and all bytes from 128 stay, everything else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_WORDS = 1_500_000
PHRASES = 200_000
#: Places left free between documents, so that no phrase runs from one into the next.
GAP = 64
#: Stands for a null id inside a shard.
NO_ID = -(1 << 63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11) >> 1 or 1


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.int64)


class Terms(dict):
    """word -> its term, for up to 150,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 11) >> 1 or 1
        return got


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, term, n, places): for each shard and term its number of places and these, of 32 bits each. Term 0 lists the shard's documents: pairs of id and word count.

    Stored at path, by default in a folder of its own in the shared one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        bases: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            terms = np.concatenate(parts)
            places = np.flatnonzero(terms)
            at = np.repeat(np.array(bases, np.int64) - np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])), [len(p) for p in parts])
            terms, places = terms[places], places + at[places]
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            starts = np.flatnonzero(np.diff(terms, prepend=0)) if len(terms) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(terms))
            first = np.array(held, np.int64).tobytes()
            offsets = np.concatenate(([0], len(first) + 4 * starts, [len(first) + 4 * len(terms)])).astype(np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(starts) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(first + places.astype(np.uint32).tobytes())])
            return pa.RecordBatch.from_arrays(
                [pa.repeat(f"{task}-{shard}", len(starts) + 1), pa.array(np.concatenate(([0], terms[starts]))), pa.array(np.concatenate(([len(held)], ends - starts))), lists], names=["shard", "term", "n", "places"]
            )

        memory = Terms()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                found = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
                held.append((NO_ID if i is None else i, len(words)))
                parts.append(found)
                bases.append(size)
                size += len(words) + GAP
                if size >= SHARD_WORDS:
                    yield flush()
                    held, parts, bases, size, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    path = path or f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    in_batches(docs.select(F.col(id_col).cast("long"), text_col), run, "shard string, term long, n long, places binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def occurrences(postings: dict[int, np.ndarray], phrase: tuple[int, ...], slop: int = 0) -> np.ndarray:
    """Where a phrase starts in a shard. The rarest terms come first; a missing one ends the search."""
    lists = []
    for offset, t in enumerate(phrase):
        got = postings.get(t)
        if got is None:
            return np.zeros(0, np.int64)
        lists.append((len(got), offset, got))
    lists.sort(key=lambda x: x[:2])
    starts = lists[0][2] - lists[0][1]
    for _, offset, got in lists[1:]:
        k = np.searchsorted(got, starts + offset - slop)
        starts = starts[(k < len(got)) & (got[np.minimum(k, len(got) - 1)] <= starts + offset + slop)]
        if not len(starts):
            break
    return starts


def windows_of(words: list[bytes], size: int) -> set[tuple[int, ...]]:
    terms = list(map(term, words))
    return {tuple(terms[i : i + size]) for i in range(max(1, len(terms) - size + 1))} if terms else set()


def phrases_of(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, item): the windows of each item's text as terms of 64 bits, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.array(w, np.int64).tobytes(), i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for w in windows_of(words_of(t.as_py()), size)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["phrase", "item"])

    return in_batches(items.select(F.col(id_col).cast("string"), text_col), run, "phrase binary, item string").distinct()


def terms_of(phrases: DataFrame) -> DataFrame:
    """(phrase, offset, term) of distinct phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(p, np.frombuffer(p, np.int64)) for p in batch.column(0).to_pylist()]
            sizes = [len(t) for _, t in each]
            names = [p for p, t in each for _ in range(len(t))]
            flat = np.concatenate([t for _, t in each]) if each else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([k for n in sizes for k in range(n)], pa.int32()), pa.array(flat)], names=["phrase", "offset", "term"])

    return in_batches(phrases.select("phrase").distinct(), run, "phrase binary, offset int, term long")


def search(index: DataFrame, phrases: DataFrame, id_col: str = "doc_id", slop: int = 0) -> DataFrame:
    """One row for each document of the index: id, n_words, n_hit (words inside a match), items (sorted ids), spans of hit words."""
    wanted = cut(terms_of(phrases))
    # if the items' terms are few, the index is not shuffled by term, of which a frequent one has a row in every shard
    places = cut(index.join(broadcast_if_small(cut(wanted.select("term").distinct())), "term", "left_semi"))
    counts = places.groupBy("term").agg(F.sum("n").alias("total"))
    known = wanted.join(counts, "term", "left").groupBy("phrase").agg(F.min_by("term", F.struct("total", "offset")).alias("term"), F.count(F.when(F.col("total").isNull(), 1)).alias("missing"))
    slices = max(1, -(-known.count() // PHRASES))
    slice_of = F.pmod(F.xxhash64("phrase"), F.lit(slices)).cast("int").alias("slice")
    asked = known.filter("missing = 0").join(places.select("shard", "term"), "term").select("shard", slice_of, "phrase")
    # a slice of phrases gets the places of its own terms, and the shard's documents
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    sent = places.join(wanted.select("term", slice_of).distinct(), "term") if slices > 1 else places.withColumn("slice", F.lit(0))
    held = index.filter("term = 0").select("shard", every, "term", "places").unionByName(sent.select("shard", "slice", "term", "places"))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        postings, docs = {}, np.zeros((0, 2), np.int64)
        for t, raw in zip(rows.column("term").to_pylist(), rows.column("places")):
            if t:
                postings[t] = unpack(raw.as_py())
            else:
                docs = np.frombuffer(raw.as_py(), np.int64).reshape(-1, 2)
        bases = np.concatenate(([0], np.cumsum(docs[:, 1] + GAP)))
        edge = np.zeros(bases[-1] + GAP + 1, np.int32)
        matched: dict[int, list[bytes]] = {}
        for raw in found.column("phrase"):
            phrase = raw.as_py()
            terms = tuple(np.frombuffer(phrase, np.int64).tolist())
            starts = occurrences(postings, terms, slop)
            if len(starts):
                which = np.searchsorted(bases, starts, side="right") - 1
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.minimum(starts + len(terms), bases[which] + docs[which, 1]), -1)
                for d in set(which.tolist()):
                    matched.setdefault(d, []).append(phrase)
        hit = np.cumsum(edge) > 0
        spans = []
        for k in range(len(docs)):
            turn = np.flatnonzero(np.diff(hit[bases[k] : bases[k] + docs[k, 1]].astype(np.int8), prepend=0, append=0)).tolist() if k in matched else []
            spans.append([{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        shard = rows.column("shard")[0].as_py() if len(rows) else ""
        return pa.table({
            "shard": pa.array([shard] * len(docs), pa.string()), "place": pa.array(np.arange(len(docs))), "id": pa.array(docs[:, 0], mask=docs[:, 0] == NO_ID), "n_words": pa.array(docs[:, 1]),
            "spans": pa.array(spans, kind), "phrases": pa.array([matched.get(k, []) for k in range(len(docs))], pa.list_(pa.binary())),
        })

    schema = "shard string, place long, id long, n_words long, spans array<struct<start:long,end:long>>, phrases array<binary>"
    parts = cut(held.groupBy("shard", "slice").cogroup(asked.groupBy("shard", "slice")).applyInArrow(run, schema))
    owned = parts.filter(F.size("phrases") > 0).select("shard", "place", F.explode("phrases").alias("phrase")).join(phrases, "phrase").groupBy("shard", "place").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # what the slices of a shard found in a document is put together; spans that touch become one
    whole = parts.groupBy("shard", "place").agg(F.first("id", True).alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("_s"))
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    begun = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), none.alias("last"))

    def put(state, span):
        last = state["last"]
        joins = last.isNotNull() & (span["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.struct(F.when(joins | last.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(last))).alias("done"), F.when(joins, longer).otherwise(span).alias("last"))

    joined = F.aggregate("_s", begun, put, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))
    out = whole.withColumn("spans", joined).join(owned, ["shard", "place"], "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """search() of every window of `size` words of the items' texts in all docs."""
    path = f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    found = search(build_index(docs, path), cut(phrases_of(items, size)), slop=slop)
    removed(docs.sparkSession, path)  # what was found is stored by now
    return found


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB SQL.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM p),
d AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM w, n WHERE len(ws) >= n)),
m AS (SELECT d.doc_id, d.k, d.n, p.item_id FROM d JOIN p ON d.phrase = p.phrase AND d.n = p.n),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
