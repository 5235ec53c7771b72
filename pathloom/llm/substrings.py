"""Substring deduplication by Rabin-Karp hashes of every window of `size` words.

Each map task hashes every window of its documents (a polynomial over 64-bit word hashes) and deals the hashes into
buckets by their value; a bucket of a batch of documents travels as one packed row. Within a batch only the smallest
document that has a window sends it; for the others it is known at once that a smaller one has it. A bucket is then counted
in one task: every (window, document) that is not the smallest of its window goes, by its place, to the document's group,
where it meets the text again and overlapping windows merge into maximal intervals to remove.

Hot windows: a passage that a third of all documents share is sent once per batch. Buckets grow in number with the input. Beyond
LEVEL of them a batch would hold too few windows of each to pack; windows then travel in two steps, first by the LEVEL ranges of their
hashes, in which batches of one range form anew, then by bucket. What a batch costs does not depend on the number of buckets.

Defined cases: null and empty texts and texts of fewer than `size` words lose nothing, nor do rows with a null id; a
document never loses words for a repeat inside itself only; texts of any length are taken whole; repeated rows of one id count as
one document, and where their texts differ what one loses at a place the others lose there too; other columns are
ignored; an empty table gives an empty result. Two windows are taken for one if the 56 low bits and the bucket of their hashes agree: among n
windows about n^2 / 2^63 pairs are expected to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, input_partitions, shuffle_partitions, table

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of a batch: what one task holds at a time. A longer document is a batch of its own.
BATCH_WORDS = 1_500_000
#: Ranges of hashes of a first step; with these the highest byte of a hash follows from its range.
LEVEL = 1024


class WordHashes(dict):
    """XXH64 of words, remembered for up to a million of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of `size` word hashes, modulo 2^64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= BASE
        out += words[k : k + n]
    return out ^ (out >> np.uint64(31))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of data's bytes as a column; offsets in bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def packed_places(places: np.ndarray, runs_at: np.ndarray, rows_at: np.ndarray) -> pa.Array:
    """One binary a row: places as 16-bit steps within a document, low bytes first, then high bytes; as 32-bit numbers if a step of the row is too long."""
    steps = np.diff(places, prepend=0)
    steps[runs_at] = places[runs_at]
    sizes = np.diff(np.append(rows_at, len(places)))
    wide = np.maximum.reduceat(steps, rows_at) >= 1 << 16
    offsets = np.concatenate(([0], np.cumsum(1 + sizes * np.where(wide, 4, 2))))
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = wide
    inside = np.arange(len(places)) - np.repeat(rows_at, sizes)
    first, size, is_wide = np.repeat(offsets[:-1] + 1, sizes), np.repeat(sizes, sizes), np.repeat(wide, sizes)
    short = ~is_wide
    at = first[short] + inside[short]
    out[at] = steps[short] & 255
    out[at + size[short]] = steps[short] >> 8
    at = first[is_wide] + 4 * inside[is_wide]
    for k in range(4):
        out[at + k] = places[is_wide] >> 8 * k & 255
    return binaries(out, offsets)


def unpack_places(raw: bytes, counts: np.ndarray) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw[1:], "<u4").astype(np.int64)
    steps = np.ascontiguousarray(np.frombuffer(raw[1:], np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
    total = np.cumsum(steps)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    return total - np.repeat(total[starts] - steps[starts], counts)


def rows_by(key: np.ndarray, ids: np.ndarray, places: np.ndarray, hashes: np.ndarray | None = None) -> list[pa.Array]:
    """Windows (by id, then place) as one row per key that occurs: columns key, ids, windows of each, places, hashes.

    Of a hash seven bytes travel: the eighth, its highest, follows from the bucket or its range, but for a bit.
    """
    order = np.argsort(key, kind="stable")
    key, ids, places = key[order], ids[order], places[order]
    new_key = np.diff(key, prepend=key[:1] - 1) != 0
    rows_at = np.flatnonzero(new_key)
    runs_at = np.flatnonzero(new_key | (np.diff(ids, prepend=ids[:1]) != 0))
    lengths = np.diff(np.append(runs_at, len(key))).astype(np.uint32)
    first_runs = np.append(np.searchsorted(runs_at, rows_at), len(runs_at))
    sent = pa.array([b""] * len(rows_at), pa.binary()) if hashes is None else binaries(np.ascontiguousarray(hashes[order]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], 7 * np.append(rows_at, len(key)))
    return [pa.array(key[rows_at], pa.int32()), binaries(ids[runs_at].view(np.uint8), 8 * first_runs), binaries(lengths.view(np.uint8), 4 * first_runs), packed_places(places, runs_at, rows_at), sent]


def first_starts(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of windows by id, which have a hash that occurs under a smaller id too."""
    order = np.argsort(hashes, kind="stable")
    h, i = hashes[order], ids[order]
    new = np.diff(h, prepend=~h[:1]) != 0
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    loses = np.zeros(len(h), bool)
    loses[order] = i > least
    return loses


def dealt(ids: np.ndarray, places: np.ndarray, hashes: np.ndarray, buckets: int, groups: int, names: list[str]) -> pa.RecordBatch:
    """A batch of windows (by id, then place): those of the smallest document of each go by bucket of their hash, the others, known already, by group of documents."""
    loses = first_starts(hashes, ids)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    parts = [rows_by(bucket[~loses], ids[~loses], places[~loses], hashes[~loses])]
    if loses.any():
        parts.append(rows_by(group_of(ids[loses], groups), ids[loses], places[loses]))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(columns) for columns in zip(*parts)], names=names)


def unpack_hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that each id belongs to; `group_column` says the same in Spark."""
    unique, inverse = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % i) % groups for i in unique.tolist()], np.int64)[inverse]


def group_column(id_col: str, text_col: str, groups: int) -> Column:
    """The group of a row; rows without an id, which lose nothing, are spread by their texts."""
    return (F.coalesce(F.crc32(F.col(id_col).cast("string")), F.crc32(text_col), F.lit(0)) % groups).cast("int")


def repeated_places(docs: DataFrame, buckets: int, size: int = 13, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """Windows that also start in a document with a smaller id: (grp, ids, counts, places), packed by group of documents; many rows a group."""
    schema = "key int, ids binary, counts binary, places binary, hashes binary"
    names = ["key", "ids", "counts", "places", "hashes"]
    two_steps = buckets > level
    fine = -(-buckets // level)
    all_buckets = level * fine if two_steps else buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        held: list[tuple[int, np.ndarray]] = []
        words = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            ids = np.repeat(np.array([i for i, _ in held], np.int64), [len(h) for _, h in held])
            places = np.concatenate([np.arange(len(h), dtype=np.int64) for _, h in held])
            hashes = np.concatenate([h for _, h in held])
            held.clear()
            return dealt(ids, places, hashes, level if two_steps else buckets, buckets, names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                split = (text.as_py() or "").encode().split()
                if len(split) >= size and i is not None:
                    h = window_hashes(np.fromiter(map(memory.__getitem__, split), np.uint64, len(split)), size)
                    held.append((i, h))
                    words += len(h)
                    if words >= BATCH_WORDS:
                        yield flush()
                        words = 0
        if held:
            yield flush()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range after the other: batches of its windows, dealt by bucket."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now, windows = None, 0

        def flush() -> pa.RecordBatch:
            ids, places, hashes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((places, ids))
            return dealt(ids[order], places[order], hashes[order], all_buckets, buckets, names)

        for batch in batches:
            known = pc.equal(pc.binary_length(batch.column(4)), 0)
            if pc.any(known).as_py():
                yield batch.filter(known)
            for key, ids, counts, places, hashes in zip(*(c.to_pylist() for c in batch.filter(pc.invert(known)).columns)):
                if held and (key != now or windows >= BATCH_WORDS):
                    yield flush()
                    windows = 0
                now = key
                n = np.frombuffer(counts, np.uint32).astype(np.int64)
                # the range says what the highest byte is: a step of hashes is 2^64 / level wide
                top = np.uint64((key << 32) // level >> 24 << 56)
                held.append((np.repeat(np.frombuffer(ids, np.int64), n), unpack_places(places, n), unpack_hashes(hashes) | top))
                windows += len(held[-1][0])
        if held:
            yield flush()

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        ids, places, hashes, out = [], [], [], []
        for i, c, p, h in zip(*(rows.column(n) for n in names[1:])):
            if not len(h.as_py()):
                out.append((key[0].as_py(), i.as_py(), c.as_py(), p.as_py()))
                continue
            n = np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
            hashes.append(unpack_hashes(h.as_py()))
            places.append(unpack_places(p.as_py(), n))
            ids.append(np.repeat(np.frombuffer(i.as_py(), np.int64), n))
        found = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int32(), *[pa.binary()] * 3])]
        if hashes:
            h = np.concatenate(hashes)
            del hashes
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.diff(h, prepend=~h[:1]) != 0
            single = new & np.append(new[1:], True)
            order, new = order[~single], new[~single]  # windows that start once have nothing to say
            i, p = np.concatenate(ids)[order], np.concatenate(places)[order]
            if len(i):
                lost = i > np.minimum.reduceat(i, np.flatnonzero(new))[np.cumsum(new) - 1]
                i, p = i[lost], p[lost]
                order = np.lexsort((p, i))
                i, p = i[order], p[order]
                if len(i):
                    found = [pa.concat_arrays(pair) for pair in zip(found, rows_by(group_of(i, buckets), i, p))]
        return pa.table(found, names=["grp", *names[1:4]])

    sent = in_batches(docs.select(F.col(id_col).cast("long"), text_col), send, schema)
    if two_steps:
        many = shuffle_partitions(docs.sparkSession)
        slices = -(-4 * many // level)  # a range may lie in several tasks
        sent = sent.repartition(many, "key", F.pmod(F.xxhash64("ids"), F.lit(slices))).sortWithinPartitions("key")
        sent = in_batches(sent, again, schema)
    return sent.groupBy("key").applyInArrow(count, "grp int, ids binary, counts binary, places binary")


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true as (start, end)."""
    step = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return list(zip(step[::2].tolist(), step[1::2].tolist()))


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (the words left, joined by one space), removed (intervals of word places)."""
    buckets = max(shuffle_partitions(docs.sparkSession), 4 * input_partitions(docs))
    found = repeated_places(docs, buckets, size, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")).select(group_column(id_col, "_text", buckets).alias("grp"), id_col, "_text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(rows: pa.Table, lost: pa.Table) -> pa.Table:
        ids, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, c, p in zip(*(lost.column(n) for n in ("ids", "counts", "places"))):
            n = np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
            ids.append(np.repeat(np.frombuffer(i.as_py(), np.int64), n))
            starts.append(unpack_places(p.as_py(), n))
        who, at = np.concatenate(ids), np.concatenate(starts)
        order = np.argsort(who, kind="stable")
        who, at = who[order], at[order]
        total, removed, kept, spans = [], [], [], []
        for i, text in zip(rows.column(id_col).to_pylist(), rows.column("_text")):
            words = (text.as_py() or "").encode().split()
            mine = at[np.searchsorted(who, i) : np.searchsorted(who, i, side="right")] if i is not None else at[:0]
            gone = intervals(covered(len(words), mine, size)) if len(mine) else []
            left, place = [], 0
            for a, b in gone:
                left += words[place:a]
                place = b
            total.append(len(words))
            removed.append(sum(b - a for a, b in gone))
            kept.append(b" ".join(left + words[place:]).decode())
            spans.append([{"start": a, "end": b} for a, b in gone])
        return pa.table({id_col: rows.column(id_col), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "removed": pa.array(spans, kind)})

    return texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(apply, f"`{id_col}` long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB SQL.
OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS phrase FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w WHERE len(ws) >= 13)),
f AS (SELECT phrase, min(doc_id) AS first FROM k GROUP BY phrase HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS place FROM k JOIN f ON k.phrase = f.phrase AND k.doc_id > f.first),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
left_over AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.place) AS kept FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.place = gone.place GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN left_over ON w.doc_id = left_over.doc_id
"""
