"""Importance resampling towards a target corpus, by hashed n-gram weights over bucket-partitioned postings.

Features are all runs of one to three words, hashed to BUCKETS places (crc32). A bucket's gain is the scaled logarithm of its
share in the target against its share in the documents (one added to each count); a document's weight is the sum of its
features' gains; the draw takes the highest weights plus Gumbel noise from a hash of the id, which is sampling without
replacement in proportion to the exponentials of the weights.

  1. Each text is read once and turned into inverted postings: blocks of about `most` postings, cut by groups of buckets and
     stored in the shared folder. Within a block and group a posting's bucket and document are one rising number, kept as gaps
     of a byte or more, so that a posting takes between one and two bytes.
  2. Counts of a bucket are added up in each block, then by Spark, for both corpora, and co-grouped by bucket.
  3. The postings are shuffled by group of buckets, each group in slices of blocks, so that no bucket, however common, has to
     be in one task; with each slice come its buckets' counts in both corpora, from which the gains are computed
     there, as are the contributions to the documents' weights.
  4. Contributions, one array of sums for each block and task, are reduced by block, which gives one row for each document.
  5. A range-partitioned sort ranks the documents; the driver sees one count for each partition.

Nothing is broadcast and no bucket, document or block is held whole but for one block's sums. The postings are deleted once the
weights are stored.

Defined cases: null and empty texts have no features, weight 0 and no rank; rows of one id draw the same noise and
count each; a null id draws as an empty one and sorts first; ties of score go to the smaller id, and equal rows are
interchangeable; texts of any length are read whole, in stretches of about STRETCH bytes; an empty target has no features,
which leaves all gains defined; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_batches, ranked, removed, shared_folder, shuffle_partitions, table

BUCKETS, GROUPS = 10_000, 64
#: Buckets of one group: bucket b is place b // GROUPS of group b % GROUPS.
PLACES = -(-BUCKETS // GROUPS)
POSTINGS, BLOCK_DOCS = 2_000_000, 50_000
STRETCH = 1 << 20
#: A-Z lower-cased, digits and bytes of other characters as they are, all else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Contributions are handed on when so many sums have gathered in a task.
HELD = 1 << 20


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about STRETCH bytes of text at a time."""
    text = text.translate(WORD_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def buckets(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, the text's buckets in rising order, how often each)."""
    n, last, counts = 0, [], None
    for new in stretches(text):
        words, known = last + new, len(last)
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))  # the checksum of two words goes on from that of the first
        three = list(map(crc32, spaced[2:], two))
        found = np.fromiter(chain(one[known:], two[max(known - 1, 0) :], three[max(known - 2, 0) :]), np.int64) % BUCKETS
        n, last = n + len(new), words[-2:]
        if counts is None and len(text) <= STRETCH:
            return n, *np.unique(found, return_counts=True)
        counts = np.bincount(found, minlength=BUCKETS) + (0 if counts is None else counts)
    if counts is None:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.flatnonzero(counts)
    return n, each, counts[each]


def gaps(values: np.ndarray) -> bytes:
    """Numbers of 0 or more as bytes: 255 as often as it goes, then the rest."""
    ends = np.cumsum(values // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = values % 255
    return out.tobytes()


def sums_of_gaps(data: bytes) -> np.ndarray:
    """The running sums of the numbers in data."""
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


BLOCK = "block string, grp int, docs int, keys binary, counts binary, bucket array<int>, total array<long>"


def postings(docs: DataFrame, path: str, id_col: str, text_col: str, most: int = POSTINGS) -> DataFrame:
    """Stores the inverted postings of docs. A row of a block holds one group's postings; that of group -1 holds its documents."""
    id_type = docs.schema[id_col].dataType
    kind = T.StructType([*T.StructType.fromDDL(BLOCK).fields, T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL("words array<long>, features array<long>").fields])

    def rows(name: str, ids: pa.Array, words: list[int], features: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n = len(words)
        key, count = np.concatenate(keys), np.concatenate(counts)
        bucket, doc = key // n if n else key, key % n if n else key
        # by group, then bucket, then document; no two are equal
        place = (bucket % GROUPS * PLACES + bucket // GROUPS) * n + doc
        order = np.argsort(place)
        place, count = place[order], count[order]
        edges = np.searchsorted(place, np.arange(GROUPS + 1) * PLACES * n)
        out = [(name, -1, n, None, None, None, None)]
        for g in range(GROUPS):
            a, b = edges[g], edges[g + 1]
            if a < b:
                inside, c = place[a:b] - g * PLACES * n, count[a:b]
                at = np.flatnonzero(np.diff(inside // n, prepend=-1))
                out.append((name, g, n, gaps(np.diff(inside, prepend=0)), gaps(c - 1), (inside[at] // n * GROUPS + g).tolist(), np.add.reduceat(c, at).tolist()))
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        none = len(out) - 1
        for values in (ids, pa.array(words, pa.int64()), pa.array(features, pa.int64())):
            columns.append(pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values), pa.nulls(none, pa.list_(values.type))]))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in kind.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), 0
        ids, found, size = [], [], 0

        def block() -> pa.RecordBatch:
            n = len(found)
            keys = [each * n + k for k, (_, each, _) in enumerate(found)]
            features = [3 * w - 3 if w > 2 else (0, 1, 3)[w] for w, *_ in found]
            return rows(f"{task}-{blocks}", pa.concat_arrays(ids), [w for w, *_ in found], features, keys, [c for *_, c in found])

        for batch in batches:
            ids.append(batch.column(0).slice(0, 0))
            begun = 0
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                got = buckets(text.as_py() or b"")
                found.append(got)
                size += len(got[1])
                if size >= most or len(found) >= BLOCK_DOCS:
                    ids.append(batch.column(0).slice(begun, k + 1 - begun))
                    yield block()
                    ids, found, size, begun, blocks = [batch.column(0).slice(0, 0)], [], 0, k + 1, blocks + 1
            ids.append(batch.column(0).slice(begun))
        if found:
            yield block()

    in_batches(docs.select(id_col, text_col), run, ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)).write.parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def bucket_counts(blocks: DataFrame, name: str) -> DataFrame:
    """(bucket, how many features), at most BUCKETS rows."""
    pairs = blocks.filter("grp >= 0").select(F.explode(F.arrays_zip("bucket", "total")).alias("p"))
    return pairs.groupBy(F.col("p.bucket").alias("bucket")).agg(F.sum("p.total").alias(name))


def gain(own: Column, wanted: Column, all_own: int, all_wanted: int) -> Column:
    share = (wanted.cast("double") + 1) * F.lit(float(all_own + BUCKETS)) / ((own.cast("double") + 1) * F.lit(float(all_wanted + BUCKETS)))
    return F.floor(F.lit(1000.0) * F.log(share))


def contributions(slices: DataFrame) -> DataFrame:
    """(block, sums) rows: for each task and block the gains of its postings, added up for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])

        for batch in batches:
            for block, n, keys, counts, places, gains in zip(*(batch.column(k) for k in range(6))):
                n, block = n.as_py(), block.as_py()
                by_place = np.zeros(PLACES, np.int64)
                by_place[places.values.to_numpy()] = gains.values.to_numpy()
                key = sums_of_gaps(keys.as_py())
                count = np.diff(sums_of_gaps(counts.as_py()), prepend=0) + 1
                if block not in sums:
                    if held and held + n > HELD:
                        yield out()
                        sums.clear()
                        held = 0
                    sums[block] = np.zeros(n, np.int64)
                    held += n
                # no document's sum within a block comes near 2^53, so doubles add exactly
                sums[block] += np.bincount(key % n, by_place[key // n] * count, n).astype(np.int64)
        if sums:
            yield out()

    return in_batches(slices.select("block", "docs", "keys", "counts", "places", "gains"), run, "block string, sums binary")


def document_weights(parts: DataFrame, id_type: T.DataType) -> DataFrame:
    """(id, words, features, weight), one row a document, of rows sorted by block, each block's documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head, weight = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays([x.values for x in head] + [pa.array(weight, pa.int64())], names=["id", "words", "features", "weight"])
            for k in range(0, len(weight), 10_000):
                yield whole.slice(k, 10_000)

        for batch in batches:
            for name, sums, *lists in zip(*(batch.column(k) for k in range(5))):
                if name.as_py() != block:
                    if block is not None:
                        yield from done()
                    block, head = name.as_py(), [pa.scalar(x.as_py(), x.type) for x in lists]
                    weight = np.zeros(len(head[0]), np.int64)
                if sums.is_valid:
                    weight += np.frombuffer(sums.as_py(), np.int64)
        if block is not None:
            yield from done()

    return in_batches(parts.select("block", "sums", "ids", "words", "features"), run, "words long, features long, weight long", [T.StructField("id", id_type)])


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = POSTINGS) -> DataFrame:
    """(id, words, features, weight) of each row of docs, stored in the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/importance-{uuid.uuid4().hex}"
    blocks = postings(docs, f"{folder}/documents", id_col, text_col, most)
    wanted = postings(target.withColumn("_id", F.lit(0)), f"{folder}/target", "_id", text_col, most)
    both = cut(bucket_counts(blocks, "own").join(bucket_counts(wanted, "wanted"), "bucket", "full").select("bucket", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("wanted", F.lit(0)).alias("wanted")))
    totals = both.agg(F.sum("own"), F.sum("wanted")).first()

    # each group of buckets lies in so many slices that a task has several, whatever group is the largest
    slices = -(-shuffle_partitions(spark) // 4)
    sides = both.groupBy((F.col("bucket") % GROUPS).alias("grp")).agg(F.collect_list(F.struct((F.col("bucket") / GROUPS).cast("int").alias("place"), "own", "wanted")).alias("counts_of"))  # BUCKETS entries in all
    sides = sides.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = blocks.filter("grp >= 0").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).select("grp", "slice", "block", "docs", "keys", "counts")
    met = dealt.join(sides.hint("merge"), ["grp", "slice"]).select(
        "block", "docs", "keys", "counts", F.col("counts_of.place").alias("places"), F.transform("counts_of", lambda x: gain(x["own"], x["wanted"], totals[0] or 0, totals[1] or 0)).alias("gains"))
    heads = blocks.filter("grp = -1").select("block", F.lit(None).cast("binary").alias("sums"), "ids", "words", "features")
    parts = heads.unionByName(contributions(met), allowMissingColumns=True)
    parts = parts.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", F.col("sums").isNotNull())
    out = cut(document_weights(parts, docs.schema[id_col].dataType))
    removed(spark, folder)
    return out


def resampled(docs: DataFrame, target: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, least_words: int = 20, most: int = POSTINGS) -> DataFrame:
    """id, n_features, weight, score and rank of each row of docs; rank is null for what isn't drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    rows = weights(docs, target, id_col, text_col, most).withColumns({"score": score, "short": F.col("words") < least_words})
    drawn = percent * rows.filter("NOT short").count() // 100
    order, _ = ranked(rows.withColumn("down", -F.col("score")), ["short", "down", "id"])
    return order.select(F.col("id").alias(id_col), F.col("features").alias("n_features"), "weight", "score", F.when(F.col("_rank") < drawn, F.col("_rank") + 1).alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5)


#: The checksum's table is linear: an entry is the sum (xor) of those of its bits, which are eight fixed values.
OP13_SQL = r"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS doc, doc_id, text FROM documents
  UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
words AS (
  SELECT side, doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
grams AS (
  SELECT side, doc, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT side, doc, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)),
counted AS (SELECT side, doc, g, count(*) AS n FROM grams GROUP BY ALL),
features AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)]), lambda c, b:
    xor(c >> 8, xor(xor(xor((xor(c, b) & 1) * 1996959894, ((xor(c, b) >> 1) & 1) * 3993919788), xor(((xor(c, b) >> 2) & 1) * 124634137, ((xor(c, b) >> 3) & 1) * 249268274)),
      xor(xor(((xor(c, b) >> 4) & 1) * 498536548, ((xor(c, b) >> 5) & 1) * 997073096), xor(((xor(c, b) >> 6) & 1) * 1994146192, ((xor(c, b) >> 7) & 1) * 3988292384))))), 4294967295) % 10000 AS bucket
  FROM features),
placed AS (SELECT side, doc, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
sums AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS DOUBLE) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
weighed AS (SELECT doc, CAST(sum(n * gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc),
scored AS (
  SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 2 THEN 3 * len(w) - 3 WHEN len(w) = 2 THEN 3 ELSE len(w) END AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (doc) WHERE side = 0),
ordered AS (SELECT *, row_number() OVER (ORDER BY words < 20, score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE words >= 20) // 100 THEN place END AS rank
FROM ordered
"""
