"""Sharding along a Hilbert curve.

Each metadata column is quantised into cells of equal depth (splits from exact value counts over all rows; at most
2^bits of them, so they travel as literals), the cells become a Hilbert index, rows are sorted by it across the
cluster and cut into runs. Neighbouring rows have neighbouring metadata in every dimension, so a filter on any of
the columns touches few shards. Equal texts of one cell lie side by side.

Defined cases: a null in a dimension has cell 0; a null text counts no bytes and has checksum 0, texts of any length are
measured whole; repeated rows are placed each, and ties are ordered by checksum, size and id; a dimension may be any
column that sorts, and other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, running_total, table


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cells (n x d integers below 2^bits), by the transform of J. Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def splits(rows: DataFrame, column: str, bits: int) -> list:
    """(value, cell) pairs that cut the rows into at most 2^bits cells of about equal depth, from counts over all rows."""
    counts = cut(rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0]
    if not total:
        return []
    cells = running_total(counts, column, "_n").withColumn("_cell", F.floor(F.col("_before") * (1 << bits) / total).cast("int"))
    return sorted((r[1], r[0]) for r in cells.groupBy("_cell").agg(F.min(column)).collect())  # at most 2^bits rows


def cell(column: str, cuts: list) -> Column:
    """The cell of a value: that of the last cut which it has passed. Few values lie as far apart as their shares of the rows say."""
    if not cuts:
        return F.lit(0)
    passed = F.filter(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in cuts)), lambda c: c["v"] <= F.col(column))
    return F.coalesce(F.try_element_at(passed, F.lit(-1))["k"], F.lit(0))


def shard_rows(docs: DataFrame, dimensions: Sequence[str], shards: int, bits: int = 6, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """docs' id, size, text_crc32 and curve index with shard and slot; shard sizes differ by one row at most. With carry also the whole row, as `row`."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text).alias("_crc"), *(F.col(c).alias(f"_d{i}") for i, c in enumerate(dimensions)), *([F.struct(*docs.columns).alias("_row")] if carry else []))
    rows = cut(rows)  # a few bytes a row, unless rows are carried; the texts are read once

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(cells.to_numpy(), bits))

    cells = [cell(f"_d{i}", splits(rows, f"_d{i}", bits)).cast("int").alias(f"c{i}") for i in range(len(dimensions))]
    placed = rows.withColumn("_curve", curve(F.struct(*cells))).select("_curve", "_crc", "_size", "_id", *(["_row"] if carry else []))
    order, total = ranked(placed, ["_curve", "_crc", "_size", "_id"])
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    slot = F.col("_rank") - F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return order.withColumn("_shard", shard).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_curve").alias("curve"), F.col("_shard").cast("int").alias("shard"), slot.alias("slot"), *([F.col("_row").alias("row")] if carry else []))


def write_shards(docs: DataFrame, path: str, dimensions: Sequence[str], shards: int, id_col: str = "doc_id", folder: str = "shard") -> None:
    """Writes docs as one folder per shard, rows in curve order. A shard may hold several files, each a run of the order."""
    placed = shard_rows(docs, dimensions, shards, id_col=id_col, carry=True)
    placed.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
