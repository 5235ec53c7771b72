"""Quality classifier: naive Bayes log-count ratios as feature weights, then a linear support vector machine.

Features are indicators of n-grams: words, and runs of one to three word shapes (case, digits and the punctuation around a
word), hashed to 2^18 places. Each indicator is scaled by the log-count ratio of the two classes; a hinge-loss linear
model is fitted to these by dual coordinate descent (Hsieh et al., 2008), and a sigmoid fitted to margins on a part kept
aside turns margins into scores.

The model is fitted on a bounded sample: at most `max_rows` labelled rows, those with the smallest hash of the id, as far as
they hold no more than `max_places` places together (120 MB on the driver). Every document is scored on its whole text.

Defined cases: null and empty texts have no n-grams and score by the intercept; texts of any length are read whole; rows with
several labels count each, as do repeated rows; a score of 0.5 counts as good; columns are taken by position, so other columns
don't matter; without labels, or with one class only, every score is the share of good labels, or 0.5; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_batches, table

BITS = 18
MAX_ROWS, MAX_PLACES = 6000, 30_000_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
EDGES = re.compile(r"(?s)^(\W*)(.*?)(\W*)$")


def shape(word: str) -> str:
    """Punctuation before and after a word around a mark of its kind: a small, A capitalised, U capitals, 0 with digits, - none."""
    before, core, after = EDGES.match(word).groups()
    kind = "-" if not core else "0" if any(c.isdigit() for c in core) else "a" if core.islower() else "U" if len(core) > 1 and core.isupper() else "A"
    return f"{before[:4]}{kind}{after[:4]}"


class Hashes(dict):
    """word -> (hash of the word, hash of its shape), for up to 100,000 words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = (xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape(word), 2))
        return got


def places(text: str | None, memory: Hashes) -> np.ndarray:
    """The distinct feature places of a text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    both = np.array([memory[w] for w in words], np.uint64)
    s = both[:, 1]
    grams = [both[:, 0], s]
    if len(s) > 1:
        grams.append(s[:-1] * MULTIPLY + s[1:] * np.uint64(31))
    if len(s) > 2:
        grams.append((s[:-2] * MULTIPLY + s[1:-1]) * MULTIPLY + s[2:] * np.uint64(37))
    flags = np.zeros(1 << BITS, bool) if len(words) > 50_000 else None
    at = np.concatenate(grams)
    at = ((at ^ (at >> np.uint64(29))) * MULTIPLY >> np.uint64(64 - BITS)).astype(np.int64)
    if flags is None:
        return np.unique(at)
    flags[at] = True
    return np.flatnonzero(flags)


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smoothing)
    for x, y in zip(rows, good):
        counts[int(y), x] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def fit_margin(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = 0.1, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear hinge-loss model over scaled indicators, by dual coordinate descent."""
    w, b = np.zeros(1 << BITS), 0.0
    values = [ratio[x] for x in rows]
    # rows of unit length, so that long texts don't outweigh short ones
    values = [v / max(1e-12, np.sqrt(v @ v)) for v in values]
    alpha = np.zeros(len(rows))
    sign = np.where(good, 1.0, -1.0)
    share = good.mean()
    limit = cost * np.where(good, 0.5 / share, 0.5 / (1 - share)) * 10
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), limit[i])  # |v|^2 + 1 for the intercept
            step = (new - alpha[i]) * sign[i]
            if step:
                moved = max(moved, abs(step))
                alpha[i] = new
                w[x] += step * v
                b += step
        if moved < 1e-3:
            break
    return w, b


def margin(x: np.ndarray, weights: np.ndarray, ratio: np.ndarray, b: float) -> float:
    if not len(x):
        return b
    v = ratio[x]
    return float(weights[x] @ v) / max(1e-12, float(np.sqrt(v @ v))) + b


def fit_sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(a, c) of 1 / (1 + exp(-(a m + c))) by Newton steps on smoothed targets (Platt, 1999)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        d, k = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(k * margins * margins).sum() + 1e-3, (k * margins).sum()], [(k * margins).sum(), k.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, c) if a > 0 else (1.0, 0.0)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> dict:
    """The model, from labelled rows that are not held out: at most max_rows of them, and of these (but for one) no more than hold max_places places."""
    use = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_y").isNotNull() & ~held_out("_id"))
    chosen = use.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)  # a bounded sample, so a bounded broadcast
    texts = F.broadcast(chosen).join(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id").select("_id", "_y", "_text", F.xxhash64("_id").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Hashes()
        for batch in batches:
            found = [places(t.as_py(), memory).astype(np.int32).tobytes() for t in batch.column(2)]
            sizes = pa.array([len(x) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary()), batch.column(3), sizes], names=["id", "y", "x", "h", "n"])

    rows = cut(in_batches(texts, run, "id string, y int, x binary, h long, n long"))
    total, last = 0, None
    for h, n in rows.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect():  # at most max_rows
        total += n
        if total > max_places and last is not None:
            break
        last = h
    got = sorted((r[0], r[1], bytes(r[2])) for r in rows.filter(F.col("h") <= last).select("id", "y", "x").collect()) if last is not None else []
    good = np.array([y > 0 for _, y, _ in got], bool)
    if not len(good) or good.all() or not good.any():
        p = float(good.mean()) if len(good) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return {"weights": np.zeros(1 << BITS, np.float32), "ratio": np.zeros(1 << BITS, np.float32), "b": float(np.log(p / (1 - p))), "a": 1.0, "c": 0.0}
    rows = [np.frombuffer(x, np.int32) for _, _, x in got]
    aside = np.array([xxhash.xxh32_intdigest(i, 3) % 5 == 0 for i, _, _ in got])
    if good[aside].all() or not good[aside].any() or good[~aside].all() or not good[~aside].any():
        aside[:] = False
    part = np.flatnonzero(~aside)
    ratio = log_count_ratio([rows[i] for i in part], good[part])
    w, b = fit_margin([rows[i] for i in part], good[part], ratio)
    test = np.flatnonzero(aside) if aside.any() else part
    a, c = fit_sigmoid(np.array([margin(rows[i], w, ratio, b) for i in test]), good[test])
    return {"weights": w.astype(np.float32), "ratio": ratio.astype(np.float32), "b": b, "a": a, "c": c}


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x 2^18 numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = shared.value, Hashes()
        w, ratio = m["weights"].astype(np.float64), m["ratio"].astype(np.float64)
        for batch in batches:
            margins = np.array([margin(places(t.as_py(), memory), w, ratio, m["b"]) for t in batch.column(len(keep))])
            got = 1 / (1 + np.exp(-np.clip(m["a"] * margins + m["c"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(got, pa.float64())], names=[*keep, "score"])

    head = [docs.schema[c] for c in keep]
    return in_batches(docs.select(*keep, text_col), run, "score double", head)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
