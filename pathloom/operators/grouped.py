"""Operators whose next step depends on their last: one group (a scan, or a floor of one) at a time in numpy, Spark deals the groups.

Each takes and returns rows (*keys, seq, x, y, z), numbered anew.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import AXES, distance
from .cleaning import KEYS, here
from .keeping import kept

Group = tuple[tuple, list[np.ndarray]]
Answer = pa.Array | np.ndarray | list


#: Rows of small groups' answers that leave a task in one batch.
ROWS = 10_000


def in_groups(rows: DataFrame, keys: Sequence[str], order: str, run: Callable[[tuple, list[np.ndarray]], list[Answer] | None], schema: T.StructType | str, as_dealt: bool = False, keyed: bool = False) -> DataFrame:
    """run(key, its rows' other columns as arrays, in the order) for each group, one after another in each task. as_dealt: rows come from `dealt` by the keys,
    through steps that leave them where they are, and are not dealt again. keyed: run's answers, as numpy's arrays or lists, lack the keys, which
    are the schema's first columns; all become Arrow's for many groups together.

    Rows are dealt by key and sorted, and stream by: a task holds one group at a time, and a small group costs no more than its rows, as answers
    go on together, about ROWS rows at a time.
    """
    others = [c for c in rows.columns if c not in keys]
    n = len(keys)
    kinds = [pa_type(f.dataType) for f in schema] if keyed else []

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        ready, named, size = [], [], 0

        def answer() -> None:
            nonlocal size
            got = run(at, held[0] if len(held) == 1 else [np.concatenate([part[k] for part in held]) for k in range(len(others))])
            if got is not None:
                ready.append(got)
                named.append(at)
                size += len(got[0])

        def together() -> pa.RecordBatch:
            columns = [list(column) for column in zip(*ready)]
            if keyed:
                of = pa.array(np.repeat(np.arange(len(ready)), [len(got[0]) for got in ready]))
                columns = [pa.array([name[k] for name in named], kinds[k]).take(of) for k in range(n)] + [pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) else list(chain.from_iterable(c)), kind) for c, kind in zip(columns, kinds[n:])]
            else:
                columns = [pa.concat_arrays(c) for c in columns]
            return pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

        for batch in batches:
            if not batch.num_rows:
                continue
            # a key's number in the batch, nulls too
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in range(n)]
            starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()]
            names = list(zip(*(batch.column(k).take(pa.array(starts)).to_pylist() for k in range(n))))
            values = [batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(len(others))]
            for name, a, b in zip(names, starts, [*starts[1:], batch.num_rows]):
                if held and name != at:
                    answer()
                    held = []
                    if size >= ROWS:
                        yield together()
                        ready, named, size = [], [], 0
                at = name
                held.append([v[a:b] for v in values])
        if held:
            answer()
        if ready:
            yield together()

    rows = rows.select(*keys, *others)
    return (rows if as_dealt else dealt(rows, keys)).sortWithinPartitions(*keys, order).mapInArrow(stream, schema)


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows by key in partitions whose number Spark leaves alone: partitions that are small in bytes would be put together, however much work
    their groups are. One more than its shuffles have, as it takes an equal number for its own and puts those together."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts + 1, *keys)


def per_group(points: DataFrame, keys: Sequence[str], f: Callable[[np.ndarray], np.ndarray | list[int]], as_dealt: bool = False) -> DataFrame:
    """f gets a group's points in order and returns the new points, or the places of those kept."""
    rows = points.select(*keys, "seq", *AXES)
    schema = T.StructType([*(points.schema[k] for k in keys), T.StructField("seq", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in AXES)])

    def run(key: tuple, columns: list[np.ndarray]) -> list[Answer]:
        p = np.stack(columns[1:], axis=1).astype(float)
        got = f(p)
        out = p[got] if isinstance(got, list) else got
        return [np.arange(len(out)), out[:, 0], out[:, 1], out[:, 2]]

    return in_groups(rows, keys, "seq", run, schema, as_dealt, keyed=True)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def overlaps_merged_and_apart(p: np.ndarray, limit: float, radius: float) -> np.ndarray:
    """The points that overlaps_merged leaves, and of these kept_apart; the distances of a small group serve both."""
    if not 3 <= len(p) <= SMALL or limit <= 0 or not np.isfinite(p).all() or np.abs(p).max() / limit > 1e15:
        p = p[overlaps_merged(p, limit)]
        return p[kept_apart(p, radius)]
    d = distances(p)
    left = overlaps_merged_at_once(d, limit)
    near, taken, keep = as_bits(d <= radius), 0, []
    for i in left:
        if not near[i] & taken:
            keep.append(i)
            taken |= 1 << i
    return p[keep if len(keep) >= 2 else left]


def kept_apart(p: np.ndarray, radius: float) -> list[int]:
    """In order, a point that is still there removes all later ones within the radius; all stay if under two would.

    A point meets those kept in its own cell of a grid of the radius' width and in the 26 around it; cells hold few, as kept
    points are further apart than the radius. A point that is not finite meets nothing and stays.
    """
    keep = first_apart(p, radius)
    return keep if len(keep) >= 2 else list(range(len(p)))


#: Up to this many points, all distances of a group are computed at once.
SMALL = 256


def distances(p: np.ndarray) -> np.ndarray:
    """Between all points of a small group."""
    with np.errstate(all="ignore"):
        x, y, z = (p[:, k, None] - p[None, :, k] for k in range(3))
        return np.sqrt(x * x + y * y + z * z)


def as_bits(table: np.ndarray) -> list[int]:
    """Each row of a table of truths as one number, the first column in its lowest bit."""
    packed = np.packbits(table, axis=1, bitorder="little")
    width, data = packed.shape[1], packed.tobytes()
    return [int.from_bytes(data[k : k + width], "little") for k in range(0, len(data), width)]


def first_apart(p: np.ndarray, radius: float) -> list[int]:
    """The choice of D1 itself: the places of those that stay."""
    if len(p) <= SMALL:
        keep, taken = [], 0
        for i, near in enumerate(as_bits(distances(p) <= radius)):
            if not near & taken:
                keep.append(i)
                taken |= 1 << i
        return keep
    if radius <= 0 or not np.isfinite(p).all():
        cells = np.zeros((len(p), 3), np.int64)
    else:
        cells = np.floor(p / radius).astype(np.int64)
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)] if cells.any() else [(0, 0, 0)]
    grid: defaultdict[tuple[int, int, int], list[list[float]]] = defaultdict(list)
    keep, limit = [], radius
    rows = p.tolist()
    for i, (cell, (x, y, z)) in enumerate(zip(map(tuple, cells.tolist()), rows)):
        free = True
        for a, b, c in around:
            near = grid.get((cell[0] + a, cell[1] + b, cell[2] + c))
            if near and any(math.sqrt((q[0] - x) ** 2 + (q[1] - y) ** 2 + (q[2] - z) ** 2) <= limit for q in near):
                free = False
                break
        if free:
            keep.append(i)
            grid[cell].append(rows[i])
    return keep


class Trodden:
    """Places kept so far, by cells as wide as the limit: the first or the last of them within it of a point.

    Cells list their places in order, the point's own cell is looked at first, and no list is followed beyond what has been found.
    """

    AROUND = sorted(((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)), key=lambda o: sum(map(abs, o)))

    def __init__(self, p: np.ndarray, limit: float):
        self.rows, self.limit = p.tolist(), limit
        self.cells = list(map(tuple, np.floor(p / limit).astype(np.int64).tolist()))
        self.grid: defaultdict[tuple[int, int, int], tuple[list[int], list[list[float]]]] = defaultdict(lambda: ([], []))
        self.n = 0

    def add(self, i: int) -> None:
        ranks, rows = self.grid[self.cells[i]]
        ranks.append(self.n)
        rows.append(self.rows[i])
        self.n += 1

    def lists(self, i: int) -> Iterator[tuple[list[int], list[list[float]]]]:
        x, y, z = self.cells[i]
        for a, b, c in self.AROUND:
            found = self.grid.get((x + a, y + b, z + c))
            if found:
                yield found

    def first(self, i: int) -> int:
        """The rank of the first kept place, but for the last one, nearer than the limit; the number of places if there is none."""
        x, y, z = self.rows[i]
        best, limit = self.n - 1, self.limit
        for ranks, rows in self.lists(i):
            for rank, q in zip(ranks, rows):
                if rank >= best:
                    break
                if math.sqrt((q[0] - x) ** 2 + (q[1] - y) ** 2 + (q[2] - z) ** 2) < limit:
                    best = rank
                    break
        return best if best < self.n - 1 else self.n

    def last(self, i: int) -> int:
        """The rank of the last kept place within the limit; -1 if there is none."""
        x, y, z = self.rows[i]
        best, limit = -1, self.limit
        for ranks, rows in self.lists(i):
            for k in range(len(ranks) - 1, -1, -1):
                if ranks[k] <= best:
                    break
                q = rows[k]
                if math.sqrt((q[0] - x) ** 2 + (q[1] - y) ** 2 + (q[2] - z) ** 2) <= limit:
                    best = ranks[k]
                    break
        return best


class Least:
    """Numbers that only grow, all -1 at first: the first from some place on that is under a bound, in steps as many as their number has binary digits."""

    def __init__(self, n: int):
        self.size = 1 << max(n - 1, 1).bit_length()
        self.tree = [-1] * (self.size + n) + [1 << 62] * (self.size - n)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def put(self, i: int, value: int) -> None:
        tree, k = self.tree, i + self.size
        tree[k] = value
        while k > 1:
            k >>= 1
            less = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == less:
                break
            tree[k] = less

    def under(self, bound: int, start: int) -> int | None:
        tree, k = self.tree, start + self.size
        while tree[k] >= bound:  # up to a subtree to the right that has one
            while k & 1:
                k >>= 1
                if not k:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if tree[2 * k] < bound else 2 * k + 1
        return k - self.size


def overlaps_merged(p: np.ndarray, limit: float) -> list[int]:
    """D2 with D3 and D4: on coming back to an earlier place, skip ahead to where the walk leaves the known path.

    A point leaves the path known from rank k on if the last kept place within the limit has a lower rank. That rank only grows while
    places are kept, so what was once found of a point bounds it for good, and a point is looked at again only where that bound is
    below k. Points that are not finite are near nothing; a limit of 0 or less, or such points, take the plain way.
    """
    if len(p) < 3:
        return list(range(len(p)))
    if limit <= 0 or not np.isfinite(p).all() or np.abs(p).max() / limit > 1e15:
        return overlaps_merged_plainly(p, limit)
    if len(p) <= SMALL:
        return overlaps_merged_at_once(distances(p), limit)
    known, bounds = Trodden(p, limit), Least(len(p))
    keep, i = [0], 1
    known.add(0)
    while i < len(p):
        back = known.first(i) if len(keep) > 1 else len(keep)
        if back < len(keep) - 2:
            j = bounds.under(back, i)
            while j is not None:
                last = known.last(j)
                bounds.put(j, last)
                if last < back:
                    break
                j = bounds.under(back, j + 1) if j + 1 < len(p) else None
            if j is not None:
                i = j
                continue
        keep.append(i)
        known.add(i)
        i += 1
    return keep


def overlaps_merged_at_once(d: np.ndarray, limit: float) -> list[int]:
    """overlaps_merged of a small group by its distances: kept places, and those near each point, are bits of one number."""
    within, touching = as_bits(d < limit), as_bits(d <= limit)
    keep, taken, before, i = [0], 1, 0, 1
    while i < len(d):
        near = within[i] & before
        if near:
            back = (near & -near).bit_length() - 1
            later = taken >> back
            if later.bit_count() > 2:
                known = later << back
                ahead = next((j for j in range(i, len(d)) if not touching[j] & known), None)
                if ahead is not None:
                    i = ahead
                    continue
        keep.append(i)
        before, taken = taken, taken | 1 << i
        i += 1
    return keep


def overlaps_merged_plainly(p: np.ndarray, limit: float) -> list[int]:
    keep, i = [0], 1
    while i < len(p):
        near = np.flatnonzero(np.linalg.norm(p[keep[:-1]] - p[i], axis=1) < limit) if len(keep) > 1 else []
        if len(near) and near[0] < len(keep) - 2:
            known = p[keep[near[0] :]]
            ahead = next((j for j in range(i, len(p)) if np.linalg.norm(known - p[j], axis=1).min() > limit), None)
            if ahead is not None:
                i = ahead
                continue
        keep.append(i)
        i += 1
    return keep


def size(v: np.ndarray) -> float:
    """np.linalg.norm of one vector, bit by bit, without its checks."""
    return math.sqrt(v.dot(v))


def sizes(p: np.ndarray) -> np.ndarray:
    """np.linalg.norm of each row."""
    return np.sqrt(np.add.reduce(p * p, axis=1))


def off_line(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    line = b - a
    n = size(line)
    off = p - a
    if n < 1e-10:
        return sizes(off)
    line /= n
    return sizes(off - (off @ line)[:, None] * line)


def rdp(p: np.ndarray, epsilon: float) -> list[int]:
    """D5 with an explicit stack; a stretch whose ends coincide keeps only these."""
    if len(p) < 3:
        return list(range(len(p)))
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or size(p[b] - p[a]) < 1e-10:
            continue
        d = off_line(p[a + 1 : b], p[a], p[b])
        k = int(d.argmax())
        if d[k] > epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def fit_line(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """mean, direction, share of the variance along it (1 without variance)."""
    values, vectors = np.linalg.eigh(np.cov((p - p.mean(axis=0)).T))
    return p.mean(axis=0), vectors[:, -1], float(values[-1] / values.sum()) if values.sum() > 1e-10 else 1.0


def projected(p: np.ndarray, in_order: bool = True) -> np.ndarray:
    """F2 on F1's line, in the walk's order or in that along the line."""
    center, direction, _ = fit_line(p)
    along = (p - center) @ direction
    return center + np.outer(along if in_order else np.sort(along), direction)


def between(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return math.degrees(math.acos(max(-1.0, min(1.0, float(a @ b) / n)))) if min(np.linalg.norm(a), np.linalg.norm(b)) >= 1e-10 else 0.0


def straight_runs(p: np.ndarray, least: int = 10, turn: float = 45.0) -> list[tuple[int, int]]:
    """runs between turns over `turn`, of a span of at least `least`; the whole path if there is none."""
    n = len(p)
    if n < least:
        return [(0, n - 1)]
    corners = [0, *(i for i in range(1, n - 1) if between(p[i] - p[i - 1], p[i + 1] - p[i]) > turn), n - 1]
    return [(a, b) for a, b in zip(corners, corners[1:]) if b - a >= least] or [(0, n - 1)]


def straightened(p: np.ndarray, least: int = 10, turn: float = 45.0, limit: float = 2.0, deepest: int = 4, merge: float = 30.0) -> np.ndarray:
    """F4 with F5 and F6: project each run if no point moves over the limit, else halve it at its largest move; join collinear neighbours."""
    out = p.copy()
    if len(p) < least:
        return out
    bounds: list[tuple[int, int]] = []
    todo = [(a, b, 0) for a, b in reversed(straight_runs(p, least, turn))]
    while todo:
        a, b, depth = todo.pop()
        part = p[a : b + 1]
        few = max(3, least >> max(depth, 1))
        if len(part) < few:
            continue
        flat = projected(part)
        moved = np.linalg.norm(flat - part, axis=1)
        if moved.max() > limit and depth < deepest and len(part) >= 2 * few:
            cut = few + int(np.argmax(moved[few : len(part) - few])) if len(part) > 2 * few else len(part) // 2
            todo += [(a + cut, b, depth + 1), (a, a + cut, depth + 1)]
        else:
            out[a : b + 1] = flat
            bounds.append((a, b))
    bounds.sort()
    i = 0
    while i < len(bounds) - 1:
        (a, b), (c, d) = bounds[i], bounds[i + 1]
        if c - b <= 1 and between(out[b] - out[a], out[d] - out[c]) <= merge:
            part = out[a : d + 1].copy()
            flat = projected(part)
            if np.linalg.norm(flat - part, axis=1).max() <= limit:
                out[a : d + 1] = flat
                bounds[i : i + 2] = [(a, d)]
                continue
        i += 1
    return out


def straightened_flat(p: np.ndarray, **options: float) -> np.ndarray:
    """F8: F4 in the plane, heights as they were."""
    out = straightened(p * [1.0, 1.0, 0.0], **options)
    out[:, 2] = p[:, 2]
    return out


def interpolated(p: np.ndarray, spacing: float) -> np.ndarray:
    """each stretch in equal steps of at most `spacing`; stretches under 1e-10 are skipped."""
    if len(p) < 2:
        return p[:1]
    steps = p[1:] - p[:-1]
    far = [size(v) for v in steps]
    n = np.array([max(1, math.ceil(d / spacing)) if d >= 1e-10 else 0 for d in far])
    of = np.repeat(np.arange(len(n)), n)
    rank = np.arange(1, len(of) + 1) - (np.cumsum(n) - n)[of]
    return np.concatenate([p[:1], p[of] + (rank / n[of])[:, None] * steps[of]])


def pieces(p: np.ndarray, gap: float) -> list[np.ndarray]:
    cuts = (np.flatnonzero(sizes(p[1:] - p[:-1]) > gap) + 1).tolist() if len(p) > 1 else []
    return [p[a:b] for a, b in zip([0, *cuts], [*cuts, len(p)]) if b - a > 1] if cuts else [p]


def snapped(p: np.ndarray, epsilon: float = 0.5, spacing: float = 0.5, gap: float = 5.0) -> np.ndarray:
    """W2, D5 in each piece, F10, put together again; a walk of single points only becomes empty."""
    if len(p) < 3:
        return p.copy()
    parts = [interpolated(x[rdp(x, epsilon)], spacing) for x in pieces(p, gap)]
    return np.concatenate(parts) if parts else p[:0]


def blurred(p: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """W4 on one walk: ends mirrored half a sample out; fewer than three points stay."""
    if len(p) < 3:
        return p.copy()
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    at = np.arange(-radius, len(p) + radius) % (2 * len(p))
    wide = p[np.where(at < len(p), at, 2 * len(p) - 1 - at)]
    return np.stack([np.convolve(wide[:, c], weights / weights.sum(), mode="valid") for c in range(3)], axis=1)


def spline(p: np.ndarray, points: int | None = None) -> np.ndarray:
    """W7 without smoothing: a cubic through all points over chord length, not-a-knot at the ends.

    Under four points, or where two neighbours coincide, W4. The second derivatives solve a system of three diagonals.
    """
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if len(p) < 4 or not (step >= 1e-12).all():
        return blurred(p)
    u = np.concatenate(([0], np.cumsum(step))) / step.sum()
    h, n = np.diff(u), len(p)
    slope = np.diff(p, axis=0) / h[:, None]
    r = 6 * np.diff(slope, axis=0)
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # the ends' unknowns follow from their neighbours'
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        r[i] -= w * r[i - 1]
    m = np.zeros((n, 3))
    m[n - 2] = r[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (r[i] - up[i] * m[i + 2]) / mid[i]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-2] + h[-1]) * m[-2] - h[-1] * m[-3]) / h[-2]
    at = np.linspace(0, 1, points or n)
    k = np.clip(np.searchsorted(u, at, side="right") - 1, 0, n - 2)
    s, hk = (at - u[k])[:, None], h[k][:, None]
    return p[k] + s * (slope[k] - hk * (2 * m[k] + m[k + 1]) / 6) + s**2 * m[k] / 2 + s**3 * (m[k + 1] - m[k]) / (6 * hk)


#: Points of one scan that one task decides on at a time.
CHUNK = 100_000


def chunked(points: DataFrame, keys: Sequence[str], chunk: int) -> tuple[DataFrame, int]:
    """points with `_chunk`, the number of the stretch of `chunk` points of its group that each is in, and how many there are at most."""
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = kept(points.withColumn("_chunk", F.floor((F.row_number().over(order) - 1) / chunk).cast("int")))
    return rows, (rows.agg(F.max("_chunk")).first()[0] or 0) + 1


def chosen_apart(points: DataFrame, radius: float, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """The points (*keys, seq, x, y, z) that D1's choice keeps: in order, one stays unless an earlier one that stayed is within the radius.

    Round k decides on the k-th `chunk` points of each group. Points near one kept in an earlier round go, by a join over cells of the
    radius' width, in which kept points are few; among the rest of a chunk the choice is made in order, in one task. That is the choice over the whole
    group, as a point depends on those before it only. Points that are not finite stay and are near nothing in other chunks.
    """
    finite = F.forall(F.array(*AXES), lambda v: F.coalesce(F.abs(v) < F.lit(1e15 * radius), F.lit(False)))
    cells = [F.when(finite, F.floor(F.col(c) / radius)).alias(f"_c{c}") for c in AXES]
    rows, rounds = chunked(points.select(*keys, "seq", *AXES, *cells), keys, chunk)
    wide = ["seq", *AXES, *(f"_c{c}" for c in AXES)]
    chosen = None
    for k in range(rounds):
        now = rows.filter(F.col("_chunk") == k).select(*keys, *wide)
        if chosen is not None:
            near = now
            for c in AXES:
                near = near.withColumn(f"_c{c}", F.explode(F.sequence(F.col(f"_c{c}") - 1, F.col(f"_c{c}") + 1)))
            there = chosen.select(*keys, *(F.col(c).alias(f"_{c}") for c in AXES), *(f"_c{c}" for c in AXES))
            d = distance(here(), [F.col(f"_{c}") for c in AXES])
            gone = near.join(there, [*keys, *(f"_c{c}" for c in AXES)]).filter(d <= radius).select(*keys, "seq").distinct()
            now = now.join(gone, [*keys, "seq"], "left_anti")
        schema = T.StructType([*(now.schema[c] for c in keys), *(now.schema[c] for c in wide)])
        kinds = [pa_type(f.dataType) for f in schema]

        def run(key: tuple, columns: list[np.ndarray], kinds: list[pa.DataType] = kinds) -> list[pa.Array]:
            left = first_apart(np.stack(columns[1:4], axis=1).astype(float), radius)
            return [*(pa.array([v] * len(left), kind) for v, kind in zip(key, kinds)), *(pa.array(c[left], kind, from_pandas=kind != pa.float64()) for c, kind in zip(columns, kinds[len(keys) :]))]

        new = kept(in_groups(now.select(*keys, *wide), keys, "seq", run, schema))
        chosen = new if chosen is None else chosen.unionByName(new)
    return chosen.select(*keys, "seq", *AXES)


def deduplicate(points: DataFrame, radius: float = 0.3, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """D1 for scans of any size, by `chosen_apart`; a scan of which under two points would stay keeps all."""
    if radius <= 0:
        return per_group(points, keys, lambda p: kept_apart(p, radius))
    chosen = chosen_apart(points, radius, keys, chunk)
    few = chosen.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n < 2").select(*keys)
    result = chosen.join(few, list(keys), "left_anti").unionByName(points.select(*keys, "seq", *AXES).join(few, list(keys), "left_semi"))
    return result.withColumn("seq", (F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1).cast("long"))


def merge_overlaps(points: DataFrame, limit: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    return per_group(points, keys, lambda p: overlaps_merged(p, limit))


def simplify(points: DataFrame, epsilon: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    return per_group(points, keys, lambda p: rdp(p, epsilon))


def snap_to_lines(points: DataFrame, epsilon: float = 0.5, spacing: float = 0.5, gap: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    return per_group(points, keys, lambda p: snapped(p, epsilon, spacing, gap))


def straighten(points: DataFrame, keys: Sequence[str] = KEYS, **options: float) -> DataFrame:
    return per_group(points, keys, lambda p: straightened(p, **options))
