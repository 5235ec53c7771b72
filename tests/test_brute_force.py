"""Every step of the walks' process on the walks of sf0.001, against plain loops written for the purpose."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators import grouped, lines
from pathloom.plans import processing, queries
from pathloom.sources.scans import walks

SF = "/root/testdata/sf0.001"


def d3(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def bend(a, b, c):
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(b, c)]
    n, m = math.hypot(*u), math.hypot(*v)
    if n < 1e-10 or m < 1e-10:
        return 0.0
    return math.degrees(math.acos(max(-1, min(1, sum(x * y for x, y in zip(u, v)) / (n * m)))))


@pytest.fixture(scope="module")
def scans(spark):
    out = defaultdict(list)
    for r in walks(spark, SF).orderBy("scan_id", "seq").collect():
        out[r.scan_id].append((r.x, r.y, r.z))
    return dict(out)


def rows(df, key="scan_id", order="seq"):
    out = defaultdict(list)
    for r in df.orderBy(*([key] if isinstance(key, str) else key), order).collect():
        out[r[key] if isinstance(key, str) else tuple(r[k] for k in key)].append((r.x, r.y, r.z))
    return dict(out)


def same(got, expected):
    assert set(got) == {k for k, v in expected.items() if len(v)}
    for k, v in got.items():
        assert np.allclose(v, expected[k], atol=2e-6), k


# --- cleaning and lines -----------------------------------------------------------------------------------------------


def naive_apart(p, radius):
    dead = set()
    for i in range(len(p)):
        if i not in dead:
            dead |= {j for j in range(i + 1, len(p)) if d3(p[i], p[j]) <= radius}
    left = [x for i, x in enumerate(p) if i not in dead]
    return left if len(left) >= 2 else list(p)


def naive_overlaps(p, limit):
    if len(p) < 3:
        return list(p)
    kept, i = [p[0]], 1
    while i < len(p):
        back = next((k for k in range(len(kept) - 1) if d3(kept[k], p[i]) < limit), None)
        leave = None
        if back is not None and back < len(kept) - 2:
            leave = next((j for j in range(i, len(p)) if all(d3(q, p[j]) > limit for q in kept[back:])), None)
        if leave is None:
            kept.append(p[i])
            i += 1
        else:
            i = leave
    return kept


def off(p, a, b):
    n = d3(a, b)
    u = [(y - x) / n for x, y in zip(a, b)]
    t = sum((x - y) * z for x, y, z in zip(p, a, u))
    return d3(p, [x + t * y for x, y in zip(a, u)])


def naive_simplified(p, epsilon):
    if len(p) < 3 or d3(p[0], p[-1]) < 1e-10:
        return [p[0], p[-1]] if len(p) > 1 else list(p)
    far = [off(q, p[0], p[-1]) for q in p[1:-1]]
    k = max(range(len(far)), key=lambda i: (far[i], -i))
    if far[k] <= epsilon:
        return [p[0], p[-1]]
    return naive_simplified(p[: k + 2], epsilon)[:-1] + naive_simplified(p[k + 1 :], epsilon)


def naive_pieces(p, gap):
    out = [[p[0]]]
    for a, b in zip(p, p[1:]):
        if d3(a, b) > gap:
            out.append([])
        out[-1].append(b)
    return [x for x in out if len(x) > 1] if len(out) > 1 else out


def naive_filled(p, spacing):
    out = [p[0]]
    for a, b in zip(p, p[1:]):
        if d3(a, b) >= 1e-10:
            n = max(1, math.ceil(d3(a, b) / spacing))
            out += [tuple(x + j / n * (y - x) for x, y in zip(a, b)) for j in range(1, n + 1)]
    return out


def naive_snapped(p):
    if len(p) < 3:
        return list(p)
    return [x for piece in naive_pieces(p, 5.0) for x in naive_filled(naive_simplified(piece, 0.5), 0.5)]


def svd_line(p):
    p = np.array(p)
    _, s, v = np.linalg.svd(p - p.mean(axis=0), full_matrices=False)
    return p.mean(axis=0), v[0], s[0] ** 2 / (s**2).sum() if (s**2).sum() > 1e-10 else 1.0


def svd_projected(p):
    c, u, _ = svd_line(p)
    return np.array([c + np.dot(np.array(q) - c, u) * u for q in p])


def test_cleaning_and_lines(spark, scans):
    source = walks(spark, SF)
    run = lambda name: rows(queries.QUERIES[name](spark, SF))
    same(rows(grouped.deduplicate(source, 0.5)), {k: naive_apart(p, 0.5) for k, p in scans.items()})
    same(run("d2_d3_d4_merge_overlaps"), {k: naive_overlaps(p, 1.0) for k, p in scans.items()})
    same(run("d5_simplify"), {k: naive_simplified(p, 0.5) for k, p in scans.items()})
    same(run("f9_f10_snap_to_lines"), {k: naive_snapped(p) for k, p in scans.items()})
    same(run("f1_f2_project"), {k: svd_projected(p) for k, p in scans.items()})
    chunks = {}
    for k, p in scans.items():
        chunks[k] = [q for a in range(0, len(p), 20) for q in (svd_projected(p[a : a + 20]) if len(p[a : a + 20]) >= 3 and svd_line(p[a : a + 20])[2] >= 0.85 else p[a : a + 20])]
    same(run("f7_straighten_chunks"), chunks)
    fits = {r.scan_id: r for r in queries.QUERIES["t5_t6_line_fit"](spark, SF).collect()}
    lists = {r.scan_id: r.distances for r in lines.line_fit(source, distances=True).collect()}
    for k, p in scans.items():
        moved = np.linalg.norm(svd_projected(p) - np.array(p), axis=1)
        assert (fits[k].explained, fits[k].mean_deviation, fits[k].max_deviation, fits[k].std_deviation) == pytest.approx((svd_line(p)[2], moved.mean(), moved.max(), moved.std()), abs=2e-6)
        assert lists[k] == pytest.approx(moved.tolist(), abs=1e-6)


def naive_straight(p, least=10, turn=45.0, limit=2.0, deepest=4, merge=30.0):
    p = [np.array(q, float) for q in p]
    out = [q.copy() for q in p]
    if len(p) < least:
        return out
    corners = [0] + [i for i in range(1, len(p) - 1) if bend(p[i - 1], p[i], p[i + 1]) > turn] + [len(p) - 1]
    runs = [(a, b) for a, b in zip(corners, corners[1:]) if b - a >= least] or [(0, len(p) - 1)]
    done = []

    def project(a, b, depth):
        n = b - a + 1
        few = max(3, least // 2 ** max(depth, 1))
        if n < few:
            return
        flat = svd_projected(p[a : b + 1])
        moved = [d3(x, y) for x, y in zip(flat, p[a : b + 1])]
        if max(moved) > limit and depth < deepest and n >= 2 * few:
            inner = moved[few : n - few]
            cut = few + inner.index(max(inner)) if n > 2 * few else n // 2
            project(a, a + cut, depth + 1)
            project(a + cut, b, depth + 1)
        else:
            for i, q in zip(range(a, b + 1), flat):
                out[i] = q
            done.append((a, b))

    # a point that two runs share takes the later one's place
    for a, b in runs:
        project(a, b, 0)
    done.sort()
    i = 0
    while i + 1 < len(done):
        (a, b), (c, e) = done[i], done[i + 1]
        u, v = out[b] - out[a], out[e] - out[c]
        if c - b <= 1 and bend((0, 0, 0), u, u + v) <= merge:
            part = np.array(out[a : e + 1])
            flat = svd_projected(part)
            if np.linalg.norm(flat - part, axis=1).max() <= limit:
                for k, q in zip(range(a, e + 1), flat):
                    out[k] = q
                done[i : i + 2] = [(a, e)]
                continue
        i += 1
    return out


def test_straightening(spark, scans):
    same(rows(queries.QUERIES["f3_f4_f5_f6_straighten"](spark, SF)), {k: naive_straight(p) for k, p in scans.items()})
    flat = {k: [(*q[:2], r[2]) for q, r in zip(naive_straight([(x, y, 0.0) for x, y, _ in p]), p)] for k, p in scans.items()}
    same(rows(queries.QUERIES["f8_straighten_xy"](spark, SF)), flat)
    line = np.array([[0, 0, 0], [2, 0, 0], [1, 0, 0.0]])
    assert grouped.projected(line)[:, 0].tolist() == pytest.approx([0, 2, 1])
    assert sorted(grouped.projected(line, in_order=False)[:, 0].tolist()) == pytest.approx([0, 1, 2])


def naive_blurred(p, sigma=2.0):
    if len(p) < 3:
        return [tuple(q) for q in p]
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]

    def mirror(i):
        while not 0 <= i < len(p):
            i = -i - 1 if i < 0 else 2 * len(p) - 1 - i
        return i

    return [tuple(sum(p[mirror(i + k)][c] * w[k + r] for k in range(-r, r + 1)) / sum(w) for c in range(3)) for i in range(len(p))]


def naive_spline(p):
    p = np.array(p)
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if len(p) < 4 or (step < 1e-12).any():
        return naive_blurred(p.tolist())
    u = np.concatenate(([0], np.cumsum(step))) / step.sum()
    n, h = len(p), np.diff(u)
    # four coefficients a stretch: values, slopes and bends agree at the knots, the third derivative at the second and last but one
    a, b = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros((4 * (n - 1), 3))
    r = 0
    for i in range(n - 1):
        a[r, 4 * i], b[r] = 1, p[i]
        a[r + 1, 4 * i : 4 * i + 4], b[r + 1] = [1, h[i], h[i] ** 2, h[i] ** 3], p[i + 1]
        r += 2
    for i in range(n - 2):
        a[r, 4 * i + 1 : 4 * i + 4], a[r, 4 * i + 5] = [1, 2 * h[i], 3 * h[i] ** 2], -1
        a[r + 1, 4 * i + 2 : 4 * i + 4], a[r + 1, 4 * i + 6] = [2, 6 * h[i]], -2
        r += 2
    for i in (0, n - 3):
        a[r, 4 * i + 3], a[r, 4 * i + 7] = 1, -1
        r += 1
    c = np.linalg.solve(a, b)
    out = []
    for t in np.linspace(0, 1, n):
        i = min(int(np.searchsorted(u, t, side="right")) - 1, n - 2)
        s = t - u[i]
        out.append(c[4 * i] + s * c[4 * i + 1] + s * s * c[4 * i + 2] + s**3 * c[4 * i + 3])
    return out


def test_spline(spark, scans):
    got = rows(queries.QUERIES["w7_spline"](spark, SF))
    for k, p in scans.items():
        assert np.allclose(got[k], naive_spline(p), atol=1e-4)
    for p in ([(0, 0, 0), (1, 2, 0), (2, 0, 1)], [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 1, 0)], [(0, 0, 0)]):
        assert np.allclose(grouped.spline(np.array(p, float)), naive_blurred(p))
    assert len(grouped.spline(np.cumsum(np.random.default_rng(1).random((100_000, 3)), axis=0))) == 100_000


# --- floors, passages, graphs -----------------------------------------------------------------------------------------


def naive_runs(p):
    marked = [False] * len(p)
    for i in range(len(p) - 10):
        rise = p[i + 10][2] - p[i][2]
        steps = [p[j + 1][2] - p[j][2] for j in range(i, i + 10)]
        if abs(rise) > 0.75 and sum((s > 0.025) if rise > 0 else (s < -0.025) for s in steps) > 5:
            marked[i : i + 11] = [True] * 11
    runs, i = [], 0
    while i < len(p):
        j = i
        while j < len(p) and marked[j]:
            j += 1
        if j > i and abs(p[j - 1][2] - p[i][2]) >= 1.5 and j - i >= 5:
            runs.append((i, j))
        i = max(j, i + 1)
    return runs


def naive_levels(z, height=3.0):
    lo, hi = min(z), max(z)
    if hi - lo < height:
        return [0] * len(z)
    n = max(int((hi - lo) / 0.5), 20)
    edges = np.linspace(lo, hi, n + 1)
    counts = [sum(edges[i] <= v < edges[i + 1] or (i == n - 1 and v == hi) for v in z) for i in range(n)]
    w = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]

    def mirror(i):
        while not 0 <= i < n:
            i = -i - 1 if i < 0 else 2 * n - 1 - i
        return i

    smooth = [sum(counts[mirror(i + k)] * w[k + 6] for k in range(-6, 7)) / sum(w) for i in range(n)]
    peaks, region = [], []
    for i in [i for i in range(n) if smooth[i] >= 0.03 * len(z)] + [10**9]:
        if region and i - region[-1] > 2:
            at = sum((edges[k] + edges[k + 1]) / 2 * smooth[k] for k in region) / sum(smooth[k] for k in region)
            if all(abs(at - q) >= 0.7 * height for q in peaks):
                peaks.append(at)
            region = []
        region.append(i)
    if not peaks:
        n = max(1, int((hi - lo) / height) + 1)
        peaks = [lo + (i + 0.5) * (hi - lo) / n for i in range(n)]
    peaks.sort()
    return [min(range(len(peaks)), key=lambda k: (abs(v - peaks[k]), k)) for v in z]


def naive_process(p):
    """(floors: {level: points}, passages) of one walk, then its paths, nodes and edges."""
    runs = naive_runs(p)
    on = {i for a, b in runs for i in range(a, b)}
    merged = []
    for a, b in runs:
        up = p[b - 1][2] > p[a][2]
        if merged and (p[merged[-1][1] - 1][2] > p[merged[-1][0]][2]) == up and a - merged[-1][1] < 10:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    left = [i for i in range(len(p)) if i not in on]
    by_level = defaultdict(list)
    for i, lv in zip(left, naive_levels([p[i][2] for i in left]) if left else []):
        by_level[lv].append(i)
    groups = sorted((g for g in by_level.values() if len(g) >= 10), key=lambda g: sum(p[i][2] for i in g) / len(g))
    floors = {k: [p[i] for i in g] for k, g in enumerate(groups, 1)}
    mean = {k: sum(q[2] for q in g) / len(g) for k, g in floors.items()}
    near = lambda z: min(mean, key=lambda k: (abs(mean[k] - z), k)) if mean else 0
    passages = [(a, b, near(p[a][2]), near(p[b - 1][2]), abs(p[b - 1][2] - p[a][2]), sum(math.dist(p[i][:2], p[i + 1][:2]) for i in range(a, b - 1))) for a, b in merged]
    return floors, passages


def naive_outliers(p):
    if len(p) < 5:
        return list(p)
    steps = [d3(a, b) for a, b in zip(p, p[1:])]
    mean = sum(steps) / len(steps)
    limit = mean + 3 * math.sqrt(sum((s - mean) ** 2 for s in steps) / len(steps))
    return [tuple((a + b) / 2 for a, b in zip(p[i - 1], p[i + 1])) if 0 < i < len(p) - 1 and (steps[i - 1] > limit or steps[i] > limit) else p[i] for i in range(len(p))]


def naive_nodes(p):
    if len(p) < 2:
        return []
    turns = {i: bend(p[i - 1], p[i], p[i + 1]) for i in range(3, len(p) - 3)} if len(p) >= 5 else {}
    todo = [i for i, t in turns.items() if t >= 45]
    seeds = {}
    while todo:
        group = [j for j in todo if j == todo[0] or d3(p[j], p[todo[0]]) < 1.5]
        seeds[todo[0]] = (max(turns[j] for j in group), len(group))
        todo = [j for j in todo if j not in group]
    out, last = [], 0
    for i in range(len(p)):
        kind = "ENDPOINT" if i in (0, len(p) - 1) else "JUNCTION" if i in seeds else "WAYPOINT" if d3(p[i], p[last]) >= 1.0 else None
        if kind:
            out.append((i, kind, *(seeds[i] if kind == "JUNCTION" else (None, None))))
            last = i
    return out


@pytest.fixture(scope="module")
def done(spark):
    return processing.process(walks(spark, SF), derive_endpoints=True)


@pytest.fixture(scope="module")
def naive(scans):
    out = {}
    for k, p in scans.items():
        floors, passages = naive_process(p)
        paths = {lv: naive_snapped(naive_apart(naive_overlaps(naive_outliers(g), 1.0), 0.5)) for lv, g in floors.items()}
        nodes = {lv: naive_nodes(q) for lv, q in paths.items()}
        edges = []
        for lv, q in paths.items():
            for (i, *_), (j, *_) in zip(nodes[lv], nodes[lv][1:]):
                way = sum(d3(q[m], q[m + 1]) for m in range(i, j))
                if way <= 3.0:
                    edges.append(((lv, i), (lv, j), way, "HORIZONTAL"))
        for a, b, start, end, rise, way in passages:
            ends = [min(((d3(paths[lv][n[0]], p[i]), n[0]) for n in nodes[lv]), default=None) if lv in nodes else None for lv, i in ((start, a), (end, b - 1))]
            if all(ends):
                edges.append(((start, ends[0][1]), (end, ends[1][1]), rise, "VERTICAL_ELEVATOR" if rise and way / rise < 1 else "VERTICAL_STAIRCASE"))
        out[k] = (floors, passages, paths, nodes, edges)
    return out


def test_floors_and_passages(done, naive):
    got = rows(done.leveled, ("scan_id", "floor_level"))
    same(got, {(k, lv): g for k, n in naive.items() for lv, g in n[0].items()})
    found = sorted((r.scan_id, r.start_idx, r.end_idx, r.from_floor, r.to_floor, round(r.z_displacement, 6)) for r in done.passages.collect())
    assert found == sorted((k, a, b, s, e, round(rise, 6)) for k, n in naive.items() for a, b, s, e, rise, _ in n[1]) and found


def test_passage_stats_and_jobs(spark, naive):
    got = {r.scan_id: r for r in queries.QUERIES["v9_passage_stats"](spark, SF).collect()}
    assert set(got) == {k for k, n in naive.items() if n[1]}
    for k, r in got.items():
        p = naive[k][1]
        assert (r.total_passages, r.connected_floors) == (len(p), sorted({x for q in p for x in q[2:4]})) and r.total_z_displacement == pytest.approx(sum(q[4] for q in p), abs=1e-5)
    jobs = {r.scan_id: (r.status, r.progress) for r in queries.QUERIES["job_status"](spark, SF).collect()}
    assert jobs == {k: ("COMPLETED", 100) for k, n in naive.items() if any(n[2].values())} | {k: ("FAILED", 40 if n[0] else 20 if n[1] else 5) for k, n in naive.items() if not any(n[2].values())}


def test_paths_nodes_and_edges(done, naive):
    same(rows(done.paths, ("scan_id", "floor_level")), {(k, lv): q for k, n in naive.items() for lv, q in n[2].items()})
    nodes = {(r.scan_id, r.floor_level, r.original_index): r for r in done.nodes.collect()}
    expected = {(k, lv, i): (kind, angle, count) for k, n in naive.items() for lv, found in n[3].items() for i, kind, angle, count in found}
    assert set(nodes) == set(expected)
    for at, (kind, angle, count) in expected.items():
        r = nodes[at]
        assert (r.type, r.merged_count) == (kind, count) and (r.angle_change == pytest.approx(angle, abs=1e-5) if angle is not None else r.angle_change is None)
    name = {r.node_id: (r.scan_id, (r.floor_level, r.original_index)) for r in nodes.values()}
    got = sorted((name[r.from_node], name[r.to_node], round(r.distance, 5), r.edge_type) for r in done.edges.collect())
    assert got == sorted(((k, a), (k, b), round(d, 5), t) for k, n in naive.items() for a, b, d, t in n[4]) and any(t.startswith("V") for *_, t in got)


def test_graph_stats_dead_ends_results(spark, done, naive):
    from pathloom.operators import graph

    stats = {r.scan_id: r for r in graph.graph_stats(done.nodes, done.edges).collect()}
    ends = defaultdict(set)
    name = {r.node_id: (r.floor_level, r.original_index) for r in done.nodes.collect()}
    for r in graph.dead_ends(done.edges).collect():
        ends[r.scan_id].add(name[r.node_id])
    results = {r.scan_id: r for r in processing.results(done).collect()}
    for k, (_, passages, paths, nodes, edges) in naive.items():
        every = [x for found in nodes.values() for x in found]
        if not every:
            continue
        s = stats[k]
        assert (s.total_nodes, s.junction_count, s.endpoint_count, s.waypoint_count, s.total_edges) == (len(every), *(sum(x[1] == t for x in every) for t in ("JUNCTION", "ENDPOINT", "WAYPOINT")), len(edges))
        assert s.total_distance == pytest.approx(sum(e[2] for e in edges), abs=1e-5)
        degree = defaultdict(int)
        for a, b, *_ in edges:
            degree[a] += 1
            degree[b] += 1
        assert ends[k] == {n for n, d in degree.items() if d == 1}
        r = results[k]
        assert [(f.floor_level, f.point_count, len(f.segments)) for f in r.floors] == [(lv, len(q), len(q) - 1) for lv, q in sorted(paths.items()) if q]
        assert r.total_distance == pytest.approx(sum(d3(a, b) for q in paths.values() for a, b in zip(q, q[1:])), abs=1e-4) and len(r.passages or []) == len(passages)
        assert r.floors[0].floor_name == "1층"
    levels = spark.createDataFrame([(i,) for i in (-2, 0, 1, 3)], "level int").select(geo.floor_name(F.col("level")).alias("n")).collect()
    assert [r.n for r in levels] == ["B2", "1층", "1층", "3층"]


def test_routes_and_snapping(spark, scans, naive):
    factor = {("ELEVATOR_FIRST", "VERTICAL_ELEVATOR"): 0.5, ("ELEVATOR_FIRST", "VERTICAL_STAIRCASE"): 2.0, ("STAIRCASE_FIRST", "VERTICAL_ELEVATOR"): 2.0, ("STAIRCASE_FIRST", "VERTICAL_STAIRCASE"): 0.8}
    got = {(r.scan_id, r.request_id): r for r in queries.QUERIES["g12_routes"](spark, SF).collect()}
    solved = 0
    for k, (_, _, paths, nodes, edges) in naive.items():
        last = max(((lv, n[0]) for lv, found in nodes.items() for n in found), default=None)
        for number, wish in enumerate(sorted(("SHORTEST", "ELEVATOR_FIRST", "STAIRCASE_FIRST")), 1):
            r = got[k, number]
            if 1 not in nodes or not nodes[1]:
                assert r.error == "GRAPH_NOT_BUILT"
                continue
            start = min(((math.dist(paths[1][n[0]][:2], scans[k][0][:2]), n[0]) for n in nodes[1]))[1]
            cost = {(1, start): 0.0}
            for _ in range(len(edges) + 1):  # Bellman and Ford's way
                for a, b, d, t in edges:
                    w = d * factor.get((wish, t), 1.0)
                    for x, y in ((a, b), (b, a)):
                        if x in cost and cost[x] + w < cost.get(y, math.inf) - 1e-12:
                            cost[y] = cost[x] + w
            if last in cost:
                assert r.cost == pytest.approx(cost[last], abs=1e-5) and r.error is None
                solved += 1
            else:
                assert r.error == "NO_PATH_AVAILABLE"
    assert solved
    snapped = defaultdict(dict)
    for r in queries.QUERIES["r13_snap_poi"](spark, SF).collect():
        snapped[r.scan_id][r.seq] = r.distance
    for k, (_, _, paths, nodes, _) in naive.items():
        if nodes.get(1):
            assert [snapped[k][i] for i in range(len(scans[k]))] == pytest.approx([min(d3(paths[1][n[0]], q) for n in nodes[1]) for q in scans[k]], abs=1e-5)


def test_streamed_statistics(spark, tmp_path):
    from pathloom.streaming.ingest import ingest_stats

    source = tmp_path / "in"
    walks(spark, SF).filter("scan_id % 2 = 0").write.parquet(str(source))
    take = lambda: ingest_stats(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    take()
    walks(spark, SF).filter("scan_id % 2 = 1").write.mode("append").parquet(str(source))
    take()
    got = {r.scan_id: r.total_nodes for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.scan_id: r["count"] for r in walks(spark, SF).groupBy("scan_id").count().collect()}
