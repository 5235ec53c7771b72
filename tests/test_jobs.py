"""Jobs as a stream: files that arrive, states that move, one bad file, restarts and repeated batches."""

import os
import sqlite3
import struct

import pytest

from pyspark.sql import Row

from pathloom.plans import processing
from pathloom.streaming import jobs


def database(path, points):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE Node (id INTEGER PRIMARY KEY, pose BLOB)")
        db.executemany("INSERT INTO Node VALUES (?, ?)", [(k + 1, struct.pack("<12f", 1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z)) for k, (x, y, z) in enumerate(points)])
    db.close()


def walk(turn):
    return [(1 + 0.6 * k if k < turn else 1 + 0.6 * turn, 2.0 + max(0, 0.6 * (k - turn)), 1.0 + 0.01 * (k % 3)) for k in range(40)]


COMPLETE = [("PENDING", 0)] + [("PROCESSING", p) for _, p in processing.STAGES] + [("COMPLETED", 100)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("jobs")
    (at / "in").mkdir()

    def work():
        jobs.process_arrivals(jobs.arriving(spark, str(at / "in")), str(at / "out"), str(at / "c1")).awaitTermination()
        jobs.follow_jobs(spark, str(at / "out"), str(at / "c2")).awaitTermination()
        moves = {}
        for r in sorted(jobs.transitions(spark, str(at / "out")).collect()):
            moves.setdefault(r.scan_id, []).append((r.number, r.status, r.progress, r.message))
        return moves

    return at, work


def steps(moves):
    assert [m[0] for m in moves] == list(range(1, len(moves) + 1))
    return [m[1:3] for m in moves]


def test_files_move_through_their_states(spark, world):
    at, work = world
    for k in (10, 20):
        database(at / "in" / f"w{k}.db", walk(k))
    (at / "in" / "broken.db").write_bytes(b"not a database " * 50)
    database(at / "in" / "origin.db", [(0.0, 0.0, 0.0)] * 12)
    (at / "in" / "other.txt").write_text("no scan")
    moves = work()
    assert set(moves) == {"w10.db", "w20.db", "broken.db", "origin.db"}
    assert steps(moves["w10.db"]) == steps(moves["w20.db"]) == COMPLETE
    assert steps(moves["broken.db"]) == [("PENDING", 0), ("FAILED", 0)] and "database" in moves["broken.db"][-1][3]
    assert steps(moves["origin.db"]) == [("PENDING", 0), ("PROCESSING", 5), ("FAILED", 5)] and moves["origin.db"][-1][3] == jobs.NO_POSE


def test_a_restart_repeats_nothing_and_later_files_come_in(spark, world):
    at, work = world
    before = work()
    assert len(before) == 4
    database(at / "in" / "later.db", walk(15))
    after = work()
    assert {k: v for k, v in after.items() if k != "later.db"} == before and steps(after["later.db"]) == COMPLETE
    # a batch whose end was not recorded runs again: same events, same results, no transition
    commits = sorted((int(f), f) for f in os.listdir(at / "c1" / "commits") if f.isdigit())
    os.remove(at / "c1" / "commits" / commits[-1][1])
    crc = at / "c1" / "commits" / f".{commits[-1][1]}.crc"
    if crc.exists():
        os.remove(crc)
    assert work() == after
    assert processing.read_results(spark, str(at / "out" / "results")).count() == 3


def test_status_and_results(spark, world):
    at, work = world
    moves = jobs.transitions(spark, str(at / "out"))
    now = {r.scan_id: r for r in jobs.current_jobs(moves).collect()}
    assert (now["w10.db"].status, now["w10.db"].progress, now["w10.db"].error) == ("COMPLETED", 100, None)
    assert (now["broken.db"].status, now["broken.db"].session_status) == ("FAILED", "FAILED") and now["broken.db"].error
    asked = spark.createDataFrame([("w10.db",), ("broken.db",), ("nowhere.db",)], "scan_id string")
    got = {r.scan_id: r for r in jobs.job_result(asked, moves, processing.read_results(spark, str(at / "out" / "results"))).collect()}
    assert got["w10.db"].error is None and got["w10.db"].floors and got["w10.db"].total_distance > 10
    assert (got["broken.db"].error, got["nowhere.db"].error, got["broken.db"].floors) == ("JOB_NOT_COMPLETED", "JOB_NOT_FOUND", None)


def test_states_only_move_forward(spark, tmp_path):
    """Events out of order, repeated or after the end move nothing."""
    rows = [("a", "PENDING", 0, None, 0, 0), ("a", "PROCESSING", 40, None, 0, 2), ("a", "PROCESSING", 20, None, 0, 1), ("a", "PROCESSING", 20, None, 1, 0), ("a", "PENDING", 0, None, 1, 1), ("a", "FAILED", 40, "why", 1, 2), ("a", "COMPLETED", 100, None, 1, 3)]
    seen = []
    for part in (rows[:3], rows[3:5], rows[5:], rows):
        spark.createDataFrame(part, jobs.EVENTS).write.mode("append").partitionBy("batch", "step").parquet(f"{tmp_path}/events")
        jobs.follow_jobs(spark, str(tmp_path), f"{tmp_path}/c").awaitTermination()
        seen.append(sorted((r.number, r.status, r.progress) for r in jobs.transitions(spark, str(tmp_path)).collect()))
    assert seen[0] == [(1, "PENDING", 0), (2, "PROCESSING", 20), (3, "PROCESSING", 40)] == seen[1]
    assert seen[2] == seen[0] + [(4, "FAILED", 40)] == seen[3]


def test_results_of_other_scans_stay(spark, tmp_path):
    points = spark.createDataFrame([(s, k, *p) for s in (1, 2) for k, p in enumerate(walk(10 * s))], "scan_id long, seq long, x double, y double, z double")
    both, again = processing.process(points), processing.process(points.filter("scan_id = 2 AND seq < 30"))
    processing.write_results(both, str(tmp_path / "r"), 1)
    first = {r.scan_id: r.total_distance for r in processing.read_results(spark, str(tmp_path / "r")).collect()}
    processing.write_results(again, str(tmp_path / "r"), 2)
    processing.write_results(again, str(tmp_path / "r"), 2)
    now = {r.scan_id: r.total_distance for r in processing.read_results(spark, str(tmp_path / "r")).collect()}
    assert set(first) == set(now) == {1, 2} and now[1] == first[1] and now[2] < first[2]


def test_a_jobs_state_is_looked_up_once_and_its_events_come_in_order():
    class State:
        held, looks = None, 0

        def get(self):
            self.looks += 1
            return self.held

        def exists(self):
            self.looks += 1
            return self.held is not None

        def update(self, value):
            self.held = value

    state = jobs.JobState()
    state.job = State()
    events = [("COMPLETED", 100, None, 0, 4), ("PROCESSING", 5, None, 0, 1), ("PENDING", 0, None, 0, 0), ("PROCESSING", 5, None, 0, 2), ("FAILED", 0, "late", 1, 0)]
    rows = [Row(scan_id="a", status=s, progress=p, message=m, batch=b, step=k) for s, p, m, b, k in events]
    got = list(state.handleInputRows(("a",), iter(rows), None))
    assert [(r.number, r.status, r.progress) for r in got] == [(1, "PENDING", 0), (2, "PROCESSING", 5), (3, "COMPLETED", 100)]
    assert state.job.looks == 1 and list(state.handleInputRows(("a",), iter(rows), None)) == []
