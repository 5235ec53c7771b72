"""The SLAM source: planned ranges, conditions in SQLite, columns left out, bad files, other file systems, and the sink."""

import pickle
import sqlite3
import struct

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from pathloom.sources import scans, slam

POSE = struct.pack("<12f", 1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6)


def database(path, rows, kind="INTEGER PRIMARY KEY"):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE Node (id {kind}, pose BLOB)")
        db.executemany("INSERT INTO Node VALUES (?, ?)", rows)
    db.close()


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    path = tmp_path_factory.mktemp("slam") / "large.db"
    database(path, ((k, POSE) for k in range(1, 1_000_001)))
    return str(path)


def test_one_large_file_is_read_by_several_tasks(spark, large):
    nodes = slam.read_nodes(spark, large)
    assert nodes.rdd.getNumPartitions() >= 3
    parts = nodes.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.min("node_id").alias("low"), F.max("node_id").alias("high")).orderBy("low").collect()
    assert len(parts) >= 3 and sum(p.n for p in parts) == 1_000_000 and all(a.high + 1 == b.low for a, b in zip(parts, parts[1:]))
    assert slam.read_nodes(spark, large, poses=False).agg(F.sum("node_id")).first()[0] == 500_000_500_000
    assert slam.read_nodes(spark, large, poses=False).columns == ["scan_id", "node_id"]


def test_conditions_reach_sqlite(spark, large, monkeypatch):
    statements, plain = [], slam.opened

    def traced(path):
        db = plain(path)
        db.set_trace_callback(statements.append)
        return db

    monkeypatch.setattr(slam, "opened", traced)
    reader = slam.NodeReader({"path": large})
    left = list(reader.pushFilters([ds.GreaterThan(("node_id",), 900_000), ds.IsNotNull(("pose",)), ds.IsNotNull(("scan_id",)), ds.StringContains(("scan_id",), "l")]))
    assert left == [ds.StringContains(("scan_id",), "l")]
    rows = [len(b) for part in reader.partitions() for b in reader.read(part)]
    assert sum(rows) == 100_000 and all("id > 900000 AND pose IS NOT NULL" in s for s in statements) and len(statements) > 2
    # the same from a query: Spark hands the condition over and tests it no more
    wanted = slam.read_nodes(spark, large).filter("node_id > 900000 AND node_id <= 900010 AND scan_id = 'large.db'")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "900000" not in plan.split("BatchScan")[0] and wanted.count() == 10
    assert slam.read_nodes(spark, large).filter("scan_id = 'other.db'").count() == 0


def test_folders_small_files_and_bad_ones(spark, tmp_path):
    for k in range(5):
        database(tmp_path / f"{k}.db", [(2, POSE), (1, None)])
    database(tmp_path / "plain.db", [(None, POSE), (3, b"x"), (3, POSE)], "INTEGER")
    (tmp_path / "not.txt").write_text("no database")
    nodes = slam.read_nodes(spark, str(tmp_path))
    assert nodes.count() == 13 and nodes.rdd.getNumPartitions() == 1
    assert sorted((r.scan_id, r.node_id) for r in nodes.filter("scan_id IN ('2.db', 'plain.db')").collect() if r.node_id) == [("2.db", 1), ("2.db", 2), ("plain.db", 3), ("plain.db", 3)]
    (tmp_path / "bad.db").write_bytes(b"no database at all" * 100)
    database(tmp_path / "other.db", [])
    with sqlite3.connect(tmp_path / "other.db") as db:
        db.execute("DROP TABLE Node")
    db.close()
    with pytest.raises(Exception, match="not a database|no such table"):
        slam.read_nodes(spark, str(tmp_path)).collect()
    found = slam.read_nodes(spark, str(tmp_path), errors=True)
    assert {r.scan_id for r in found.filter("error IS NOT NULL").collect()} == {"bad.db", "other.db"} and found.filter("error IS NULL").count() == 13
    whole = slam.nodes_in(spark.read.format("binaryFile").load(f"{tmp_path}/*.db"))
    assert whole.filter("NOT head").count() == 13 and {r.scan_id for r in whole.filter("head AND error IS NOT NULL").collect()} == {"bad.db", "other.db"} and whole.filter("head").count() == 8
    # a split in ranges loses no row without an id
    assert slam.read_nodes(spark, f"{tmp_path}/plain.db", split_bytes=2000).count() == 3


def test_sink_and_source(spark, tmp_path):
    rows = [(s, n, POSE if n % 3 else None) for s in ("a", "b", "c.db") for n in range(1, 40)]
    nodes = spark.createDataFrame(rows, "scan_id string, node_id long, pose binary").repartition(5)
    slam.write_nodes(nodes, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.db", "b.db", "c.db"]
    back = slam.read_nodes(spark, str(tmp_path / "out"))
    assert sorted((r.scan_id, r.node_id, r.pose and bytes(r.pose)) for r in back.collect()) == sorted((s if s.endswith(".db") else s + ".db", n, p) for s, n, p in rows)
    assert scans.trajectory(back).groupBy("scan_id").count().collect()[0]["count"] == 26
    files = slam.packed(nodes)
    assert slam.nodes_in(files).filter("NOT head").count() == len(rows) and slam.nodes_in(files).filter("head").count() == 3


def test_tasks_get_no_names_but_their_own():
    paths = [f"file:/shared/slam-{'0' * 32}/walk%20{k}.db" for k in range(20_000)] + ["file:/other/a.db", "x.db"]
    packed = slam.names_packed(paths)
    assert slam.names_unpacked(packed) == paths and len(packed) < 10 * len(paths)
    reader = slam.NodeReader({"paths": packed})
    assert reader.paths == paths and len(pickle.dumps(reader)) < 1000
