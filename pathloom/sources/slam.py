"""SLAM databases (SQLite files with a table Node of id and pose) as a Spark source and sink.

`slam_nodes` reads files that tasks can open by path (a disk or a shared mount). A large file is cut into ranges of ids, each read by
a task of its own; small files share a task. Conditions on node_id, scan_id and null poses go into SQLite's statement or leave
files and ranges out (Spark hands them over once `register` has allowed it); without
poses asked for, none is read. Files elsewhere come through Spark's own file readers, whole, one a row (`nodes_in`).

Defined cases: a null id counts as a row of the first range; a table without rows, a file of no bytes (which Spark's listing passes over) or an empty folder gives no nodes; a file that is no such
database stops the query, or with `errors` gives one row that says why, while the others are read.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import sqlite3
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import datasource as ds

#: A file is cut into ranges of about this size; smaller files share a task up to it.
SPLIT_BYTES = 16 << 20
ROWS = 10_000
OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def names_packed(paths: Sequence[str]) -> str:
    """Paths in order as a short text. Spark hands a source's options to every Python worker, where many files' whole paths would fill the memory."""
    folders: dict[str, int] = {}
    found = [(folders.setdefault(folder, len(folders)), name) for folder, name in map(os.path.split, paths)]
    return base64.b64encode(zlib.compress(json.dumps([list(folders), found]).encode())).decode()


def names_unpacked(text: str) -> list[str]:
    folders, found = json.loads(zlib.decompress(base64.b64decode(text)))
    return [os.path.join(folders[k], name) for k, name in found]


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def batches(db: sqlite3.Connection, scan: str, where: Sequence[str], values: Sequence[object], poses: bool) -> Iterator[pa.RecordBatch]:
    """The nodes of an open database in order of their ids, ROWS at a time."""
    rows = db.execute(f"SELECT id, {'pose' if poses else 'NULL'} FROM Node{' WHERE ' + ' AND '.join(where) if where else ''} ORDER BY id", values)
    while some := rows.fetchmany(ROWS):
        found = [pa.repeat(pa.scalar(scan), len(some)), pa.array([r[0] for r in some], pa.int64())]
        if poses:
            found.append(pa.array([None if r[1] is None else bytes(r[1]) for r in some], pa.binary()))
        yield pa.RecordBatch.from_arrays(found, names=["scan_id", "node_id", "pose"][: len(found)])


class Stretches(ds.InputPartition):
    """What one task reads: (path, first id, last id) of each stretch; ids of None have no bound."""

    def __init__(self, parts: list[tuple[str, int | None, int | None]]):
        super().__init__(parts)
        self.parts = parts


class NodeReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.paths = names_unpacked(options["paths"]) if "paths" in options else [p for p in options["path"].split(",") if p]
        self.split, self.poses, self.errors = int(options.get("split_bytes", SPLIT_BYTES)), options.get("poses", "true") == "true", options.get("errors", "false") == "true"
        self.where: list[str] = []
        self.values: list[object] = []
        self.scans: set[str] | None = None

    def __getstate__(self) -> dict:
        """Only planning needs the names of all files; a task's reader, which each worker holds, brings those of its own stretches only."""
        return {**self.__dict__, "paths": []}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            column, kind = getattr(f, "attribute", None), type(f)
            if column == ("node_id",) and kind in OPERATORS and isinstance(f.value, int):
                self.where.append(f"id {OPERATORS[kind]} ?")
                self.values.append(f.value)
            elif column == ("node_id",) and kind is ds.In and all(isinstance(v, int) for v in f.value):
                self.where.append(f"id IN ({','.join('?' * len(f.value))})")
                self.values += f.value
            elif column in (("node_id",), ("pose",)) and kind is ds.IsNotNull:
                self.where.append(f"{'id' if column == ('node_id',) else 'pose'} IS NOT NULL")
            elif column == ("scan_id",) and kind in (ds.EqualTo, ds.In):
                named = set(f.value) if kind is ds.In else {f.value}
                self.scans = named if self.scans is None else self.scans & named
            elif not (column == ("scan_id",) and kind is ds.IsNotNull):
                yield f

    def files(self) -> Iterator[str]:
        for p in self.paths:
            p = unquote(p.removeprefix("file://").removeprefix("file:")) if p.startswith("file:") else p
            for f in sorted(glob.glob(os.path.join(p, "*.db")) if os.path.isdir(p) else glob.glob(p)) or [p] * (not os.path.isdir(p)):
                if self.scans is None or os.path.basename(f) in self.scans:
                    yield f

    def ranges(self, path: str, size: int) -> list[tuple[str, int | None, int | None]]:
        """A file's stretches: even ranges between the least and the greatest id that the conditions leave."""
        pieces = -(-size // self.split)
        if pieces < 2:
            return [(path, None, None)]
        try:
            with opened(path) as db:
                low, high = db.execute(f"SELECT min(id), max(id) FROM Node{' WHERE ' + ' AND '.join(self.where) if self.where else ''}", self.values).fetchone()
        except sqlite3.Error:
            return [(path, None, None)]  # its task says what is wrong
        if low is None:
            return [(path, None, None)]
        pieces = min(pieces, high - low + 1)
        edges = [low + (high - low + 1) * k // pieces for k in range(pieces + 1)]
        return [(path, None if k == 0 else edges[k], edges[k + 1] - 1) for k in range(pieces)]

    def partitions(self) -> list[Stretches]:
        out: list[list] = []
        room = 0
        for path in self.files():
            size = os.path.getsize(path) if os.path.exists(path) else 0
            parts = self.ranges(path, size)
            if len(parts) > 1:
                out += [[p] for p in parts]
                room = 0
            elif size <= room:
                out[-1] += parts
                room -= size
            else:
                out.append(parts)
                room = self.split - size
        return [Stretches(p) for p in out] or [Stretches([])]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for path, low, high in partition.parts:
            scan, where, values = os.path.basename(path), list(self.where), list(self.values)
            for bound, text in ((low, "id >= ?"), (high, "id <= ?")):
                if bound is not None:
                    where.append(f"(id IS NULL OR {text})" if low is None else text)
                    values.append(bound)
            try:
                with opened(path) as db:
                    for batch in batches(db, scan, where, values, self.poses):
                        yield batch.append_column("error", pa.nulls(len(batch), pa.string())) if self.errors else batch
            except sqlite3.Error as wrong:
                if not self.errors:
                    raise
                yield pa.RecordBatch.from_arrays([pa.array([scan]), pa.nulls(1, pa.int64()), *([pa.nulls(1, pa.binary())] if self.poses else []), pa.array([str(wrong)])], names=["scan_id", "node_id", *(["pose"] if self.poses else []), "error"])


class NodeWriter(ds.DataSourceWriter):
    """One database a scan. Tasks write under names of their own; the driver gives the files their names once all are whole."""

    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.names = unquote(folder.removeprefix("file://").removeprefix("file:")), schema.fieldNames()

    def write(self, rows: Iterator[T.Row]) -> ds.WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        done, now, db = [], None, None
        at = [self.names.index(c) for c in ("scan_id", "node_id", "pose")]
        for row in rows:
            scan, ident, pose = (row[k] for k in at)
            if db is None or scan != now:
                if db is not None:
                    db.commit()
                    db.close()
                now, temporary = scan, os.path.join(self.folder, f".{uuid.uuid4().hex}.part")
                name = str(scan) if str(scan).endswith(".db") else f"{scan}.db"
                if "/" in name:
                    raise ValueError(f"no file name: {name}")
                done.append((temporary, os.path.join(self.folder, name)))
                db = sqlite3.connect(temporary)
                db.executescript("PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; CREATE TABLE Node (id INTEGER PRIMARY KEY, pose BLOB);")
            db.execute("INSERT INTO Node VALUES (?, ?)", (ident, None if pose is None else bytes(pose)))
        if db is not None:
            db.commit()
            db.close()
        message = ds.WriterCommitMessage()
        message.done = done
        return message

    def commit(self, messages: list) -> None:
        for m in messages:
            for temporary, path in m.done if m else []:
                os.replace(temporary, path)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.done if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class NodeSource(ds.DataSource):
    """spark.read.format("slam_nodes").load("folder, file, pattern or several, by commas"): scan_id (the file's name), node_id, pose. Options: split_bytes, poses, errors."""

    @classmethod
    def name(cls) -> str:
        return "slam_nodes"

    def schema(self) -> str:
        return "scan_id string, node_id long" + (", pose binary" if self.options.get("poses", "true") == "true" else "") + (", error string" if self.options.get("errors", "false") == "true" else "")

    def reader(self, schema: T.StructType) -> NodeReader:
        return NodeReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> NodeWriter:
        return NodeWriter(self.options["path"], schema)


def nodes_in(files: DataFrame) -> DataFrame:
    """(scan_id, node_id, pose, error, head): the nodes of files given as rows of path and content, batch or stream. Each file also gives one
    row with head set, and with the reason in error where it cannot be read."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                scan, wrong = os.path.basename(unquote(path)), None
                try:
                    with sqlite3.connect(":memory:") as db:
                        db.deserialize(content.as_py() or b"")
                        for found in batches(db, scan, (), (), True):
                            yield found.append_column("error", pa.nulls(len(found), pa.string())).append_column("head", pa.repeat(False, len(found)))
                except (sqlite3.Error, OverflowError) as reason:
                    wrong = str(reason)
                yield pa.RecordBatch.from_arrays([pa.array([scan]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([wrong], pa.string()), pa.array([True])], names=["scan_id", "node_id", "pose", "error", "head"])

    return files.select("path", "content").mapInArrow(run, "scan_id string, node_id long, pose binary, error string, head boolean")


def packed(nodes: DataFrame) -> DataFrame:
    """(path, content): a database file for each scan of (scan_id, node_id, pose). A scan is packed in one task."""

    def run(rows: pa.Table) -> pa.Table:
        with sqlite3.connect(":memory:") as db:
            db.execute("CREATE TABLE Node (id INTEGER PRIMARY KEY, pose BLOB)")
            db.executemany("INSERT INTO Node VALUES (?, ?)", zip(rows.column("node_id").to_pylist(), rows.column("pose").to_pylist()))
            db.commit()
            return pa.table({"path": pa.array([f"{rows.column('scan_id')[0].as_py()}.db"]), "content": pa.array([db.serialize()], pa.binary())})

    return nodes.select("scan_id", "node_id", "pose").groupBy("scan_id").applyInArrow(run, "path string, content binary")


def register(spark: SparkSession) -> None:
    """Makes `slam_nodes` known to the session, and lets Spark hand conditions over to Python sources, without which it refuses this one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NodeSource)


def write_nodes(nodes: DataFrame, folder: str) -> None:
    """Writes (scan_id, node_id, pose) as one database a scan into a folder that all tasks see."""
    register(nodes.sparkSession)
    nodes.select("scan_id", "node_id", "pose").repartition("scan_id").sortWithinPartitions("scan_id", "node_id").write.format("slam_nodes").mode("append").save(folder)


def read_nodes(spark: SparkSession, path: str | list[str], poses: bool = True, errors: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The nodes of all .db files at path (folders, files or patterns of any file system that Spark reads)."""
    register(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(path)
    paths = sorted(r.path for r in found.select("path").collect())  # names only, as Spark's own listing holds them
    if all(p.startswith("file:") for p in paths):
        return spark.read.format("slam_nodes").options(paths=names_packed(paths), poses=str(poses).lower(), errors=str(errors).lower(), split_bytes=split_bytes).load()
    nodes = nodes_in(found)
    if not errors:
        nodes = nodes.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("scan_id", F.lit(": "), "error"))).otherwise(~F.col("head")).cast("boolean"))
    return nodes.filter("NOT head OR error IS NOT NULL").select("scan_id", "node_id", *(["pose"] if poses else []), *(["error"] if errors else []))
