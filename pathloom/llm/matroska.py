"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`stored` writes each text as an audio track of unsigned 8-bit samples in a Matroska file (a binary column). `packets`
parses any column of Matroska files into one row per frame: track, timestamp, byte range, lacing and whether a cue
points at its cluster. Element sizes of one to eight bytes and unknown sizes of segments and clusters are read, as are
simple blocks, block groups, and no, Xiph, fixed-size and EBML lacing.

A block's time is its cluster's plus its own, in ticks of the segment's timestamp scale. Further frames of a lace follow at their
track's default duration; without one, at equal parts of the block's duration; without that, at the block's time. A simple block
says itself whether it is a keyframe, a block in a group is one if the group refers to no other block.

Defined cases: a null or empty text is a payload of one frame of bytes 255; a null, empty, or damaged file gives no
packets from the damaged place on; texts of any length are stored whole, and a file is held whole by one task; equal texts give
equal files; repeated rows are answered each; columns are taken by position, so other columns don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table

FRAME, RATE = 576, 8000
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 32
# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0xA0, 0xE1
TIMESTAMP_SCALE, DURATION, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA1, 0xB3, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, SAMPLING, CHANNELS, BIT_DEPTH, DOC_TYPE = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x4282
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE_BLOCK = 0x23E383, 0x9B, 0xFB
MASTERS = {SEGMENT, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP, INFO, TRACKS, ENTRY}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}


def vint(n: int, least: int = 1) -> bytes:
    """n as an EBML size of as few bytes as hold it (all ones is kept for unknown sizes)."""
    length = least
    while n >= (1 << (7 * length)) - 1:
        length += 1
    return (n | 1 << (7 * length)).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block behind their lacing header; kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d, length = b - a, 1
            while abs(d) > (1 << (7 * length - 1)) - 1:
                length += 1
            head += (d + (1 << (7 * length - 1)) - 1 | 1 << (7 * length)).to_bytes(length, "big")
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A Matroska file with the payload as 8-bit samples, `frame` bytes a frame; the lacing kinds take turns."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    seconds = len(payload) / rate
    body = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * seconds)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(rate))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    body += element(TRACKS, element(ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, 1_000_000_000 * frame // rate) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, size, cues = [body], len(body), []
    step = frame * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for at in range(0, len(payload), step):
        start = 1000 * at // rate
        blocks = [number(CLUSTER_TIME, start)]
        for k, b in enumerate(range(at, min(at + step, len(payload)), frame * FRAMES_PER_BLOCK)):
            frames = [payload[f : f + frame] for f in range(b, min(b + frame * FRAMES_PER_BLOCK, len(payload)), frame)]
            kind = 0 if len(frames) == 1 else (2 if len(frames[-1]) == frame else 3, 3, 1)[k % 3]
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 1000 * b // rate - start, 0x80 | kind << 1) + laced(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, size))))
        parts.append(cluster)
        size += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    track: int
    #: in ticks of the segment's timestamp scale
    timestamp: int
    start: int
    size: int
    lacing: int
    keyframe: bool
    cluster: int
    nanoseconds: int


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, place after it); with `keep` the marker stays, as in ids. An unknown size is -1."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError("no variable-length integer")
    n = int.from_bytes(data[at : at + length], "big")
    if not keep:
        n ^= 1 << (7 * length)
        if n == (1 << (7 * length)) - 1:
            n = -1
    return n, at + length


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of a block's frames, where the first starts)."""
    if kind == 0:
        return [end - at], at
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("uneven fixed-size lacing")
        return [(end - at) // count] * count, at
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at = read_vint(data, at)
            if k:
                size = sizes[-1] + size - ((1 << (7 * (at - before) - 1)) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("lacing beyond the block")
    return [*sizes, last], at


def parse(data: bytes | None) -> tuple[list[Packet], set[int]]:
    """(packets in file order, places of clusters that cues point at)."""
    packets: list[Packet] = []
    cues: set[int] = set()
    if not data:
        return packets, cues
    segment = time = cluster = entry = 0
    scale, durations = 1_000_000, {}
    group: dict = {}
    ends = [(len(data), 0)]
    at = 0

    def timed(block: int, index: int, count: int, track: int) -> tuple[int, int]:
        step = durations.get(track) or (group["duration"] * scale / count if group.get("duration") else 0)
        ns = block * scale + round(index * step)
        return ns // scale, ns

    try:
        while at < len(data):
            while at >= ends[-1][0] and len(ends) > 1:
                ends.pop()
            place = at
            ident, at = read_vint(data, at, True)
            size, at = read_vint(data, at)
            if ident in TOP_LEVEL and len(ends) > 2 and ends[-1][1] == CLUSTER:
                ends.pop()  # a cluster of unknown size ends here
            end = ends[-1][0] if size < 0 else at + size
            if ident in MASTERS:
                if ident == SEGMENT:
                    segment, scale, durations = at, 1_000_000, {}
                elif ident == CLUSTER:
                    cluster, group = place, {}
                elif ident == ENTRY:
                    entry = 0
                elif ident == BLOCK_GROUP:
                    group = {"first": len(packets)}
                ends.append((end, ident))
                continue
            if end > len(data):
                break
            value = int.from_bytes(data[at:end], "big") if end - at <= 8 else 0
            if ident == CLUSTER_TIME:
                time = value
            elif ident == TIMESTAMP_SCALE and value:
                scale = value
            elif ident == TRACK_NUMBER:
                entry = value
                if -1 in durations:
                    durations[entry] = durations.pop(-1)
            elif ident == DEFAULT_DURATION:
                durations[entry or -1] = value
            elif ident == CUE_CLUSTER:
                cues.add(segment + value)
            elif ident in (SIMPLE_BLOCK, BLOCK):
                track, p = read_vint(data, at)
                ahead, flags = struct.unpack_from(">hB", data, p)
                kind = flags >> 1 & 3
                sizes, p = frame_sizes(data, p + 3, end, kind)
                if ident == SIMPLE_BLOCK:
                    group = {}
                group["block"] = (time + ahead, track)
                keyframe = bool(flags & 0x80) if ident == SIMPLE_BLOCK else not group.get("refers")
                for i, s in enumerate(sizes):
                    tick, ns = timed(time + ahead, i, len(sizes), track)
                    packets.append(Packet(track, tick, p, s, kind, keyframe, cluster, ns))
                    p += s
            elif ident in (BLOCK_DURATION, REFERENCE_BLOCK) and "first" in group:
                group |= {"duration": value} if ident == BLOCK_DURATION else {"refers": True}
                first = group["first"]
                for i, x in enumerate(packets[first:]):  # they may come behind their block
                    tick, ns = timed(group["block"][0], i, len(packets) - first, x.track)
                    packets[first + i] = x._replace(timestamp=tick, nanoseconds=ns, keyframe=not group.get("refers"))
            at = end
    except (ValueError, IndexError, struct.error):
        pass  # what was read up to the damage stays
    return packets, cues


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text in UTF-8, filled up with bytes 255 to whole frames, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            files = [mux(r + b"\xff" * (-len(r) % FRAME if r else FRAME)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def packets(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row for each frame: id, track, timestamp (in the file's scale), nanoseconds, start and size in bytes, lacing, keyframe, cued."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                found, cues = parse(data.as_py())
                if found:
                    columns = [pa.array(c) for c in zip(*((p.track, p.timestamp, p.nanoseconds, p.start, p.size, p.lacing, p.keyframe, p.cluster in cues) for p in found))]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found), batch.column(0).type), *columns], names=[id_col, "track", "timestamp", "nanoseconds", "start", "size", "lacing", "keyframe", "cued"])

    kind = files.schema[id_col].dataType.simpleString()
    return in_batches(files.select(id_col, media_col), run, f"`{id_col}` {kind}, track long, timestamp long, nanoseconds long, start long, size long, lacing long, keyframe boolean, cued boolean")


def features(files: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep` with what reading each file back gives: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(len(keep)):
                media = data.as_py() or b""
                found, cues = parse(media)
                payload = b"".join(media[p.start : p.start + p.size] for p in found)
                samples = np.frombuffer(payload, np.uint8)
                clusters = {p.cluster for p in found}
                loud = int(np.abs(samples.astype(np.int16) - 128).sum(dtype=np.int64)) // max(1, len(samples))
                by = [sum(p.lacing == k for p in found) for k in range(4)]
                feature = f"packets={len(found)};clusters={len(clusters)};cued={len(clusters & cues)};lacing={'/'.join(map(str, by))};last={found[-1].timestamp if found else 0};mean={int(samples.sum(dtype=np.int64)) // max(1, len(samples))};loud={loud}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *columns], names=[*keep, *names])

    head = [files.schema[c] for c in keep]
    return in_batches(files.select(*keep, media_col), run, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", head)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
