"""Packet captures (classic pcap, Ethernet or raw IPv4) as a packet table, read and written by byte ranges.

A capture of any size is cut into ranges of bytes, one task each. A record belongs to the range in which it begins. A task
looks for its first record itself: headers have to be plausible one after the other for longer than any packet. When a task
is through, it knows where the record after its range begins, and compares that with what the next task must find
there. The first range begins at a known place, so the ranges together are exact, or the job fails and says so; no packet is
lost or read twice unnoticed.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from flowmarrow.schemas import PACKET_SCHEMA

# File magics with byte order and ticks per second, link types, IP protocols.
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
ETHERNET, RAW_IP = 1, 101
IPV4, VLAN = 0x0800, 0x8100
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}
HEAD, RECORD = 24, 16
RANGE_BYTES = 128 << 20
#: More tasks than that only add their start and the search for their first record; ranges grow instead, up to ``RANGE_BYTES``.
RANGES = 1_000
CHUNK = 4 << 20
#: Bytes after a frame's end that may be looked at (and are then ignored).
SLACK = 128
LONGEST = 1 << 18
#: Seconds by which a record may be older or younger than the first one of its file.
AGE = 20 * 366 * 86_400


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """The captures at a path (a file or the files of a folder) with their sizes."""
    fs, at = _place(path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".pcap"))


@dataclass(frozen=True)
class Capture:
    """What the head of a file says; ``first`` is the second of the first packet."""

    order: str
    ticks: int
    longest: int
    link: int
    first: int


def _opened(file, size: int) -> Capture:
    head = file.read_at(HEAD + 4, 0)
    if len(head) < HEAD or head[:4] not in MAGICS:
        raise ValueError("not a packet capture")
    order, ticks = MAGICS[head[:4]]
    longest, link = struct.unpack_from(order + "II", head, 16)
    first = struct.unpack_from(order + "I", head, HEAD)[0] if len(head) == HEAD + 4 else 0
    return Capture(order, ticks, min(longest or LONGEST, LONGEST), link & 0xFFFF, first)


def _words(data: np.ndarray, at: np.ndarray, order: str) -> np.ndarray:
    """Four-byte numbers at the given places."""
    b = [data[at + k].astype(np.int64) for k in (range(4) if order == ">" else range(3, -1, -1))]
    return b[0] << 24 | b[1] << 16 | b[2] << 8 | b[3]


def _plausible(c: Capture, sec, part, size, full):
    return (abs(sec - c.first) <= AGE) & (part < c.ticks) & (size <= c.longest) & (size <= full) & (full <= LONGEST)


def next_record(file, c: Capture, at: int, size: int) -> int:
    """The first record at or after a place, the size of the file if there is none.

    The search begins two longest packets before the place, at something that looks like a record and is followed by plausible
    records up to the place. What looks like records inside a packet (a capture that is being sent) either
    breaks off with the packet or leads to the record after it, which still lies before the place.
    """
    span = RECORD + c.longest
    begin = max(HEAD, at - 2 * span)
    data = file.read_at(min(at + span, size) - begin, begin)
    if begin == HEAD:
        starts = [0]
    else:
        places = np.arange(max(0, min(span, len(data) - RECORD + 1)))
        sec, part, length, full = (_words(np.frombuffer(data, np.uint8), places + k, c.order) for k in (0, 4, 8, 12))
        starts = places[_plausible(c, sec, part, length, full) & (length > 0)].tolist()
    fields = struct.Struct(c.order + "IIII")
    for here in starts:
        while begin + here < at:
            if begin + here + RECORD > size:
                return size
            told = fields.unpack_from(data, here)
            if begin > HEAD and not _plausible(c, *told):
                break
            here += RECORD + told[2]
        else:
            return size if begin + here + RECORD > size else begin + here
    return size


def _addresses(data: np.ndarray, at: np.ndarray, missing: np.ndarray) -> pa.Array:
    number, which = np.unique(_words(data, at, ">"), return_inverse=True)
    names = pa.array([socket.inet_ntoa(int(n).to_bytes(4, "big")) for n in number], pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(which.astype(np.int32), mask=missing), names).cast(pa.string())


def decoded(chunk: bytes, starts: list[int], c: Capture) -> pa.RecordBatch:
    """The records that begin at the given places of a chunk, field by field for all of them at once."""
    data = np.frombuffer(chunk + bytes(SLACK), np.uint8)
    at = np.array(starts, np.int64)
    sec, part, size = (_words(data, at + k, c.order) for k in (0, 4, 8))
    frame, two = at + RECORD, lambda x: data[x].astype(np.int64) << 8 | data[x + 1]
    if c.link == RAW_IP:
        start, is_ip = frame, (size > 0) & (data[frame] >> 4 == 4)
    elif c.link == ETHERNET:
        kind, tagged = two(frame + 12), (two(frame + 12) == VLAN) & (size >= 18)
        start = frame + np.where(tagged, 18, 14)
        is_ip = (size >= 14) & (np.where(tagged, two(frame + 16), kind) == IPV4)
    else:
        start, is_ip = frame, np.zeros(len(at), bool)
    left = size - (start - frame)
    is_ip &= left >= 20
    number = np.where(is_ip, data[start + 9], 255)
    inner = start + np.where(is_ip, (data[start] & 15).astype(np.int64) * 4, 0)
    left = left - (inner - start)
    tcp = number == 6
    with_ports = (tcp | (number == 17)) & (left >= 4)
    kinds = pa.array([PROTOCOLS.get(n, "other") for n in range(256)], pa.string())
    port = lambda k: pa.array(np.where(with_ports, two(inner + k), 0).astype(np.int32), mask=~is_ip)
    micros = sec * 1_000_000 + (part if c.ticks == 1_000_000 else (part + 500) // 1000)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(micros).cast(pa.timestamp("us", "UTC")),
            _addresses(data, start + 12, ~is_ip), port(0), _addresses(data, start + 16, ~is_ip), port(2),
            kinds.take(pa.array(number.astype(np.int64))), pa.array(size),
            pa.array(data[inner + 13].astype(np.int32), mask=~(tcp & (left >= 14))), pa.array(is_ip),
        ],
        names=PACKET_SCHEMA.fieldNames(),
    )


@dataclass
class Range(InputPartition):
    """The records of a file that begin in [start, end)."""

    path: str
    start: int
    end: int
    size: int


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        even = -(-sum(n for _, n in files) // RANGES)
        step = max(self.range_bytes, min(even, RANGE_BYTES))
        return [Range(p, a, min(a + step, n), n) for p, n in files for a in range(0, n, step)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.path)
        with fs.open_input_file(r.path) as file:
            c = _opened(file, r.size)
            at = next_record(file, c, r.start, r.size) if r.start > HEAD else HEAD
            length = struct.Struct(c.order + "I").unpack_from
            need = CHUNK
            while at < r.end:
                chunk = file.read_at(min(need, r.size - at), at)
                here, starts = 0, []
                while here + RECORD <= len(chunk) and at + here < r.end:
                    size = length(chunk, here + 8)[0]
                    if here + RECORD + size > len(chunk):
                        break
                    starts.append(here)
                    here += RECORD + size
                if starts:
                    yield decoded(chunk, starts, c)
                elif at + len(chunk) == r.size:  # the rest is no whole record
                    at = r.size
                    break
                need = CHUNK if starts else RECORD + size
                at += here
            if r.end < r.size:
                at = r.size if at + RECORD > r.size else at
                if next_record(file, c, r.end, r.size) != at:
                    raise ValueError(f"{r.path} cannot be cut at byte {r.end}: read it with a larger range_bytes")


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class CaptureWriter(DataSourceArrowWriter):
    """One capture per task; files appear under their names when all tasks are done."""

    def __init__(self, path: str, longest: int):
        self.path, self.longest = path, longest

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _place(self.path)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.open"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(name) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, self.longest, ETHERNET))
            for b in batches:
                out.write(encoded(b).tobytes())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.path, m.path.removesuffix(".open") + ".pcap")

    def abort(self, messages: list) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


def encoded(b: pa.RecordBatch) -> np.ndarray:
    """Packets as records of a capture: Ethernet frames of their length (headers at least), zero where there is no header."""
    col = lambda c, kind=np.int64: b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    number = {name: n for n, name in PROTOCOLS.items()}
    kinds = np.array([number.get(p, 0) for p in b.column("proto").to_pylist()], np.int64)
    is_ip = b.column("is_ip").fill_null(False).to_numpy(zero_copy_only=False)
    kinds = np.where(is_ip, kinds, 0)
    least = np.where(is_ip, 34 + np.select([kinds == 6, kinds == 17], [20, 8], 0), 14)
    size = np.maximum(col("length"), least)
    at = np.cumsum(RECORD + size) - RECORD - size
    data = np.zeros(int((RECORD + size).sum()), np.uint8)

    def put(where, values, width, order=">", rows=slice(None)):
        for k in range(width):
            shift = 8 * (k if order == "<" else width - 1 - k)
            data[(where + k)[rows]] = (values >> shift & 255)[rows]

    micros = b.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
    for k, values in enumerate((micros // 1_000_000, micros % 1_000_000, size, size)):
        put(at + 4 * k, values, 4, "<")
    frame = at + RECORD
    put(frame + 12, np.full(len(at), IPV4), 2, rows=is_ip)
    ip = frame + 14
    put(ip, np.full(len(at), 0x45), 1, rows=is_ip)
    put(ip + 2, size - 14, 2, rows=is_ip)
    put(ip + 9, kinds, 1, rows=is_ip)

    @cache
    def address(text):
        return int.from_bytes(socket.inet_aton(text), "big") if text else 0

    for c, k in (("src_ip", 12), ("dst_ip", 16)):
        put(ip + k, np.array([address(x) for x in b.column(c).to_pylist()], np.int64), 4, rows=is_ip)
    ports = (kinds == 6) | (kinds == 17)
    put(ip + 20, col("sport"), 2, rows=ports)
    put(ip + 22, col("dport"), 2, rows=ports)
    put(ip + 32, np.full(len(at), 0x50), 1, rows=kinds == 6)
    put(ip + 33, col("tcp_flags"), 1, rows=kinds == 6)
    return data


class CaptureSource(DataSource):
    """``spark.read.format("capture")`` with options ``path`` and ``range_bytes``, and ``df.write.format("capture")``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return PACKET_SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], int(self.options.get("longest", 65_535)))


def read_packets(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The packets of all ``*.pcap`` files of a folder (or of one file), one task for every range of bytes.

    Small ranges grow when there are very many of them: up to about ``RANGES`` tasks, ``range_bytes`` is kept.

    A folder without a non-empty capture is refused; a file that is no capture fails the job; a truncated last record
    ends its file.
    """
    if not any(size for _, size in _files(path)):
        raise ValueError(f"no packets in {path}")
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("range_bytes", range_bytes).load(path)


def write_packets(packets: DataFrame, path: str) -> None:
    """A folder of captures, one per partition of the packets."""
    packets.sparkSession.dataSource.register(CaptureSource)
    packets.select(*PACKET_SCHEMA.fieldNames()).write.format("capture").mode("append").save(path)
