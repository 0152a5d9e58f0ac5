"""Capture files: PCAP and PCAP-NG parsing, and the ``capture`` data source.

PCAP has no sync marks.  ``read_captures`` cuts large files at fixed places; a
task a range guesses the first record there from a run of plausible headers,
and walks headers to the range's end.  The driver only checks that each range
ends where the next one begins (one number a range) and walks a range again
whose guess was wrong, so the result never rests on a guess.  Tasks then parse
ranges in parallel.  PCAP-NG files, whose blocks carry state, are one task each.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.net import file_stem
from ..schema import RAW_PACKET

EXTENSIONS = (".pcap", ".pcapng", ".cap", ".ntar")
#: first four bytes of PCAP files: byte order and fractions per second (fixed values of the format)
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
NG_MAGIC = SECTION.to_bytes(4, "big")
RANGE_BYTES = 64 << 20
#: a guessed record has at most this many bytes and is followed by ``CHAIN`` others (or the file's end)
GUESS_BYTES, CHAIN = 256 << 10, 16
MAX_TASKS = 1 << 17


class ParseError(ValueError):
    """A capture that can't be read."""


class UnknownFormat(ParseError):
    pass


@dataclass
class Record:
    ts_sec: int
    ts_usec: int
    cap_len: int
    orig_len: int
    link_type: int
    data: bytes


def sniff(head: bytes) -> str:
    if head[:4] in PCAP_MAGIC:
        return "pcap"
    if head[:4] == NG_MAGIC:
        return "pcapng"
    raise UnknownFormat("neither PCAP nor PCAP-NG")


@dataclass
class PcapHeader:
    order: str
    per_second: int
    link_type: int
    compat_ts: bool = False

    @classmethod
    def read(cls, head: bytes, compat_ts: bool = False) -> PcapHeader:
        if len(head) < 24:
            raise ParseError("PCAP header cut off")
        order, per_second = PCAP_MAGIC[head[:4]]
        major, minor = struct.unpack(order + "HH", head[4:8])
        link = struct.unpack(order + "I", head[20:24])[0]
        return cls(order, per_second, link, compat_ts and (major, minor) == (2, 4))

    def micros(self, fraction: int) -> int:
        return fraction // 1000 if self.compat_ts or self.per_second > 1_000_000 else fraction


def pcap_records(f: BinaryIO, head: PcapHeader, end: int | None = None, permissive: bool = False) -> Iterator[Record]:
    """Records from the current position up to ``end``; a cut-off record header ends the file, a cut-off body is an error."""
    fields = struct.Struct(head.order + "IIII")
    while end is None or f.tell() < end:
        h = f.read(16)
        if len(h) < 16:
            return
        sec, frac, cap, orig = fields.unpack(h)
        data = f.read(cap) if cap else b""
        if len(data) < cap:
            if permissive:
                return
            raise ParseError(f"record of {cap} bytes, {len(data)} left")
        yield Record(sec, head.micros(frac), cap, orig, head.link_type, data)


@dataclass
class NgState:
    """Interfaces of the current section."""

    order: str = "<"
    interfaces: list[tuple[int, int, int]] = field(default_factory=list)  # link type, snap length, ticks a second
    first_link: int | None = None


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0 or at + 4 + size > len(body):
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _resolution(body: bytes, order: str) -> int:
    for code, value in _options(body, order):
        if code == 9 and value:
            v = value[0]
            n = 2 ** (v & 127) if v & 128 else 10**v
            return n if n <= 1 << 63 else 1_000_000
    return 1_000_000


def ng_records(f: BinaryIO, state: NgState | None = None) -> Iterator[Record]:
    """Packets of a PCAP-NG stream; unknown blocks are skipped, a malformed length ends it."""
    s = state or NgState()
    while True:
        head = f.read(8)
        if len(head) < 8:
            return
        if head[:4] == NG_MAGIC:
            magic = f.read(4)
            if magic not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise ParseError("bad byte-order magic")
            s.order, s.interfaces = "<" if magic[0] == 0x4D else ">", []
            size = struct.unpack(s.order + "I", head[4:])[0]
            rest = size - 12
            if size < 28 or len(f.read(rest)) < rest:
                return
            continue
        kind, size = struct.unpack(s.order + "II", head)
        if size < 12 or size % 4:
            return
        body = f.read(size - 12)
        if len(body) < size - 12 or len(f.read(4)) < 4:
            return
        if kind == INTERFACE and len(body) >= 8:
            link, snap = struct.unpack_from(s.order + "H2xI", body)
            s.interfaces.append((link, snap, _resolution(body[8:], s.order)))
            s.first_link = link if s.first_link is None else s.first_link
        elif kind == ENHANCED and len(body) >= 20:
            iface, high, low, cap, orig = struct.unpack_from(s.order + "5I", body)
            link, _, ticks = s.interfaces[iface] if iface < len(s.interfaces) else (1, 0, 1_000_000)
            if 20 + cap > len(body):
                return
            ts = high << 32 | low
            sec, rest = divmod(ts, ticks)
            yield Record(sec, rest * 1_000_000 // ticks, cap, orig, link, body[20 : 20 + cap])
        elif kind == SIMPLE and len(body) >= 4:
            orig = struct.unpack_from(s.order + "I", body)[0]
            link, snap, _ = s.interfaces[0] if s.interfaces else (1, 0, 0)
            cap = min(orig, snap or orig, len(body) - 4)
            yield Record(0, 0, cap, orig, link, body[4 : 4 + cap])


def read_records(f: BinaryIO, compat_ts: bool = False, permissive: bool = False) -> tuple[int, Iterator[Record]]:
    """(link type for output headers, records) of a whole capture."""
    head = f.read(24)
    if sniff(head) == "pcap":
        h = PcapHeader.read(head, compat_ts)
        return h.link_type, pcap_records(f, h, None, permissive)
    import io
    from itertools import chain

    f = io.BufferedReader(_Prepended(head, f))
    state = NgState()
    records = ng_records(f, state)
    first = next(records, None)
    return (state.first_link if state.first_link is not None else 1), chain([first] if first else [], records)


class _Prepended:
    """A readable that gives some bytes and then a stream."""

    closed = False

    def __init__(self, head: bytes, rest: BinaryIO):
        self.head, self.rest = head, rest

    def readable(self):
        return True

    def seekable(self):
        return False

    def writable(self):
        return False

    def readinto(self, buffer):
        data = self.head[: len(buffer)] or self.rest.read(len(buffer))
        self.head = self.head[len(buffer) :]
        buffer[: len(data)] = data
        return len(data)

    def flush(self):
        pass

    def close(self):
        pass


def collect_files(path: str, recursive: bool = False) -> list[str]:
    """Capture files of a path, sorted; a file counts whatever its extension."""
    if path == "-" or os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    found = []
    for top, _, names in os.walk(path):
        found += [os.path.join(top, n) for n in names if n.lower().endswith(EXTENSIONS)]
        if not recursive:
            break
    return sorted(found)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None
    first: int


def walk(f: BinaryIO, h: PcapHeader, at: int, end: int, size: int) -> tuple[int, int]:
    """(first record boundary at or behind ``end``, records before it) from the boundary ``at``, reading headers only."""
    length, n = struct.Struct(h.order + "8xI4x"), 0
    while at < end and at + 16 <= size:
        f.seek(at)
        at += 16 + length.unpack(f.read(16))[0]
        n += 1
    return at, n


def guess_boundary(f: BinaryIO, h: PcapHeader, start: int, end: int, size: int) -> int | None:
    """The first place of ``[start, end)`` that looks like a record boundary, if any does."""
    fields = struct.Struct(h.order + "IIII")

    def plausible(head: bytes, at: int, near: int | None) -> tuple[int, int] | None:
        sec, frac, cap, orig = fields.unpack_from(head, at)
        ok = frac < h.per_second and 0 < cap <= GUESS_BYTES and cap <= orig and (near is None or abs(sec - near) < 30 * 86400)
        return (sec, cap) if ok else None

    def followed(at: int, sec: int, cap: int) -> bool:
        for _ in range(CHAIN):
            at += 16 + cap
            if at + 16 > size:
                return at <= size
            f.seek(at)
            if not (found := plausible(f.read(16), 0, sec)):
                return False
            sec, cap = found
        return True

    f.seek(start)
    window = f.read(min(end - start + 15, GUESS_BYTES + 32))
    for i in range(len(window) - 15):
        if (found := plausible(window, i, None)) and followed(start + i, *found):
            return start + i
    return None


def _locate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nominal ranges (id, file, start, end, size) -> (id, guessed begin or null, stop, records)."""
    for b in rows:
        out = []
        for r in b.to_pylist():
            with open(r["file"], "rb") as f:
                h = PcapHeader.read(f.read(24))
                at = 24 if r["start"] == 24 else guess_boundary(f, h, r["start"], r["end"], r["size"])
                out.append((r["id"], at, *((None, None) if at is None else walk(f, h, at, r["end"], r["size"]))))
        cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "begin", "stop", "n"])


def _spread(df: DataFrame, n: int) -> DataFrame:
    """One row a task, as far as ``MAX_TASKS`` go."""
    return df.repartition(max(1, min(n, MAX_TASKS)))


def plan_ranges(spark: SparkSession, files: list[str], range_bytes: int = RANGE_BYTES) -> list[Range]:
    """Ranges of about ``range_bytes`` of large PCAP files, found in parallel; other files are one range each."""
    nominal, out = [], []
    for file in files:
        size = os.path.getsize(file)
        with open(file, "rb") as f:
            kind = sniff(f.read(24))
        if kind != "pcap" or size <= range_bytes:
            out.append(Range(file, 0, None, 0))
        else:
            cuts = [*range(24, size, range_bytes), size]
            nominal += [(file, a, b, size) for a, b in zip(cuts, cuts[1:], strict=False)]
    if not nominal:
        return out
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(nominal)], "id bigint, file string, start bigint, end bigint, size bigint")
    found = _spread(rows, len(nominal)).mapInArrow(_locate, "id bigint, begin bigint, stop bigint, n bigint").toArrow().to_pydict()
    found = dict(zip(found["id"], zip(found["begin"], found["stop"], found["n"], strict=True), strict=True))
    at = first = 0
    for i, (file, start, end, size) in enumerate(nominal):
        if start == 24:
            at, first = 24, 0
        if at >= end:  # a record of an earlier range covers this one
            continue
        begin, stop, n = found[i]
        if begin != at:
            with open(file, "rb") as f:
                stop, n = walk(f, PcapHeader.read(f.read(24)), at, end, size)
        if n:
            out.append(Range(file, at, min(stop, size), first))
        at, first = stop if n else size, first + n
    return out


def batches(file: str, out_link: int, records: Iterator[Record], first: int = 0, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("file_stem", pa.string()), ("pkt_idx", pa.int64()), ("link_type", pa.int32()), ("out_link_type", pa.int32()),
        ("ts_sec", pa.int64()), ("ts_usec", pa.int64()), ("cap_len", pa.int64()), ("orig_len", pa.int64()), ("data", pa.binary()),
    ])
    stem, held, size = file_stem(file), [], 0

    def flush():
        n = len(held)
        cols = [[file] * n, [stem] * n, list(range(first, first + n)), [r.link_type for r in held], [out_link] * n]
        cols += [[getattr(r, k) for r in held] for k in ("ts_sec", "ts_usec", "cap_len", "orig_len", "data")]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    for r in records:
        held.append(r)
        size += len(r.data) + 64
        if size >= max_bytes:
            yield flush()
            first, held, size = first + len(held), [], 0
    if held:
        yield flush()


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(path)``: packets of PCAP and PCAP-NG files, a task a file.

    Options: ``recursive``, ``compat_ts`` (version 2.4 files count nanoseconds),
    ``permissive`` (a cut-off last record ends a file).  ``read_captures`` reads
    ranges of large files in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return RAW_PACKET

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        from ..streaming.capture_stream import CaptureStreamReader

        return CaptureStreamReader(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        on = lambda k: str(options.get(k, "false")).lower() == "true"
        self.path, self.recursive = options.get("path", ""), on("recursive")
        self.compat_ts, self.permissive = on("compat_ts"), on("permissive")

    def partitions(self):
        return [Range(p, 0, None, 0) for p in collect_files(self.path, self.recursive)]

    def read(self, part: Range):
        with open(part.file, "rb") as f:
            if part.end is None:
                link, records = read_records(f, self.compat_ts, self.permissive)
            else:
                head = PcapHeader.read(f.read(24), self.compat_ts)
                link = head.link_type
                f.seek(part.start)
                records = pcap_records(f, head, part.end, self.permissive)
            yield from batches(part.file, link, records, part.first)


def read_captures(
    spark: SparkSession, path: str, *, recursive: bool = False, compat_ts: bool = False, permissive: bool = False,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Packets of captures on a file system that all nodes mount; large PCAP files are read in ranges of ``range_bytes``."""
    parts = plan_ranges(spark, collect_files(path, recursive), range_bytes)
    reader = CaptureReader({"compat_ts": compat_ts, "permissive": permissive})

    def run(rows):
        for b in rows:
            for r in b.to_pylist():
                yield from reader.read(Range(**r))

    rows = spark.createDataFrame([(r.file, r.start, r.end, r.first) for r in parts], "file string, start bigint, end bigint, first bigint")
    return _spread(rows, len(parts)).mapInArrow(run, RAW_PACKET)


def read_remote_captures(spark: SparkSession, path: str, *, recursive: bool = False, compat_ts: bool = False) -> DataFrame:
    """Packets of captures in any store that Spark reads; each file (under 2 GB) is parsed by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parse_blobs(files.selectExpr("path AS file", "content AS blob"), compat_ts=compat_ts)


def parse_blobs(blobs: DataFrame, *, compat_ts: bool = False) -> DataFrame:
    """Packets of the captures in a binary column ``blob``, named by ``file``; empty and null blobs have none."""
    def run(rows):
        import io

        for b in rows:
            for file, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if blob:
                    link, records = read_records(io.BytesIO(blob), compat_ts)
                    yield from batches(file, link, records)

    return blobs.select("file", "blob").mapInArrow(run, RAW_PACKET)
