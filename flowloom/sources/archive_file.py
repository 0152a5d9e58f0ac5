"""The single-file flow archive: its binary layout, a writer, a reader and a data source.

Layout, little endian: header, packets as PCAP frames, offset lists, flow
table, optional secondary index, footer.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the format
HEADER_MAGIC, FOOTER_MAGIC, VERSION = b"RSPLIT02", b"RSPLFOOT", 2
HEADER_SIZE, ENTRY_SIZE, FOOTER_SIZE, INDEX_HEADER_SIZE = 64, 96, 128, 36

#: an entry's ports are two bytes each, then two spare bytes each, zero in a real port, hold what lies above them
_ENTRY, _FOOTER = "<QB7x16s16sHHHHQIIQQQ", "<8sI4x9Q"


class ArchiveError(ValueError):
    """A file that is no readable archive."""


def encode_offsets(offsets: list[int]) -> bytes:
    """First offset as u64, then LEB128 differences; nothing for no offsets."""
    if not offsets:
        return b""
    out = bytearray(struct.pack("<Q", offsets[0]))
    for a, b in zip(offsets, offsets[1:], strict=False):
        d = b - a
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def decode_offsets(blob: bytes) -> list[int]:
    if len(blob) < 8:
        return []
    out = [struct.unpack_from("<Q", blob)[0]]
    d = shift = 0
    for byte in blob[8:]:
        d |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(out[-1] + d)
            d = shift = 0
    return out


@dataclass
class Entry:
    flow_id: int
    protocol: int
    src_ip: bytes
    dst_ip: bytes
    src_port: int
    dst_port: int
    packet_count: int
    start_ts_us: int
    end_ts_us: int
    total_bytes: int
    list_offset: int = 0
    list_size: int = 0

    def pack(self) -> bytes:
        b = struct.pack(
            _ENTRY, self.flow_id, self.protocol, self.src_ip, self.dst_ip, self.src_port & 0xFFFF, self.dst_port & 0xFFFF,
            self.src_port >> 16, self.dst_port >> 16, self.list_offset, self.list_size, self.packet_count, self.start_ts_us, self.end_ts_us, self.total_bytes,
        )
        return b.ljust(ENTRY_SIZE, b"\0")

    @classmethod
    def unpack(cls, b: bytes) -> Entry:
        i, p, s, d, sp, dp, sh, dh, lo, ls, n, t0, t1, size = struct.unpack_from(_ENTRY, b)
        return cls(i, p, s, d, sh << 16 | sp, dh << 16 | dp, n, t0, t1, size, lo, ls)


def index_section(pairs: Iterable[tuple[bytes, int]]) -> bytes:
    """Key, count and ids of each key, in key order, behind the number of pairs."""
    by: dict[bytes, set[int]] = {}
    for key, flow_id in pairs:
        by.setdefault(key, set()).add(flow_id)
    out = bytearray(struct.pack("<I", sum(map(len, by.values()))))
    for key in sorted(by):
        ids = sorted(by[key])
        out += key + struct.pack("<I", len(ids)) + struct.pack(f"<{len(ids)}Q", *ids)
    return bytes(out)


def read_section(blob: bytes, width: int) -> dict[bytes, list[int]]:
    out, at = {}, 4
    while at + width + 4 <= len(blob):
        key, n = blob[at : at + width], struct.unpack_from("<I", blob, at + width)[0]
        at += width + 4
        if at + 8 * n > len(blob):
            break
        out[key] = list(struct.unpack_from(f"<{n}Q", blob, at))
        at += 8 * n
    return out


def build_index(entries: list[Entry]) -> bytes:
    """Index header and its address, port (by its lower two bytes) and protocol sections; ports and protocols sort by number."""
    ips = index_section((k, e.flow_id) for e in entries for k in (e.src_ip, e.dst_ip))
    ports = _by_number(((getattr(e, s + "_port") & 0xFFFF, e.flow_id) for e in entries for s in ("src", "dst")), "<H")
    protos = _by_number(((e.protocol, e.flow_id) for e in entries), "<B")
    at, head = INDEX_HEADER_SIZE, b""
    for s in (ips, ports, protos):
        head += struct.pack("<QI", at, len(s))
        at += len(s)
    return head + ips + ports + protos


def _by_number(pairs: Iterable[tuple[int, int]], form: str) -> bytes:
    by: dict[int, set[int]] = {}
    for n, flow_id in pairs:
        by.setdefault(n, set()).add(flow_id)
    out = bytearray(struct.pack("<I", sum(map(len, by.values()))))
    for n in sorted(by):
        out += struct.pack(form, n) + struct.pack("<I", len(by[n])) + struct.pack(f"<{len(by[n])}Q", *sorted(by[n]))
    return bytes(out)


class ArchiveWriter:
    """Writes packets as they come, then the tables; the file appears under its name only when finished."""

    def __init__(self, path: str, link_type: int, secondary_index: bool = True):
        self.path, self.temp, self.indexed = path, f"{path}.tmp-{os.getpid()}", secondary_index
        self.out = open(self.temp, "wb")  # noqa: SIM115
        self.out.write(struct.pack("<8sIIBB", HEADER_MAGIC, VERSION, link_type, 0, 0).ljust(HEADER_SIZE, b"\0"))
        self.offsets: dict[int, list[int]] = {}

    def add(self, flow_id: int, ts_sec: int, ts_usec: int, orig_len: int, data: bytes) -> None:
        self.offsets.setdefault(flow_id, []).append(self.out.tell())
        self.out.write(struct.pack("<IIII", ts_sec, ts_usec, len(data), orig_len) + data)

    def finish(self, entries: Iterable[Entry]) -> None:
        o = self.out
        lists_at = o.tell()
        done = []
        for e in sorted(entries, key=lambda e: e.flow_id):
            blob = encode_offsets(self.offsets.get(e.flow_id, []))
            e.list_offset, e.list_size = o.tell(), len(blob)
            o.write(blob)
            done.append(e)
        table_at = o.tell()
        for e in done:
            o.write(e.pack())
        index_at = o.tell()
        blob = build_index(done) if self.indexed else b""
        o.write(blob)
        o.write(struct.pack(_FOOTER, FOOTER_MAGIC, VERSION, HEADER_SIZE, lists_at - HEADER_SIZE, lists_at, table_at - lists_at, table_at,
                             index_at - table_at, len(done), index_at if blob else 0, len(blob)).ljust(FOOTER_SIZE, b"\0"))
        o.close()
        os.replace(self.temp, self.path)


class ArchiveFile:
    """Random access to an archive file; header, footer and versions are validated."""

    def __init__(self, path: str):
        self.path = path
        size = os.path.getsize(path)
        if size < FOOTER_SIZE:
            raise ArchiveError("too short")
        with open(path, "rb") as f:
            head = f.read(HEADER_SIZE)
            f.seek(size - FOOTER_SIZE)
            magic, version, *x = struct.unpack_from(_FOOTER, f.read(FOOTER_SIZE))
            if head[:8] != HEADER_MAGIC or magic != FOOTER_MAGIC:
                raise ArchiveError("not an archive")
            if version != VERSION or struct.unpack_from("<I", head, 8)[0] != VERSION:
                raise ArchiveError(f"version {version}")
            self.link_type = struct.unpack_from("<I", head, 12)[0]
            _, _, _, _, table_at, table_size, n, index_at, index_size = x
            if table_size < n * ENTRY_SIZE or table_at + table_size > size or index_at + index_size > size:
                raise ArchiveError("tables out of bounds")
            f.seek(table_at)
            table = f.read(n * ENTRY_SIZE)
            self.entries = [Entry.unpack(table[i * ENTRY_SIZE : (i + 1) * ENTRY_SIZE]) for i in range(n)]
            f.seek(index_at)
            self.index = self._sections(f.read(index_size)) if index_size else None

    @staticmethod
    def _sections(blob: bytes) -> list[dict[bytes, list[int]]]:
        out = []
        for i, width in enumerate((16, 2, 1)):
            at, size = struct.unpack_from("<QI", blob, 12 * i)
            out.append(read_section(blob[at : at + size], width))
        return out

    def lookup(self, what: str, value: bytes | int) -> list[int]:
        """Flow ids by ``ip``, ``port`` or ``proto``; by the index if there is one, else by a scan."""
        i = ("ip", "port", "proto").index(what)
        if self.index is not None and what != "port":
            return self.index[i].get(value if i == 0 else int(value).to_bytes(1, "little"), [])
        among = self.entries
        if self.index is not None:
            ids = set(self.index[i].get((int(value) & 0xFFFF).to_bytes(2, "little"), []))
            among = [e for e in among if e.flow_id in ids]
        hit = (
            lambda e: value in (e.src_ip, e.dst_ip),
            lambda e: value in (e.src_port, e.dst_port),
            lambda e: value == e.protocol,
        )[i]
        return [e.flow_id for e in among if hit(e)]

    def packets(self, e: Entry) -> Iterator[tuple[int, int, int, bytes]]:
        """(ts_sec, ts_usec, orig_len, data) of a flow, by its offsets."""
        with open(self.path, "rb") as f:
            f.seek(e.list_offset)
            for at in decode_offsets(f.read(e.list_size)):
                f.seek(at)
                sec, usec, cap, orig = struct.unpack("<IIII", f.read(16))
                yield sec, usec, orig, f.read(cap)


class FlowArchiveSource(DataSource):
    """``spark.read.format("flow_archive").option("table", "flows" | "packets").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "flow_archive"

    def schema(self):
        if self.options.get("table", "flows") == "packets":
            return "flow_id bigint, n bigint, ts_sec bigint, ts_usec bigint, cap_len bigint, orig_len bigint, data binary"
        return (
            "flow_id bigint, protocol int, src_ip binary, dst_ip binary, src_port int, dst_port int,"
            "packet_count bigint, total_bytes bigint, start_ts_us bigint, end_ts_us bigint"
        )

    def reader(self, schema):
        return FlowArchiveReader(self.options)


@dataclass
class Slice(InputPartition):
    start: int
    end: int


class FlowArchiveReader(DataSourceReader):
    FLOWS = 1024

    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "flows")

    def partitions(self):
        n = len(ArchiveFile(self.path).entries)
        return [Slice(i, min(n, i + self.FLOWS)) for i in range(0, max(n, 1), self.FLOWS)]

    def read(self, part: Slice):
        a = ArchiveFile(self.path)
        for e in a.entries[part.start : part.end]:
            if self.table == "packets":
                for n, (sec, usec, orig, data) in enumerate(a.packets(e)):
                    yield e.flow_id, n, sec, usec, len(data), orig, data
            else:
                yield (e.flow_id, e.protocol, e.src_ip, e.dst_ip, e.src_port, e.dst_port, e.packet_count, e.total_bytes, e.start_ts_us, e.end_ts_us)


def count_frames(blob: bytes) -> int:
    """Packets of a PCAP blob."""
    from .capture import read_records

    return sum(1 for _ in read_records(io.BytesIO(blob))[1])
