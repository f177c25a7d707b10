"""Capture files (pcap and pcapng) as a Spark data source: one task per file, batch by batch.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("/captures")

A capture can only be read from its start, so a file is the unit of work; a task holds one batch of
packets, not the file. Paths may be local or any URI pyarrow opens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signalloom.schemas import PACKETS

BATCH = 8192
_FLAGS = "FSRPAUECN"


class CaptureFile(InputPartition):
    """A file's path and the name of its capture."""

    def __init__(self, value: tuple[str, str]) -> None:
        super().__init__(value)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return PACKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(self.options["path"])


class CaptureReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [CaptureFile((self.path, self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]))]
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path.rstrip("/")
        below = [
            f.path[len(root.rstrip("/")) :]
            for f in sorted(files, key=lambda f: f.path)
            if f.type == fs.FileType.File and f.extension in ("pcap", "cap", "pcapng")
        ]
        # a capture is named by its path below the folder, so equal names in different folders differ
        return [CaptureFile((prefix + b, b.strip("/").rsplit(".", 1)[0])) for b in below]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, capture = partition.value
        store, name = _open(path)
        target = to_arrow_schema(PACKETS)
        rows: list[tuple] = []
        with store.open_input_stream(name) as stream:
            for number, (ts_us, length, link, data) in enumerate(records(stream)):
                rows.append((capture, number, ts_us, length, *decode(link, data)))
                if len(rows) == BATCH:
                    yield _batch(rows, target)
                    rows = []
        if rows:
            yield _batch(rows, target)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target
    )


def records(stream) -> Iterator[tuple[int, int, int, bytes]]:
    """Packets of a capture stream: microseconds, original length, link type, bytes."""
    magic = stream.read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(stream)
        return
    layouts = {
        b"\xd4\xc3\xb2\xa1": ("<", 1),
        b"\xa1\xb2\xc3\xd4": (">", 1),
        b"\x4d\x3c\xb2\xa1": ("<", 1000),
        b"\xa1\xb2\x3c\x4d": (">", 1000),
    }
    if magic not in layouts:
        raise ValueError("not a pcap or pcapng file")
    order, per_us = layouts[magic]
    link = struct.unpack(order + "HHiIII", stream.read(20))[5]
    while len(head := stream.read(16)) == 16:
        seconds, fraction, kept, length = struct.unpack(order + "IIII", head)
        yield seconds * 1_000_000 + fraction // per_us, length, link, stream.read(kept)


def _pcapng(stream) -> Iterator[tuple[int, int, int, bytes]]:
    order, links, kind = "<", [], b"\x0a\x0d\x0d\x0a"
    while len(kind) == 4:
        if kind == b"\x0a\x0d\x0d\x0a":
            size, mark = stream.read(4), stream.read(4)
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
            stream.read(struct.unpack(order + "I", size)[0] - 12)
        else:
            code = struct.unpack(order + "I", kind)[0]
            size = struct.unpack(order + "I", stream.read(4))[0]
            body = stream.read(size - 12)
            stream.read(4)
            if code == 1:
                links.append((struct.unpack_from(order + "H", body)[0], _resolution(order, body)))
            elif code == 6:
                number, high, low, kept, length = struct.unpack_from(order + "IIIII", body)
                link, ticks = links[number]
                stamp = (high << 32 | low) * 1_000_000 // ticks
                yield stamp, length, link, body[20 : 20 + kept]
            elif code == 3:
                length = struct.unpack_from(order + "I", body)[0]
                yield 0, length, links[0][0], body[4 : 4 + length]
        kind = stream.read(4)


def _resolution(order: str, body: bytes) -> int:
    """Ticks per second of an interface (option 9), microseconds by default."""
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 9:
            value = body[at + 4]
            return 1 << (value & 0x7F) if value & 0x80 else 10**value
        if code == 0:
            break
        at += 4 + size + (-size) % 4
    return 1_000_000


def decode(link: int, data: bytes) -> tuple:
    """Columns after ``length`` of one packet: addresses, ports, flags, GTP and DNS header values."""
    nothing = (None,) * 12
    if link == 1:
        at, kind = 14, data[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = data[at + 2 : at + 4], at + 4
    elif link == 113:
        at, kind = 16, data[14:16]
    elif link in (101, 12, 14):
        at, kind = 0, b"\x08\x00"
    else:
        return nothing
    if kind != b"\x08\x00" or len(data) < at + 20 or data[at] >> 4 != 4:
        return nothing
    ip = data[at:]
    src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
    number, ttl = ip[9], ip[8]
    base = (src, dst, number, ttl)
    transport = {6: "TCP", 17: "UDP", 132: "SCTP", 1: "ICMP"}.get(number)
    body = ip[(ip[0] & 15) * 4 : int.from_bytes(ip[2:4], "big") or None]
    fragment = int.from_bytes(ip[6:8], "big") & 0x1FFF
    if transport is None or fragment or transport == "ICMP" or len(body) < 8:
        return (*base, None, None, None if fragment else transport, *(None,) * 5)
    sport, dport = int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big")
    flags = None
    payload = b""
    if transport == "TCP" and len(body) >= 20:
        bits = int.from_bytes(body[12:14], "big") & 0x1FF
        flags = "".join(f for i, f in enumerate(_FLAGS) if bits >> i & 1)
        payload = body[(body[12] >> 4) * 4 :]
    elif transport == "UDP":
        payload = body[8:]
    gtp_type = teid = dns = None
    ports = {sport, dport}
    if transport == "UDP" and ports & {2123, 2152} and len(payload) >= 8:
        gtp_type = payload[1]
        has_teid = payload[0] >> 5 == 1 or payload[0] & 8
        teid = int.from_bytes(payload[4:8], "big") if has_teid else None
    if 53 in ports and len(payload) >= 4:
        dns = payload[2] >> 7
    text = ports & {5060, 5061}
    # SIP is kept whole; of other payloads only the fixed media header is looked at.
    return (*base, sport, dport, transport, flags, gtp_type, teid, dns, payload if text else payload[:12])
