"""Packet captures as DataFrames: classic pcap and pcapng, in batch and as a stream, read and written.

read_captures() takes the files that Spark's binaryFile source lists, a file a task, in windows; where Arrow does not
reach a store, Spark reads whole files, so it reaches every store that Spark does. scan_captures() cuts large files into byte ranges by their sizes alone: each task
finds the first block of its range, and the ranges' packets are counted and chained before they are
read. The `pcap` data source reads a file a task in windows, follows a growing capture, and writes captures.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wirelane.operators.layout import Layout, be_u16, be_u32
from wirelane.sources.sink import FileWriter

# Block types, magic numbers.
SECTION, INTERFACE, SIMPLE_PACKET, ENHANCED_PACKET = 0x0A0D0D0A, 1, 3, 6
BYTE_ORDER_MAGIC = 0x1A2B3C4D
PCAP_MICROSECONDS, PCAP_NANOSECONDS = 0xA1B2C3D4, 0xA1B23C4D
ETHERNET = 1

SCHEMA = "packet_id long, file_offset long, interface_id long, link_type int, ts_raw long, caplen long, origlen long, payload binary"
RECORD = Layout("packets", [("packet_id", be_u32), ("file_offset", be_u32), ("caplen", be_u32), ("origlen", be_u32)])
INTERFACE_BLOCK = Layout("InterfaceDescription", [("link_type", be_u16), ("reserved", be_u16), ("snaplen", be_u32)])


class CaptureError(ValueError):
    """The file is no capture, or a block's frame is broken."""


class Scanner:
    """Walks a capture block by block. read(offset, n) gives up to n bytes of the file of the given size.

    State is all that later blocks depend on, so a scan can be resumed at any block: the container,
    the byte order of the section, its interfaces' link types, and the packets so far.
    """

    def __init__(self, read, size: int, state: dict | None = None):
        self.read, self.size = read, size
        self.state = state or {"offset": 0, "kind": None, "order": "<", "links": [], "packets": 0}

    def _unpack(self, code: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.state["order"] + code, data, at)

    def _open(self) -> bool:
        head = self.read(0, 24)
        if len(head) < 4:
            return False
        first = struct.unpack("<I", head[:4])[0]
        if first == SECTION:
            self.state["kind"] = "pcapng"
            return True
        for order in "<>":
            if struct.unpack(order + "I", head[:4])[0] in (PCAP_MICROSECONDS, PCAP_NANOSECONDS):
                if len(head) < 24:
                    return False
                self.state.update(kind="pcap", order=order, offset=24, links=[struct.unpack(order + "I", head[20:24])[0] & 0xFFFF])
                return True
        raise CaptureError("neither pcap nor pcapng")

    def blocks(self, end: int | None = None, payloads: bool = True, partial: bool = False) -> Iterator[tuple]:
        """Packets (packet_id, file_offset, interface, link_type, ts_raw, caplen, origlen, payload) of blocks that begin before end.

        partial: stop before a block that the file does not hold whole yet, instead of failing.
        """
        s = self.state
        if s["kind"] is None and not self._open():
            if self.size and not partial:
                raise CaptureError("a capture has at least its header")
            return
        step = self._pcap if s["kind"] == "pcap" else self._pcapng
        while s["offset"] < (self.size if end is None else min(end, self.size)):
            found = step(payloads, partial)
            if found is None:
                return
            if found:
                yield found

    def _short(self, partial: bool, what: str) -> None:
        if not partial:
            raise CaptureError(f"{what} at offset {self.state['offset']} does not end within the file")

    def _pcap(self, payloads: bool, partial: bool) -> tuple | None:
        s = self.state
        at = s["offset"]
        head = self.read(at, 16)
        if len(head) < 16:
            return self._short(partial, "the record")
        seconds, fraction, caplen, origlen = self._unpack("IIII", head)
        if at + 16 + caplen > self.size:
            return self._short(partial, "the record")
        payload = self.read(at + 16, caplen) if payloads else b""
        s["offset"], s["packets"] = at + 16 + caplen, s["packets"] + 1
        return s["packets"] - 1, at, 0, s["links"][0], (seconds << 32) | fraction, caplen, origlen, payload

    def _pcapng(self, payloads: bool, partial: bool) -> tuple | None:
        s = self.state
        at = s["offset"]
        head = self.read(at, 28)
        if len(head) < 12:
            return self._short(partial, "the block")
        if struct.unpack("<I", head[:4])[0] == SECTION:
            order = next((o for o in "<>" if struct.unpack(o + "I", head[8:12])[0] == BYTE_ORDER_MAGIC), None)
            if order is None:
                raise CaptureError(f"the section at offset {at} has no byte order")
            s.update(order=order, links=[])
        kind, length = self._unpack("II", head)
        if length < 12 or length % 4:
            raise CaptureError(f"the block at offset {at} has a length of {length}")
        if at + length > self.size:
            return self._short(partial, "the block")
        if self._unpack("I", self.read(at + length - 4, 4))[0] != length:
            raise CaptureError(f"the block at offset {at} has two lengths")
        s["offset"] = at + length
        if kind == INTERFACE and length >= 20:
            s["links"] = [*s["links"], self._unpack("H", head, 8)[0]]
        if kind != ENHANCED_PACKET or length < 32:
            return ()
        interface, high, low, caplen, origlen = self._unpack("IIIII", head, 8)
        if 28 + caplen + 4 > length:
            return ()
        payload = self.read(at + 28, caplen) if payloads else b""
        s["packets"] += 1
        link = s["links"][interface] if interface < len(s["links"]) else 0
        ts = (high << 32) | low
        return s["packets"] - 1, at, interface, link, ts - (1 << 64) if ts >= 1 << 63 else ts, caplen, origlen, payload


def _of_bytes(data: bytes) -> Scanner:
    return Scanner(lambda at, n: data[at : at + n], len(data))


def scan(data: bytes) -> list[tuple]:
    """All packets of a capture in memory."""
    return list(_of_bytes(data).blocks())


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = [(n, _TYPES[c.split()[1]]) for n, c in zip(_NAMES, SCHEMA.split(", "), strict=True)]
#: Packets of an Arrow batch.
BATCH = 8192


def _batches(rows: Iterator[tuple], extra: dict[str, Any] | None = None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _ARROW, strict=True)]
        more = {n: pa.array([v] * len(held)) for n, v in (extra or {}).items()}
        return pa.RecordBatch.from_arrays([*more.values(), *columns], [*more, *_NAMES])

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _scan_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            read = _Open(path)
            yield from _batches(Scanner(read, read.size).blocks(), {"file": path})


def _scan_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            yield from _batches(_of_bytes(content.as_py()).blocks(), {"file": path})


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, packets of SCHEMA) of all captures under a path of any store; packet_id counts each file's packets from 0.

    A file is read by one task, in windows. Of a store that Arrow does not reach, a task holds the file, and so
    does Spark. A file with a broken frame fails the query. A capture without packets gives no row.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    if _reached(files):
        return files.select("path").mapInArrow(_scan_paths, "file string, " + SCHEMA)
    return files.select("path", "content").mapInArrow(_scan_files, "file string, " + SCHEMA)


def _reached(files: DataFrame) -> bool:
    """Whether Arrow can open what Spark lists: the first file tells."""
    names = files._jdf.inputFiles()
    if not len(names):
        return False
    try:
        _Open(unquote(names[0])).file.close()
    except (OSError, ValueError, NotImplementedError):  # Arrow's errors are of these
        return False
    return True


# The data source


#: Names of stores that Spark and Arrow call differently.
_ALIASES = {"s3a": "s3", "s3n": "s3"}
#: What an URI takes as it is; a name's blanks and per cent signs are quoted, as Spark's paths hold them plain.
_PLAIN = "/:@?=&+,;~!$'()*"


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("dbfs:/"):
        return fs.LocalFileSystem(), "/dbfs/" + path.removeprefix("dbfs:").lstrip("/")
    if "://" not in path or path.startswith("file:///"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{_ALIASES.get(scheme, scheme)}://{quote(rest, _PLAIN)}")


def _paths(path: str) -> list[str]:
    """The files under a path, of a folder and its folders, or that match its `*`, `?` and `[`."""
    from fnmatch import fnmatchcase

    from pyarrow import fs

    store, inner = _filesystem(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    pattern = inner if any(c in inner for c in "*?[") else None
    if pattern:
        inner = pattern[: min(pattern.index(c) for c in "*?[" if c in pattern)].rpartition("/")[0] or "/"
    if not pattern and store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    hidden = lambda f: any(x[:1] in "._" for x in f.path[len(inner) :].split("/") if x)
    return sorted(head + f.path for f in found if f.is_file and not hidden(f) and (pattern is None or fnmatchcase(f.path, pattern)))


class _Open:
    """A file read in windows, so that a scan of headers does not fetch block by block."""

    def __init__(self, path: str, window: int = 1 << 20):
        store, inner = _filesystem(path)
        self.file: BinaryIO = store.open_input_file(inner)
        self.size, self.window = self.file.size(), window
        self.start, self.held = 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.window))
        return self.held[at - self.start : at - self.start + n]


_START = {"offset": 0, "kind": None, "order": "<", "links": [], "packets": 0}


class Split(InputPartition):
    def __init__(self, path: str, state: dict, end: int | None):
        self.path, self.state, self.end = path, state, end

    def rows(self, partial: bool = False) -> Iterator[pa.RecordBatch]:
        if self.path:
            read = _Open(self.path)
            yield from _batches(Scanner(read, read.size, dict(self.state)).blocks(end=self.end, partial=partial), {"file": self.path})


class PcapReader(DataSourceReader):
    """A file a task, read in windows: nothing of a file is read to plan."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Split]:
        return [Split(path, _START, None) for path in _paths(self.path)] or [Split("", {}, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from partition.rows()


class PcapStream(DataSourceStreamReader):
    """Follows one growing capture. An offset is the scanner's state; a block is never split between batches.

    The driver walks the headers of new blocks to know where the whole ones end; packets are read by tasks.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("splitbytes", 64 << 20))
        self.now, self.cuts = dict(_START), [dict(_START)]

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        read = _Open(self.path, 1 << 16)
        scanner = Scanner(read, read.size, dict(self.now))
        for _ in scanner.blocks(payloads=False, partial=True):
            if scanner.state["offset"] - self.cuts[-1]["offset"] >= self.bytes:
                self.cuts.append(dict(scanner.state))
        self.now = dict(scanner.state)
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Split]:
        inner = [c for c in self.cuts if start["offset"] < c["offset"] < end["offset"]]
        starts = [start, *inner]
        return [Split(self.path, a, b["offset"]) for a, b in zip(starts, [*inner, end], strict=True)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from partition.rows(partial=True)

    def commit(self, end: dict) -> None:
        self.cuts = [c for c in self.cuts if c["offset"] >= end["offset"]] or [dict(end)]


# Large files in ranges

#: Blocks in a row that must be sound where a range looks for its first one.
SOUND = 4
_PART = "path string, start long, end long, first long, stop long, packets long, kind string, order string, reset boolean, links array<int>"
_RANGE = "path string, offset long, end long, kind string, order string, links array<int>, packets long"


def _container(read, size: int) -> dict:
    scanner = Scanner(read, size)
    scanner._open()
    return scanner.state


def _sound(read, size: int, kind: str, order: str, at: int) -> bool:
    """Whether blocks begin at a place: a few that follow each other, or all up to the end of the file."""
    for _ in range(SOUND):
        if at == size:
            return True
        if kind == "pcap":
            head = read(at, 16)
            if len(head) < 16:
                return False
            _, fraction, caplen, origlen = struct.unpack(order + "IIII", head)
            if fraction >= 10**9 or caplen > origlen or caplen > 1 << 26:
                return False
            at += 16 + caplen
        else:
            head = read(at, 8)
            if len(head) < 8:
                return False
            length = struct.unpack(order + "I", head[4:])[0]
            if length < 12 or length % 4 or at + length > size or read(at + length - 4, 4) != head[4:]:
                return False
            at += length
        if at > size:
            return False
    return True


def _first_block(read, size: int, state: dict, start: int, end: int) -> tuple[int, str] | None:
    """The first place from start at which blocks seem to begin, and their byte order."""
    kind = state["kind"]
    orders = state["order"] if kind == "pcap" else "<>"
    at = start if kind == "pcap" else start + -start % 4
    while at < end:
        for order in orders:
            if _sound(read, size, kind, order, at):
                return at, order
        at += 1 if kind == "pcap" else 4
    return None


def _walk(read, size: int, state: dict, end: int) -> dict:
    """The scanner's state where the blocks that begin before end are over, with the packets from 0, and whether a section began."""
    state = dict(state, packets=0)
    scanner, before = Scanner(read, size, state), len(state["links"])
    section = False
    while scanner.state["offset"] < min(end, size):
        section |= state["kind"] == "pcapng" and read(scanner.state["offset"], 4) == struct.pack("<I", SECTION)
        if (scanner._pcap if state["kind"] == "pcap" else scanner._pcapng)(False, False) is None:
            break
    links = scanner.state["links"]
    return dict(scanner.state, reset=section, links=links if section else links[before:])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            read = _Open(path)
            state = _container(read, read.size)
            if state["kind"] is None:
                raise CaptureError("a capture has at least its header")
            # A range that begins inside the file's header begins with its first block.
            found = (state["offset"], state["order"]) if start <= state["offset"] else _first_block(read, read.size, state, start, end)
            row = {"path": path, "start": start, "end": end, "first": -1, "stop": -1, "packets": 0, "kind": state["kind"], "order": state["order"], "reset": False, "links": []}
            if found:
                links = state["links"] if state["kind"] == "pcap" else []
                try:
                    got = _walk(read, read.size, {"offset": found[0], "kind": state["kind"], "order": found[1], "links": links, "packets": 0}, end)
                    row |= {"first": found[0], "stop": got["offset"], "packets": got["packets"], "order": got["order"], "reset": got["reset"], "links": got["links"]}
                except CaptureError:
                    pass  # not blocks after all, or a broken file: the chain of ranges tells
            yield pa.RecordBatch.from_pylist([row], _arrow_schema(_PART))


def _chain(parts: pa.Table) -> pa.Table:
    """The ranges of one file with the state at their start; a range that did not find the block that the one before ends with is walked again."""
    out, read, state = [], None, None
    for part in sorted(parts.to_pylist(), key=lambda r: r["start"]):
        if state is None:
            read = _Open(part["path"])
            state = _container(read, read.size)
        if state["offset"] >= part["end"]:
            continue
        out.append({"path": part["path"], "offset": state["offset"], "end": part["end"], "kind": state["kind"], "order": state["order"], "links": state["links"], "packets": state["packets"]})
        if part["first"] != state["offset"]:
            got = _walk(read, read.size, state, part["end"])
            part = dict(part, stop=got["offset"], packets=got["packets"], order=got["order"], reset=got["reset"], links=got["links"])
        # A classic capture has one link type; interfaces are those since the last section began.
        own = state["links"] if part["kind"] == "pcap" else part["links"] if part["reset"] else state["links"] + part["links"]
        state = dict(state, offset=part["stop"], order=part["order"], links=own, packets=state["packets"] + part["packets"])
    return pa.Table.from_pylist(out, _arrow_schema(_RANGE))


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            path, end = row.pop("path"), row.pop("end")
            yield from Split(path, row, end).rows()


def _arrow_schema(sql: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in sql.split(", ")])


def scan_captures(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The rows of read_captures(), of files of any size: each is read by as many tasks as it has ranges of split_bytes.

    The driver sees names and sizes. What a file's ranges tell of themselves, a row each, is chained by one task a file.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    parts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))))
    parts = parts.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartition("path", "start")
    ranges = parts.mapInArrow(_probe, _PART).groupBy("path").applyInArrow(_chain, _RANGE)
    return ranges.repartition("path", "offset").mapInArrow(_read_ranges, "file string, " + SCHEMA)


class PcapWriter(FileWriter):
    """A capture a task, of rows with ts_raw and payload; pcapng also takes interface_id. All packets are of the option linkType."""

    suffix = "pcap"

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        super().__init__(options, overwrite)
        self.container, self.link = options.get("container", "pcap"), int(options.get("linktype", ETHERNET))
        self.order = ">" if options.get("byteorder") == "big" else "<"
        self.named = "interface_id" in schema.names

    def chunks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        head = True
        for batch in iterator:
            stamps, payloads = batch.column("ts_raw").to_pylist(), [p or b"" for p in batch.column("payload").to_pylist()]
            if not stamps:
                continue
            if self.container == "pcap":
                whole = write_pcap([(ts >> 32 & 0xFFFFFFFF, ts & 0xFFFFFFFF, p) for ts, p in zip(stamps, payloads, strict=True)], self.link, self.order)
                yield whole if head else whole[24:]
            else:
                faces = batch.column("interface_id").to_pylist() if self.named else [0] * len(stamps)
                links = [self.link] * (max(faces) + 1)
                yield write_pcapng([(i, ts & (1 << 64) - 1, p) for i, ts, p in zip(faces, stamps, payloads, strict=True)], links, self.order)
            head = False


class Pcap(DataSource):
    """spark.read.format("pcap").load(path), spark.readStream (option splitBytes), and df.write (options container, byteOrder, linkType)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "file string, " + SCHEMA

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema) -> PcapStream:
        return PcapStream(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pcap)


# Writing, for fixtures and round trips


def write_pcap(packets: list[tuple[int, int, bytes]], link_type: int = ETHERNET, order: str = "<", magic: int = PCAP_MICROSECONDS) -> bytes:
    """A classic capture of (seconds, fraction, payload)."""
    out = [struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link_type)]
    out += [struct.pack(order + "IIII", s, f, len(p), len(p)) + p for s, f, p in packets]
    return b"".join(out)


def _block(kind: int, body: bytes, order: str) -> bytes:
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def write_pcapng(packets: list[tuple[int, int, bytes]], links: list[int] | None = None, order: str = "<", options: list[tuple[int, bytes]] | None = None) -> bytes:
    """A section of (interface, timestamp, payload), each with the same options (code, value)."""
    out = [_block(SECTION, struct.pack(order + "IHHq", BYTE_ORDER_MAGIC, 1, 0, -1), order)]
    out += [_block(INTERFACE, struct.pack(order + "HHI", link, 0, 65535), order) for link in links or [ETHERNET]]
    tail = b"".join(struct.pack(order + "HH", code, len(value)) + _padded(value) for code, value in options or [])
    for interface, ts, payload in packets:
        head = struct.pack(order + "IIIII", interface, ts >> 32, ts & 0xFFFFFFFF, len(payload), len(payload))
        out.append(_block(ENHANCED_PACKET, head + _padded(payload) + tail, order))
    return b"".join(out)


def packet_options(block: bytes, order: str = "<") -> list[tuple[int, bytes]]:
    """Options (code, value) of an enhanced packet block, padded to 4 bytes each; broken ones end the list."""
    caplen = struct.unpack_from(order + "I", block, 20)[0]
    at, end, out = 28 + caplen + -caplen % 4, len(block) - 4, []
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", block, at)
        if at + 4 + size + -size % 4 > end:
            break
        out.append((code, block[at + 4 : at + 4 + size]))
        at += 4 + size + -size % 4
    return out
