"""Reassembly of fragmented datagrams.

The clock is packet_id. A fragment joins the open datagram of its key if that is not complete and
was touched at most `timeout` packets ago. Fragments that are further apart can never meet, so a
key's fragments fall into sessions, and a session is what one task holds. Datagrams that are not
complete are reported once the file is `timeout` packets past their last fragment, or with flush.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLETE, TIMED_OUT, CONFLICT = 0, 1, 3


@dataclasses.dataclass(frozen=True)
class Config:
    max_bytes: int = 65536
    max_concurrent: int = 4096
    timeout: int = 30


class Datagram:
    """Fragments of one datagram in order of arrival."""

    def __init__(self, first: int):
        self.first = self.last = first
        self.parts: list[tuple[int, int, bytes]] = []
        self.size = self.total = 0
        self.ended = self.conflict = False
        self.payload: bytes | None = None

    def add(self, packet: int, offset: int, more: bool, data: bytes, config: Config) -> bool:
        """Take a fragment; whether the datagram is complete with it."""
        self.last = packet
        if not more:
            self.ended, self.total = True, offset + len(data)
        if self.size + len(data) > config.max_bytes:
            return False  # the payload is dropped
        self.parts.append((offset, packet, data))
        self.size += len(data)
        return self.ended and self._stitch()

    def _stitch(self) -> bool:
        whole, seen, covered = bytearray(self.total), bytearray(self.total), 0
        for offset, _, data in sorted(self.parts, key=lambda p: p[:2]):
            if offset > covered:
                return False  # a gap: later fragments are not compared
            end = min(offset + len(data), self.total)
            if end > offset:
                some = data[: end - offset]
                known = seen[offset:end]
                if any(known) and any(k and a != b for k, a, b in zip(known, whole[offset:end], some, strict=True)):
                    self.conflict = True
                whole[offset:end] = some
                seen[offset:end] = b"\1" * len(some)
            covered = max(covered, offset + len(data))
        if self.conflict or covered < self.total:
            return False
        self.payload = bytes(whole)
        return True

    def gap(self) -> int:
        covered = max((offset + len(data) for offset, _, data in self.parts), default=0)
        return self.total - covered if self.ended and self.total > covered else 0

    def status(self) -> int:
        return CONFLICT if self.conflict else COMPLETE if self.payload is not None else TIMED_OUT

    def row(self) -> dict:
        done = self.payload is not None
        return {"first_packet_id": self.first, "last_packet_id": self.last, "total_length": self.total, "fragment_count": len(self.parts), "completion_status": self.status(), "gap_bytes": 0 if done else self.gap(), "payload": self.payload}


def fold(fragments: Iterable[tuple[int, int, bool, bytes]], config: Config) -> tuple[list[Datagram], list[Datagram]]:
    """Datagrams of one key's fragments (packet, offset, more, data) in packet order, and the one that each fragment is of."""
    found: list[Datagram] = []
    of: list[Datagram] = []
    now: Datagram | None = None
    for packet, offset, more, data in fragments:
        if now is None or now.payload is not None or packet - now.last > config.timeout:
            now = Datagram(packet)
            found.append(now)
        now.add(packet, offset, more, data, config)
        of.append(now)
    return found, of


def fold_limited(fragments: Iterable[tuple[bytes, int, int, bool, bytes]], config: Config) -> tuple[list[Datagram], list[Datagram | None]]:
    """The same over all keys (key, packet, offset, more, data) in packet order, with at most max_concurrent datagrams held.

    A complete datagram is held until its timeout too. A fragment that would begin one too many is of none.
    """
    held: list[Datagram] = []
    by_key: dict[bytes, Datagram] = {}
    found: list[Datagram] = []
    of: list[Datagram | None] = []
    for key, packet, offset, more, data in fragments:
        held = [d for d in held if packet - 1 < d.last + config.timeout]  # eviction follows each packet
        now = by_key.get(key)
        if now is None or now.payload is not None or packet - now.last > config.timeout:
            if len(held) >= config.max_concurrent:
                of.append(None)
                continue
            now = by_key[key] = Datagram(packet)
            held.append(now)
            found.append(now)
        now.add(packet, offset, more, data, config)
        of.append(now)
    return found, of


_OUT = [("file", pa.string()), ("ip_version", pa.int32()), ("protocol", pa.int16()), ("first_packet_id", pa.int64()), ("last_packet_id", pa.int64()), ("total_length", pa.int64()), ("fragment_count", pa.int64()), ("completion_status", pa.int16()), ("gap_bytes", pa.int64()), ("payload", pa.binary()), ("members", pa.list_(pa.int64()))]
_SQL = "file string, ip_version int, protocol smallint, first_packet_id long, last_packet_id long, total_length long, fragment_count long, completion_status smallint, gap_bytes long, payload binary, members array<long>"


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(_OUT))


def _fold_sorted(config: Config):
    """Datagrams of fragments sorted by key, session and packet: one datagram is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, members, out = None, None, [], []

        def close() -> None:
            if now is not None:
                out.append({"file": last[0], "ip_version": last[1], "protocol": protocol, **now.row(), "members": members})

        protocol = 0
        for batch in batches:
            names = ("file", "ip_version", "key", "session", "packet_id", "protocol", "frag_offset_bytes", "more_fragments", "data")
            for *key, packet, proto, offset, more, data in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if now is None or key != last or now.payload is not None or packet - now.last > config.timeout:
                    close()
                    last, now, members = key, Datagram(packet), []
                now.add(packet, offset, more, data, config)
                members.append(packet)
                protocol = proto  # of the latest: that of the fragment which completes it
            if len(out) >= 1024:
                yield _table(out)
                out.clear()
        close()
        if out:
            yield _table(out)

    return run


def _fold_limited(config: Config):
    """fold_limited() as rows come, sorted by file, version and packet: what is held are the open datagrams, max_concurrent at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, by_key, out = None, {}, {}, []

        def close(ended: list[bytes]) -> None:
            for key in ended:
                now, protocol, members = held.pop(key)
                out.append({"file": last[0], "ip_version": last[1], "protocol": protocol, **now.row(), "members": members})

        names = ("file", "ip_version", "key", "packet_id", "protocol", "frag_offset_bytes", "more_fragments", "data")
        for batch in batches:
            for file, version, key, packet, proto, offset, more, data in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (file, version) != last:
                    close(list(held))
                    last, by_key = (file, version), {}
                close([first for first, (d, _, _) in held.items() if packet - 1 >= d.last + config.timeout])
                first = by_key.get(key)
                if first not in held or held[first][0].payload is not None or packet - held[first][0].last > config.timeout:
                    if len(held) >= config.max_concurrent:
                        continue
                    first = by_key[key] = packet
                    held[first] = [Datagram(packet), proto, []]
                entry = held[first]
                entry[0].add(packet, offset, more, data, config)
                entry[1] = proto  # of the latest: that of the fragment which completes it
                entry[2].append(packet)
                if len(out) >= 1024:
                    yield _table(out)
                    out.clear()
        close(list(held))
        if out:
            yield _table(out)

    return run


#: Packets of a span: no task numbers the rows of more than one.
SPAN = 1 << 12


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: from 0, their place in their group by `order`, the first of which is a packet's number.

    A group is cut into spans of packets. Rows are ranked within a span, and the spans' sizes, which are few, are summed up in order.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order[0]) / span))
    within = F.row_number().over(Window.partitionBy(*group, "_span").orderBy(*order)).cast("long") - 1
    sizes = cut.groupBy(*group, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    # By merging: rows lie by their span already. Spark's guess at their size may be far too low to send them to the driver.
    out = cut.withColumn("_within", within).join(sizes.hint("merge"), [*group, "_span"])
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_span", "_within", "_before")


def reassemble(fragments: DataFrame, last_packets: DataFrame, config: Config = Config(), flush: bool = False, share: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Datagrams and fragments of (file, ip_version, key, packet_id, protocol, frag_offset_bytes, more_fragments, data).

    last_packets: (file, last) names each file's last packet. Datagrams: datagram_id (from 1, per file
    and version, by first fragment), the columns of _SQL, and is_reported; fragments: their columns but
    data, with datagram_id, 0 where the number of datagrams held at once was reached. share may keep what is read twice.
    """
    if config.timeout < config.max_concurrent:
        # At most one datagram a packet is begun, and it is let go `timeout` packets later: the limit is out of reach.
        order = Window.partitionBy("file", "ip_version", "key").orderBy("packet_id")
        apart = F.col("packet_id") - F.lag("packet_id").over(order) > config.timeout
        rows = fragments.withColumn("session", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        key = ["file", "ip_version", "key", "session"]
        found = rows.repartition(*key).sortWithinPartitions(*key, "packet_id").mapInArrow(_fold_sorted(config), _SQL)
    else:  # which datagram is refused depends on all others: in the order of the file, with the open ones in memory
        key = ["file", "ip_version"]
        found = fragments.repartition(*key).sortWithinPartitions(*key, "packet_id").mapInArrow(_fold_limited(config), _SQL)
    found = numbered(share(found), ["file", "ip_version"], ["first_packet_id"], "datagram_id").withColumn("datagram_id", F.col("datagram_id") + 1)
    ended = F.col("last") >= F.col("last_packet_id") + config.timeout
    datagrams = found.join(last_packets, "file").withColumn("is_reported", (F.col("completion_status") == COMPLETE) | F.lit(flush) | ended).drop("last")
    members = found.select("file", "ip_version", "datagram_id", F.explode("members").alias("packet_id"))
    parts = fragments.drop("data").join(members, ["file", "ip_version", "packet_id"], "left").fillna(0, ["datagram_id"])
    return datagrams.drop("members"), parts
