"""All tables of captures: packets decoded once, fragments reassembled, messages numbered."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wirelane.operators import defrag, protocols


@dataclasses.dataclass(frozen=True)
class Options:
    """What to decode. Ports are those of UDP datagrams, either end."""

    reassembly: defrag.Config | None = dataclasses.field(default_factory=defrag.Config)
    someip_ports: tuple[int, ...] = (30490,)
    someip_tlv_ports: tuple[int, ...] = ()
    flush: bool = False


_LAYOUTS = {"eth": protocols.ETHERNET, "vlan": protocols.VLAN, "ipv4": protocols.IPV4, "ipv6": protocols.IPV6, "tcp": protocols.TCP, "udp": protocols.UDP}
_COMMON_NAMES = ("domain_number", "sequence_id", "correction_field", "log_message_interval", "source_port_identity")
#: Tables whose rows stand for a layer of one packet or datagram: their JSON names.
_NODES = {"eth": "eth", "vlan": "vlan", "ipv4": "ip", "ipv6": "ipv6", "tcp": "tcp", "udp": "udp"}


class Capture:
    """Tables by name over packets (file, packet_id, file_offset, interface_id, link_type, ts_raw, caplen, origlen, payload).

    Every table has `file` and `packet_id`, the keys to join by; datagram_id joins fragments with their
    datagram, msg_index the parts of a gPTP message. A table decodes what it needs of the packets and no
    more. Where many tables are read, `with Capture(...) as c:` decodes all once and keeps them until the end.
    """

    def __init__(self, packets: DataFrame, options: Options = Options()):
        self.options = options
        self.source = packets
        self._kept: list[DataFrame] = []
        self._tables: dict[str, DataFrame] = {}

    def __enter__(self) -> Capture:
        self._tables, self._kept = {}, [self._decode(protocols.TABLES).persist()]
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Let the kept layers go; tables can still be read, and decode again."""
        for df in self._kept:
            df.unpersist()
        self._tables, self._kept = {}, []

    def _share(self, df: DataFrame) -> DataFrame:
        """Kept too while layers are, as many tables read it."""
        if self._kept:
            self._kept.append(df.persist())
        return df

    def _decode(self, wanted: Iterable[str]) -> DataFrame:
        layers = protocols.decode(F.col("payload"), F.col("link_type"), self.options.reassembly is not None, wanted)
        # An element of a list, taken out again: a filter on layers would else decode once more.
        return self.source.select(*(c for c in self.source.columns if c != "payload"), F.explode(F.array(layers)).alias("layers"))

    def layers(self, *wanted: str) -> DataFrame:
        """The packets without their payloads, and `layers`: a struct of lists, of which those wanted are made."""
        return self._kept[0] if self._kept else self._decode(wanted)

    def union(self, names: list[str], columns: list[str], packet: Iterable[str] = ()) -> DataFrame:
        """(packet..., table, columns...) of several tables of whole packets, from one walk: for ports, addresses and the like.

        packet: columns of the packets, which need no join then.
        """
        def tagged(name: str) -> Callable[[Column], Column]:
            return lambda x: F.struct(F.lit(name).alias("table"), *(x[c].alias(c) for c in columns))

        rows = F.concat(*(F.transform(f"layers.{n}", tagged(n)) for n in names))
        return self.layers(*names).select(*packet, F.explode(rows).alias("row")).select(*packet, "row.*")

    def _exploded(self, name: str, *more: str) -> DataFrame:
        return self.layers(name, *more).select("file", "packet_id", F.explode(f"layers.{name}").alias("row")).select("file", "packet_id", "row.*")

    def _reassembled(self) -> tuple[DataFrame, DataFrame]:
        if "fragments" not in self._tables:
            parts = self._exploded("ipv4_frag").withColumn("ip_version", F.lit(4)).unionByName(self._exploded("ipv6_frag").withColumn("ip_version", F.lit(6)))
            last = self.source.groupBy("file").agg(F.max("packet_id").alias("last"))
            config = self.options.reassembly or defrag.Config()
            datagrams, parts = defrag.reassemble(parts, last, config, self.options.flush, self._share)
            self._tables["datagrams"], self._tables["fragments"] = self._share(datagrams), self._share(parts)
        return self._tables["datagrams"], self._tables["fragments"]

    def _again(self, name: str, payloads: bool) -> DataFrame:
        """TCP or UDP rows of reassembled datagrams."""
        datagrams, parts = self._reassembled()
        done = datagrams.where("completion_status = 0")
        # The layer stands right after the fragment that completed it.
        at = parts.select("file", "ip_version", "datagram_id", F.col("packet_id").alias("last_packet_id"), "layer_no")
        done = done.join(at, ["file", "ip_version", "datagram_id", "last_packet_id"])
        if name == "udp":
            data = F.substring("payload", F.lit(9), F.greatest(F.octet_length("payload") - 8, F.lit(0)))
            layout, proto, more = protocols.UDP, protocols.PROTO_UDP, [(data if payloads else F.lit(None).cast("binary")).alias("data")]
        else:
            layout, proto, more = protocols.TCP, protocols.PROTO_TCP, []
        rows = done.where((F.col("protocol") == proto) & layout.fits(F.col("payload")))
        head = layout.view(F.col("payload"))
        return rows.select("file", F.col("last_packet_id").alias("packet_id"), (F.col("layer_no") + 2).alias("layer_no"), *(head[n].alias(n) for n, _ in layout.fields), *more, "datagram_id", F.lit(True).alias("is_reassembled"))

    def _ports(self, name: str, payloads: bool) -> DataFrame:
        """TCP or UDP rows of packets, then of reassembled datagrams; with UDP payloads if asked for."""
        whole = self._exploded(name, *(["udp.data"] if payloads else [])).withColumn("datagram_id", F.lit(0).cast("long")).withColumn("is_reassembled", F.lit(False))
        return whole if self.options.reassembly is None else whole.unionByName(self._again(name, payloads))

    def _someip(self) -> DataFrame:
        udp = self.table("udp", True)
        found = protocols.someip(F.col("data"), F.col("src_port"), F.col("dst_port"), list(self.options.someip_ports), list(self.options.someip_tlv_ports))
        if "someip**" not in self._tables:
            rows = udp.select("file", "packet_id", "layer_no", "datagram_id", "is_reassembled", found.alias("s")).where("s is not null")
            self._tables["someip**"] = self._share(rows)
        return self._tables["someip**"]

    def _gptp(self) -> DataFrame:
        if "gptp*" not in self._tables:
            whole = self._exploded("gptp").where(F.octet_length("message") >= protocols.GPTP.size)  # the others are no messages
            found = whole.select("file", "packet_id", "layer_no", protocols.gptp(F.col("message")).alias("m"))
            self._tables["gptp*"] = self._share(defrag.numbered(self._share(found), ["file"], ["packet_id", "layer_no"], "msg_index"))
        return self._tables["gptp*"]

    def table(self, name: str, internal: bool = False) -> DataFrame:
        """A table by its name; internal ones carry `layer_no`, the layer's place, and datagram payloads."""
        key = f"{name}{'*' if internal else ''}"
        if key not in self._tables:
            made = self._make(name, internal)
            self._tables[key] = made if internal else made.drop("layer_no", "data")
        return self._tables[key]

    def _make(self, name: str, internal: bool) -> DataFrame:
        if name == "packets":
            return self.source.select("file", "packet_id", "file_offset", "caplen", "origlen")
        if name in ("udp", "tcp"):
            return self._ports(name, internal and name == "udp")
        if name in _NODES:
            return self._exploded(name).withColumn("datagram_id", F.lit(0).cast("long")).withColumn("is_reassembled", F.lit(False))
        if name in ("ipv4_frag", "ipv6_frag"):
            _, parts = self._reassembled()
            own = parts.where(F.col("ip_version") == int(name[3]))
            return own.select("file", "packet_id", "layer_no", "datagram_id", "frag_offset_bytes", "more_fragments", (F.col("frag_offset_bytes") == 0).alias("is_first"), (~F.col("more_fragments")).alias("is_last"))
        if name == "datagram":
            datagrams, _ = self._reassembled()
            shown = datagrams.where("is_reported")
            return shown.select("file", "datagram_id", "ip_version", "total_length", "fragment_count", "first_packet_id", "last_packet_id", "completion_status", "gap_bytes")
        if name == "someip":
            return self._someip().select("file", "packet_id", "layer_no", "datagram_id", "is_reassembled", "s.header.*")
        if name in ("someip_sd_entry", "someip_sd_option", "someip_tlv"):
            part = name.removeprefix("someip_")
            rows = self._someip().select("file", "packet_id", "layer_no", F.explode(f"s.{part}").alias("row"))
            return rows.select("file", "packet_id", "layer_no", "row.*")
        if name == "lldp":
            return self._exploded("lldp")
        if name == "gptp_path_trace":
            rows = self._gptp().where("m.body is not null").select("file", "packet_id", "layer_no", "msg_index", F.posexplode("m.path").alias("entry_index", "clock_identity"))
            return rows
        kind = name.removeprefix("gptp_")
        if kind in protocols.GPTP_BODIES:
            rows = self._gptp().where((F.col("m.kind") == kind) & F.col("m.body").isNotNull())
            common = F.struct("msg_index", "packet_id", *(F.col(f"m.common.{c}").alias(c) for c in _COMMON_NAMES))
            return rows.select("file", "packet_id", "layer_no", common.alias("common"), *(F.col(f"m.body.{c}").alias(c) for c in protocols.GPTP_BODIES[kind]))
        raise KeyError(f"no table {name}")

    #: In the order of a full dump.
    NAMES = ("packets", "eth", "vlan", "ipv4", "ipv6", "udp", "tcp", "ipv4_frag", "ipv6_frag", "datagram", "someip", "someip_sd_entry", "someip_sd_option", "someip_tlv", "lldp", *(f"gptp_{k}" for k in protocols.GPTP_BODIES), "gptp_path_trace")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.NAMES}

    def join_packets(self, name: str) -> DataFrame:
        """A table with the columns of its packets."""
        return self.table(name).join(self.table("packets"), ["file", "packet_id"])

    def to_arrow(self, name: str, rows: int = 65_536) -> pa.RecordBatchReader:
        """A table as a stream of Arrow batches for a consumer in Python, partition by partition: the driver holds one at a time."""
        return export_stream(self.table(name), rows)

    # JSON

    def _layers(self) -> DataFrame:
        """(file, packet_id, layer_no, sub, name, json) of all layers; sub orders those of one layer_no."""
        line = lambda layer_no, sub, name, json: F.struct(layer_no.cast("int").alias("layer_no"), sub.cast("int").alias("sub"), name.alias("name"), json.alias("json"))
        own = lambda layout: [n for n, _ in layout.fields]
        zero, packet = F.lit(0), F.col("packet_id")
        parts = []

        def node_line(kind: T.StructType, names: list[str], layer: str) -> Callable[[Column], Column]:
            return lambda x: line(x["layer_no"], zero, F.lit(layer), json_of(x, kind, names))

        def child_line(kind: T.StructType, layer: str, base: int) -> Callable[[Column], Column]:
            return lambda x: line(F.col("layer_no"), x[kind.names[0]] + base, F.lit(layer), json_of(x, kind, kind.names, packet_id=packet))

        def add(rows: DataFrame, *lists: Column) -> None:
            some = [F.coalesce(x, F.array().cast("array<struct<layer_no:int,sub:int,name:string,json:string>>")) for x in lists]
            parts.append(rows.select("file", "packet_id", F.explode(F.concat(*some)).alias("line")).select("file", "packet_id", "line.*"))

        # What each packet holds by itself.
        packets = self.layers(*protocols.TABLES)
        frame = F.struct("interface_id", F.col("ts_raw").alias("timestamp_raw"), "caplen", "origlen", "link_type")
        lists = [F.array(line(F.lit(-1), zero, F.lit("frame"), F.to_json(frame)))]
        for table, layer in _NODES.items():
            lists.append(F.transform(f"layers.{table}", node_line(protocols.LAYERS[table].dataType.elementType, own(_LAYOUTS[table]), layer)))
        units = protocols.LLDP_TYPE
        lists.append(F.transform("layers.lldp", lambda x: line(x["layer_no"], zero, F.lit("lldp"), json_of(x, units, units.names[1:], packet_id=F.col("packet_id")))))
        lists.append(F.transform("layers.extra", lambda x: line(x["layer_no"], zero, x["name"], x["json"])))
        add(packets, *lists)

        if self.options.reassembly is not None:
            datagrams, members = self._reassembled()
            ends = {"is_first": F.col("frag_offset_bytes") == 0, "is_last": ~F.col("more_fragments")}
            fragment = F.to_json(F.struct("datagram_id", "frag_offset_bytes", "more_fragments", *(c.alias(n) for n, c in ends.items())))
            add(members, F.array(line(F.col("layer_no"), zero, F.when(F.col("ip_version") == 4, "ip.fragment").otherwise("ipv6.fragment"), fragment)))
            done = datagrams.where("completion_status = 0").withColumn("packet_id", F.col("last_packet_id")).join(members.select("file", "ip_version", "datagram_id", "packet_id", "layer_no"), ["file", "ip_version", "datagram_id", "packet_id"])
            add(done, F.array(line(F.col("layer_no") + 1, zero, F.lit("ip.reassembled"), F.to_json(F.struct("datagram_id", "total_length", "fragment_count", "completion_status")))))
            for table in ("tcp", "udp"):
                again = self._again(table, False)
                add(again, F.array(line(F.col("layer_no"), zero, F.lit(table), json_column(again, own(_LAYOUTS[table])))))

        someip = self._someip()
        kinds = {n: protocols.SOMEIP_LAYERS[n].dataType for n in protocols.SOMEIP_LAYERS.names}
        lists = [F.array(line(F.col("layer_no"), F.lit(1), F.lit("someip"), json_of(F.col("s.header"), kinds["header"], own(protocols.SOMEIP))))]
        for name, layer, base in (("sd_entry", "someip.sd_entry", 10), ("sd_option", "someip.sd_option", 100_000), ("tlv", "someip.tlv_member", 10)):
            lists.append(F.transform(f"s.{name}", child_line(kinds[name].elementType, layer, base)))
        add(someip, *lists)

        messages = self._gptp().where("m.body is not null")
        body, common = protocols.GPTP_TYPE["body"].dataType, _COMMON_NAMES
        head = F.struct("msg_index", "packet_id", *(_jsonable(F.col(f"m.common.{c}"), protocols.GPTP_TYPE["common"].dataType[c].dataType).alias(c) for c in common))
        texts = [F.when(F.col("m.kind") == kind, F.to_json(F.struct(head.alias("common"), *(_jsonable(F.col(f"m.body.{c}"), body[c].dataType).alias(c) for c in columns)))) for kind, columns in protocols.GPTP_BODIES.items()]
        trace = F.transform("m.path", lambda x, i: line(F.col("layer_no"), i, F.lit("gptp.path_trace"), F.to_json(F.struct("msg_index", i.alias("entry_index"), F.lower(F.hex(x)).alias("clock_identity")))))
        add(messages, trace, F.array(line(F.col("layer_no"), F.lit(1_000_000), F.concat(F.lit("gptp."), F.col("m.kind")), F.coalesce(*texts))))
        return reduce(DataFrame.unionByName, parts)

    def json(self) -> DataFrame:
        """(file, packet_id, line): a JSON object for each packet, its layers in the order of decoding.

        All tables are read, so the layers are kept from here on, until close().
        """
        if not self._kept:
            self.__enter__()
        return fold_layers(self._layers(), ["file", "packet_id"])


def json_of(x: Column, kind: T.StructType, names: list[str], **first: Column) -> Column:
    """Compact JSON of fields of a record in order: bytes as lower-case hex, records and lists nested, nulls left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in first.items()), *(_jsonable(x[n], kind[n].dataType).alias(n) for n in names)))


def json_column(rows: DataFrame, names: list[str]) -> Column:
    """The same of columns."""
    return F.to_json(F.struct(*(_jsonable(F.col(n), rows.schema[n].dataType).alias(n) for n in names)))


def _jsonable(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_jsonable(c[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _jsonable(x, kind.elementType))
    return c


def fold_layers(layers: DataFrame, key: list[str]) -> DataFrame:
    """One line per key (the last column of which is its index) from rows (key..., layer_no, sub, name, json).

    A name that occurs again becomes an array, in the place of its first occurrence.
    """
    every = layers.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("layer_no", "sub", "json", "name"))).alias("every"))

    def member(name: Column) -> Column:
        texts = F.transform(F.filter("every", lambda x: x["name"] == name), lambda x: x["json"])
        value = F.when(F.size(texts) > 1, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))).otherwise(texts[0])
        return F.concat(F.lit('"'), name, F.lit('":'), value)

    inner = F.array_join(F.transform(F.array_distinct(F.transform("every", lambda x: x["name"])), member), ",")
    return every.select(*key, F.concat(F.lit('{"_index":'), F.col(key[-1]).cast("string"), F.lit(',"_source":{"layers":{'), inner, F.lit("}}}")).alias("line"))


def export_stream(table: DataFrame, rows: int = 65_536) -> pa.RecordBatchReader:
    """The rows of a DataFrame as a stream of record batches, of `rows` rows at most, without all of them in memory."""
    schema = to_arrow_schema(table.schema)

    def batches() -> Iterator[pa.RecordBatch]:
        held: list = []
        for row in table.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return pa.RecordBatchReader.from_batches(schema, batches())


def write_ndjson(capture: Capture, path: str) -> None:
    """One line per packet, in order of file and packet."""
    capture.json().orderBy("file", "packet_id").select("line").write.mode("overwrite").text(path)


def write_json_array(capture: Capture, path: str) -> None:
    """The same as one JSON array in each file of the folder: a file per input capture.

    An array is written line by line from its sorted partition: brackets stand with the first and the last line, commas between.
    """
    lines = capture.json()
    ends = lines.groupBy("file").agg(F.min("packet_id").alias("first"), F.max("packet_id").alias("last"))
    files = max(ends.count(), 1)
    marked = lines.join(ends, "file").withColumnRenamed("file", "capture").repartitionByRange(files, "capture").sortWithinPartitions("capture", "packet_id")
    text = F.concat(F.when(F.col("packet_id") == F.col("first"), "[").otherwise(""), F.col("line"), F.when(F.col("packet_id") == F.col("last"), "]").otherwise(","))
    marked.select("capture", text.alias("line")).write.mode("overwrite").partitionBy("capture").text(path)
