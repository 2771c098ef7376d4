"""Text rules that send parts of packets to row parsers.

A rule is `<node>.<field> <op> <value> [&& ...] => <parser> <region> "<label>"`. Its predicates become
Catalyst conditions over the packet's layers, its region a slice; all rules that match a packet
fire, and rows tell which. Extension headers are not followed.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wirelane.functions.types import sql_type
from wirelane.operators import parsers as p
from wirelane.operators import protocols


class RuleError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Predicate:
    node: str
    field: str
    op: str
    value: int


@dataclasses.dataclass(frozen=True)
class Rule:
    rule_id: int
    predicates: tuple[Predicate, ...]
    parser: str
    region: str
    label: str


NODES = {"eth": protocols.ETHERNET, "vlan": protocols.VLAN, "ipv4": protocols.IPV4, "ipv6": protocols.IPV6, "tcp": protocols.TCP, "udp": protocols.UDP}
REGIONS = ("eth_payload", "vlan_payload", "udp_payload", "tcp_payload", "someip_payload")
_OPS = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}

# The grammar, in the package's own parsers.
_word = p.take_while1(p.ALPHA + p.DIGIT + "_").text()
_number = p.alt(p.preceded(p.tag_no_case("0x"), p.cut(p.hex_(64))), p.dec(64, signed=False))
_op = p.alt(*(p.tag(op).text() for op in ("==", "<=", ">=", "<", ">")))


def _spaced(inner: p.Parser) -> p.Parser:
    return p.delimited(p.space0, inner, p.space0)


_predicate = p.seq(p.separated_pair(_word, p.chr_("."), _word), _spaced(_op), _number)
_rule = p.all_consuming(
    p.seq(
        p.separated_list1(_spaced(p.tag("&&")), p.context("predicate", _predicate)),
        p.preceded(_spaced(p.tag("=>")), p.context("parser", p.cut(_word))),
        p.preceded(p.space1, p.context("region", p.cut(_word))),
        p.delimited(p.preceded(p.space1, p.chr_('"')), p.take_till('"').text(), p.preceded(p.chr_('"'), p.multispace0)),
    )
)


def parse_rules(text: str) -> list[Rule]:
    """The rules of a text, numbered from 0; `#` begins a comment. Unknown names and values beyond a field are errors."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        got = _rule(line)
        if isinstance(got, p.Error):
            raise RuleError(f"line {number}: {got.render(line.encode())}")
        predicates, parser, region, label = got[0]
        made = []
        for (node, field), op, value in predicates:
            if node not in NODES:
                raise RuleError(f"line {number}: no node {node}")
            f = dict(NODES[node].fields).get(field)
            if f is None or f.kind not in ("u", "ubits"):
                raise RuleError(f"line {number}: {node} has no integer {field}")
            if value >= 1 << f.bits:
                raise RuleError(f"line {number}: {value} does not fit {node}.{field}")
            made.append(Predicate(node, field, op, value))
        if parser not in PARSERS:
            raise RuleError(f"line {number}: no parser {parser}")
        if region not in REGIONS:
            raise RuleError(f"line {number}: no region {region}")
        out.append(Rule(len(out), tuple(made), parser, region, label))
    return out


# Row parsers: bytes to rows

_raw_tlv = p.many0(p.flat_map(p.pair(p.u8, p.u8), lambda h: p.map_(p.take(h[1]), lambda _: h), "struct<_1: smallint, _2: smallint>"))


def _someip_rows(data: bytes) -> list[dict]:
    return [{"tlv_index": i, "data_id": d, "wire_type": w, "length": len(v)} for i, (d, w, v) in enumerate(protocols.tlv_members(data))]


def _raw_rows(data: bytes) -> list[dict]:
    got = _raw_tlv(data)
    return [] if isinstance(got, p.Error) else [{"tlv_index": i, "type": t, "length": n} for i, (t, n) in enumerate(got[0])]


def _odd_rows(data: bytes) -> list[dict]:
    """Elements of members of wire type 6 that hold [element size][count] and so many elements, each a member itself."""
    out = []
    for array_id, kind, value in protocols.tlv_members(data):
        if kind != 6 or len(value) < 4:
            continue
        size, count = int.from_bytes(value[:2], "big"), int.from_bytes(value[2:4], "big")
        at = 4
        for i in range(count):
            if len(value) - at < size:
                break
            inner = protocols.tlv_members(value[at : at + size])
            if inner:
                out.append({"elem_index": i, "array_id": array_id, "elem_size": size, "elem_count": count, "elem_data_id": inner[0][0]})
            at += size
    return out


#: Parsers by name, and their rows' columns.
PARSERS = {
    "someip_tlv": (_someip_rows, "struct<tlv_index: bigint, data_id: int, wire_type: smallint, length: bigint>"),
    "raw_tlv": (_raw_rows, "struct<tlv_index: bigint, type: smallint, length: smallint>"),
    "oddtlv": (_odd_rows, "struct<elem_index: int, array_id: int, elem_size: int, elem_count: int, elem_data_id: int>"),
    "lldp": (protocols.lldp_tlvs, "struct<tlv_index: bigint, tlv_type: int, tlv_length: int, subtype: smallint, value_offset: int, ttl_seconds: int, caps_supported: int, caps_enabled: int, mgmt_addr_subtype: smallint, mgmt_iface_subtype: smallint, mgmt_iface_number: bigint, value_head: binary>"),
}


class Layers:
    """Conditions and slices over packets' bytes, as Catalyst expressions: Ethernet, any number of VLAN tags, IP, ports.

    rows are the packets with the places of their layers; what no rule asks for besides is not decoded.
    """

    #: Tags that are looked for at constant places; the packets with more are searched tag by tag.
    FEW_TAGS = 3

    def __init__(self, packets: DataFrame):
        # Types stand at fixed places, so the number of tags is a sum of tests of constants.
        payload, end = F.col("payload"), F.octet_length("payload")
        here = (end >= 14) & (F.col("link_type") == 1 if "link_type" in packets.columns else F.lit(True))
        type_at = lambda at: F.conv(F.hex(F.substring(payload, at + 1, F.lit(2) if isinstance(at, Column) else 2)), 16, 10).cast("int")
        is_tag = lambda k: type_at(12 + 4 * k).isin(*protocols.VLAN_TYPES) & (end >= 18 + 4 * k)
        kinds = [type_at(12 + 4 * k) for k in range(self.FEW_TAGS + 1)]
        tags = [here & is_tag(0)]
        for k in range(1, self.FEW_TAGS):
            tags.append(tags[-1] & is_tag(k))
        kind, at = F.when(here, kinds[0]), F.lit(14)
        for k, tag in enumerate(tags):
            kind, at = F.when(tag, kinds[k + 1]).otherwise(kind), at + 4 * tag.cast("int")
        # The first place after the few that holds no tag; a condition's branch, so other packets are not searched.
        places = F.sequence(F.lit(self.FEW_TAGS), F.floor((end - 14) / 4).cast("int"))
        found = F.array_position(F.transform(places, lambda k: type_at(12 + 4 * k).isin(*protocols.VLAN_TYPES) & (end >= 18 + 4 * k)), False).cast("int")
        more = F.when(tags[-1] & is_tag(self.FEW_TAGS), found - 1).otherwise(0)
        rows = packets.withColumns({"_here": here, "_tagged": tags[0], "_more": more, "_first_kind": kind, "_first_at": at})
        at = F.col("_first_at") + 4 * F.col("_more")
        rows = rows.withColumns({"_at": at, "_kind": F.when(F.col("_more") > 0, type_at(at - 2)).otherwise(F.col("_first_kind"))})
        kind, at = F.col("_kind"), F.col("_at")
        four, six = protocols.IPV4.view(payload, at), protocols.IPV6.view(payload, at)
        is4 = F.coalesce((kind == protocols.TYPE_IPV4) & (at + 20 <= end), F.lit(False))
        is6 = F.coalesce((kind == protocols.TYPE_IPV6) & (at + 40 <= end), F.lit(False))
        ports = F.when(is4 & (four["frag_offset"] == 0), at + F.greatest(four["ihl"] * 4, F.lit(20))).when(is6, at + 40)
        proto = F.when(is4, four["protocol"]).when(is6, six["next_header"])
        self.rows = rows.withColumns({"_is4": is4, "_is6": is6, "_proto": proto, "_ports": ports})
        ports, proto = F.col("_ports"), F.col("_proto")
        udp = (proto == protocols.PROTO_UDP) & (ports + 8 <= end)
        tcp = (proto == protocols.PROTO_TCP) & (ports + 20 <= end)
        self.buf, self.end = payload, end
        here, tagged = F.col("_here"), F.col("_tagged")
        self.views = {
            "eth": (protocols.ETHERNET, F.lit(0), here), "vlan": (protocols.VLAN, F.lit(14), tagged), "ipv4": (protocols.IPV4, at, F.col("_is4")),
            "ipv6": (protocols.IPV6, at, F.col("_is6")), "udp": (protocols.UDP, ports, udp), "tcp": (protocols.TCP, ports, tcp),
        }
        self.payload_at = {
            "eth_payload": F.when(here, F.lit(14)), "vlan_payload": F.when(tagged, at), "udp_payload": F.when(udp, ports + 8),
            "tcp_payload": F.when(tcp, ports + F.greatest(protocols.TCP.view(payload, ports)["data_offset"] * 4, F.lit(20))),
        }

    def field(self, node: str, name: str) -> Column:
        """An integer of a layer; null where the packet has no such layer."""
        layout, at, here = self.views[node]
        return F.when(here, layout.view(self.buf, at)[name])

    def region(self, name: str) -> Column:
        """The bytes of a region; null where there is none."""
        if name == "someip_payload":
            at = self.payload_at["udp_payload"]
            size = protocols.SOMEIP.view(self.buf, at)["length"] - 8
            return F.when((at + 16 <= self.end) & (size >= 0), F.substring(self.buf, at + 17, F.least(size, self.end - at - 16).cast("int")))
        at = self.payload_at[name]
        return F.when(at <= self.end, F.substring(self.buf, at + 1, self.end - at))

    def matches(self, rule: Rule) -> Column:
        tests = [F.coalesce(_OPS[t.op](self.field(t.node, t.field), F.lit(t.value)), F.lit(False)) for t in rule.predicates]
        return reduce(lambda a, b: a & b, tests)


def _matched(packets: DataFrame, rules: list[Rule]) -> DataFrame:
    """(packet_id, rule_id, parser, region) for each packet and rule that matches it, in one pass over the packets."""
    layers = Layers(packets)
    fired = F.array_compact(F.array(*(F.when(layers.matches(r), F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.parser).alias("parser"), layers.region(r.region).alias("region"))) for r in rules)))
    return layers.rows.select("packet_id", F.explode(fired).alias("f")).select("packet_id", "f.*")


def _rows(name: str) -> Column:
    make, sql = PARSERS[name]
    kind = sql_type(f"array<{sql}>")
    arrow = to_arrow_type(kind)

    def run(regions: pa.Array) -> pa.Array:
        return pa.array([[] if r is None else make(r) for r in regions.to_pylist()], arrow)

    return F.arrow_udf(run, kind)(F.col("region"))


def run_rules(packets: DataFrame, rules: list[Rule]) -> dict[str, DataFrame]:
    """A table of rows for each parser that a rule names: (packet_id, rule_id, columns of the parser)."""
    matched = _matched(packets, rules) if rules else None
    out = {}
    for name in dict.fromkeys(r.parser for r in rules):
        own = matched.where(F.col("parser") == name)
        out[name] = own.select("packet_id", "rule_id", F.explode(_rows(name)).alias("row")).select("packet_id", "rule_id", "row.*")
    return out


def _row_count() -> Column:
    """How many rows the region's parser gives, whichever of them it is."""

    def run(names: pa.Array, regions: pa.Array) -> pa.Array:
        return pa.array([0 if r is None else len(PARSERS[n][0](r)) for n, r in zip(names.to_pylist(), regions.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(F.col("parser"), F.col("region"))


def rule_stats(packets: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, label, matched, rows) of every rule, also of those that match nothing, in one pass over the packets."""
    names = packets.sparkSession.createDataFrame([(r.rule_id, r.label) for r in rules], "rule_id long, label string")
    counted = _matched(packets, rules).select("rule_id", _row_count().alias("rows"))
    found = counted.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("rows").alias("rows"))
    return names.join(F.broadcast(found), "rule_id", "left").fillna(0, ["matched", "rows"])  # a row per rule


def packet_stats(packets: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: packets_seen and matched_any."""
    layers = Layers(packets)
    any_rule = reduce(lambda a, b: a | b, (layers.matches(r) for r in rules)) if rules else F.lit(False)
    return layers.rows.agg(F.count(F.lit(1)).alias("packets_seen"), F.count_if(any_rule).alias("matched_any"))
