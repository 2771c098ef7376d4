"""More registered queries, one for each family of operators that the catalog's first ones leave out, with the same in SQL."""

from __future__ import annotations

import atexit
import dataclasses
import json
import shutil
import tempfile
import uuid
from typing import Annotated

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.functions import schemas
from wirelane.operators import bulk, defrag, layout, parsers, rules
from wirelane.operators import protocols as pr
from wirelane.operators.layout import Layout
from wirelane.operators.run import lower, parse, rendered
from wirelane.plans import files, lines
from wirelane.plans.capture import Capture, Options, export_stream
from wirelane.plans.catalog import NAMED, as_packets, be, blob, broken_fragments, frame, ipv4, order_packets, query, table, udp, zeros
from wirelane.sources import ocf, pcap
from wirelane.streaming.reassembly import reassemble_stream

p = parsers
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a temporary one under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="wirelane-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = _own[0]
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def put_files(path: str, contents: dict[str, bytes]) -> None:
    """A few small files."""
    store, inner = pcap._filesystem(path)
    store.create_dir(inner, recursive=True)
    for name, content in contents.items():
        with store.open_output_stream(f"{inner}/{name}") as out:
            out.write(content)


# Parsers


@query("SELECT s_suppkey, repeat(chr((65 + s_suppkey % 26)::INT), (s_suppkey % 3 + 1)::BIGINT) AS letters, s_suppkey::VARCHAR AS digits, (s_suppkey % 2 + 1)::INT AS blanks, (1 + strlen(s_suppkey::VARCHAR))::BIGINT AS n_rest, 't' || s_suppkey AS rest FROM supplier")
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha1, digit1, space1, one_of, newline, tab, crlf, none_of, anychar, satisfy, rest_len and rest, as Catalyst expressions and in the kernel alike."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    text = F.concat(F.repeat(F.char(k % 26 + 65), (k % 3 + 1).cast("int")), k.cast("string"), F.repeat(F.lit(" "), (k % 2).cast("int")), F.lit("\t!\n\t\r\nrest"), k.cast("string"))
    grammar = p.seq(p.alpha1, p.digit1, p.space1, p.one_of("!?"), p.newline, p.tab, p.crlf, p.none_of("xyz"), p.anychar, p.satisfy(str.islower), p.rest_len, p.rest.text())
    b = s.select("s_suppkey", blob(text).alias("b"))
    fast, slow = lower(grammar, b.b), parse(b.b, grammar)
    rows = b.where(fast.ok).select("s_suppkey", fast.value.alias("f"), slow["value"].alias("v")).where("f = v")
    return rows.select("s_suppkey", F.col("v._1").alias("letters"), F.col("v._2").alias("digits"), F.length("v._3").alias("blanks"), F.col("v._11").alias("n_rest"), F.col("v._12").alias("rest"))


@query("SELECT s_suppkey, format('{:x}', s_suppkey) AS hexed, format('{:o}', s_suppkey) AS octal, 'Ab' || s_suppkey AS word, s_name AS line FROM supplier")
def char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hex_digit, oct_digit and alphanumeric runs, the empty runs of every class, not_line_ending, line_ending and eof, in the kernel."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    text = F.concat(F.lower(F.hex(k)), F.lit("z"), F.conv(k, 10, 8), F.lit("9Ab"), k.cast("string"), F.lit("-;"), s.s_name, F.lit("\r\n"))
    none = p.seq(p.alpha0, p.digit0, p.hex_digit0, p.oct_digit0, p.space0, p.multispace0)
    grammar = p.seq(p.hex_digit1, p.chr_("z"), p.oct_digit1, p.chr_("9"), p.alphanumeric1, p.chr_("-"), none, p.chr_(";"), p.not_line_ending, p.line_ending, p.alphanumeric0, p.eof)
    v = parse(text, grammar)["value"]
    return s.select("s_suppkey", v["_1"].alias("hexed"), v["_3"].alias("octal"), v["_5"].alias("word"), v["_9"].alias("line")).where("hexed is not null")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '^[^:]*://([^/]*)', 1) AS host, substr(regexp_extract(url, '^[^:]*://[^/]*(.*)$', 1), 1, 4) AS head FROM pages")
def url_take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """take_until, tag of bytes, take_while and take_while_m_n over URLs, as Catalyst expressions."""
    pages = table(spark, sf_dir, "pages")
    got = lower(p.seq(p.take_until("://").text(), p.tag(b"://"), p.take_while(lambda b: b != 47).text(), p.take_while_m_n(0, 4, lambda b: True).text()), blob(pages.url))
    return pages.where(got.ok).select("page_id", got.value["_1"].alias("scheme"), got.value["_3"].alias("host"), got.value["_4"].alias("head"))


@query("SELECT p_partkey, (3 * p_partkey + 3)::BIGINT AS total, least(p_partkey % 5 + 1, 3)::INT AS few, greatest(p_partkey % 5 - 2, 0)::INT AS more, (p_partkey % 7)::INT AS till, (p_partkey % 3 + 1)::BIGINT AS folded, 2::BIGINT AS two, (p_partkey % 4)::INT AS counted, (p_partkey % 4 * (p_partkey % 1000))::BIGINT AS summed FROM part")
def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """separated_list1, count, many_m_n, checked_many0, many_till, fold_many1, fold_many_m_n and length_count, in one grammar."""
    part = table(spark, sf_dir, "part")
    k = part.p_partkey
    n = (k % 4).cast("int")
    text = F.concat_ws("", F.concat_ws(",", k, k + 1, k + 2), F.lit(";ab"), F.repeat(F.lit("x"), (k % 5 + 1).cast("int")), F.repeat(F.lit("y"), (k % 7).cast("int")), F.lit("|"), F.repeat(F.lit("7"), (k % 3 + 1).cast("int")), F.lit("--"))
    data = F.concat(blob(text), be(k % 4, 1), F.unhex(F.repeat(F.hex(be(k % 1000, 2)), n)))
    count = lambda item, fold, *more: fold(*more, item, lambda: 0, lambda a, _: a + 1, "bigint")
    grammar = p.all_consuming(p.seq(
        p.terminated(p.separated_list1(p.chr_(","), p.dec(64)), p.chr_(";")), p.count(p.take(1), 2), p.many_m_n(1, 3, p.tag("x")), p.checked_many0(p.tag("x"), 10),
        p.many_till(p.anychar, p.tag("|")), count(p.chr_("7"), p.fold_many1), count(p.chr_("-"), p.fold_many_m_n, 1, 5), p.length_count(p.u8, p.be_u16)))
    v = parse(data, grammar)["value"]
    rows = part.select("p_partkey", v.alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("p_partkey", total("v._1").alias("total"), F.size("v._3").alias("few"), F.size("v._4").alias("more"), F.size("v._5._1").alias("till"), F.col("v._6").alias("folded"), F.col("v._7").alias("two"), F.size("v._8").alias("counted"), total("v._8").alias("summed"))


@query("SELECT p_partkey, 'Brand#' AS raw, substr(p_brand, 7) AS peeked, CAST(substr(p_brand, 7) AS BIGINT) AS number, regexp_extract(substr(p_name, 1, 4), '^[A-Za-z]+') AS word, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE -1 END AS half, p_partkey::DOUBLE AS real FROM part")
def modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognize, peek, consumed, not_, cond, map_parser, complete, map_opt, map_res, value, fail and into."""
    part = table(spark, sf_dir, "part")
    first = p.seq(p.recognize(p.pair(p.alpha1, p.tag("#"))), p.peek(p.digit1), p.consumed(p.map_(p.digit1, int, "bigint")), p.not_(p.tag("#")), p.cond(True, p.complete(p.tag(" "))), p.cond(False, p.tag("zzz")), p.map_parser(p.take(4), p.alpha1))
    half = p.alt(p.map_opt(p.all_consuming(p.dec(64)), lambda n: n // 2 if n % 2 == 0 else None), p.map_res(p.verify(p.rest, lambda b: not b), lambda b: None, "bigint"), p.value(-1, p.rest), p.fail)
    rows = part.select("p_partkey", parse(F.concat_ws(" ", "p_brand", "p_name"), first)["value"].alias("a"), parse(part.p_partkey.cast("string"), p.pair(p.peek(half), p.into(p.dec(64), float, "double")))["value"].alias("b"))
    text = lambda c: F.decode(F.col(c), "UTF-8")
    return rows.where("a._3._1 = encode(a._2, 'UTF-8')").select("p_partkey", text("a._1").alias("raw"), F.col("a._2").alias("peeked"), F.col("a._3._2").alias("number"), F.col("a._7").alias("word"), F.col("b._1").alias("half"), F.col("b._2").alias("real"))


NUMBERS = Layout("Numbers", [("a", layout.le_u16), ("b", layout.le_u24), ("c", layout.le_u32), ("d", layout.le_u48), ("e", layout.le_u64), ("f", layout.i8), ("g", layout.be_i32), ("h", layout.le_i32), ("i", layout.le_i64), ("j", layout.be_u24), ("k", layout.le_u32), ("l", layout.le_u16), ("m", layout.be_i64)])


@query("SELECT s_suppkey, (s_suppkey % 65536)::INT AS a, s_suppkey + 70000 AS b, s_suppkey + 3000000000 AS c, s_suppkey + 200000000000000 AS d, s_suppkey + 1000000000000000000 AS e, (s_suppkey % 256 - 128)::INT AS f, (-s_suppkey)::INT AS g, (-s_suppkey * 1000)::INT AS h, -s_suppkey * 1000000000000 AS i, s_suppkey AS j, s_suppkey AS k, (s_suppkey % 65536)::INT AS l, -s_suppkey AS m, (s_suppkey + 0.5)::FLOAT AS n, s_suppkey % 2 = 1 AS o, (s_suppkey % 128)::BIGINT AS q FROM supplier")
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of all widths, signs and orders, the host's order and one given at run time, float_, bool_bit and bytes_ inside bits."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    values = {"a": k, "b": k + 70000, "c": k + 3_000_000_000, "d": k + 200_000_000_000_000, "e": k + 10**18, "f": k % 256 - 128, "g": -k, "h": -k * 1000, "i": -k * 10**12, "j": k, "k": k, "l": k, "m": -k}
    data = F.concat(NUMBERS.encode(values), be(k % 2 * 128 + k % 128, 1), be(k, 2), blob(F.concat(k.cast("string"), F.lit(".5"))))
    tail = p.bits(p.bseq(p.bool_bit(), p.take_bits(7), p.bytes_(p.be_u16)))
    halves = p.map_(p.pair(p.be_i16, p.be_u16), lambda v: v[0] * 65536 + v[1], "int")  # no key is too large for the SQL's INT
    numbers = (p.le_u16, p.le_u24, p.le_u32, p.le_u48, p.le_u64, p.i8, halves, p.le_i32, p.le_i64, p.be_u24, p.uint_(4, "little"), p.ne_u16, p.be_i64)
    rows = s.select("s_suppkey", parse(data, p.all_consuming(p.seq(*numbers, tail, p.float_)))["value"].alias("v"))
    names = list(zip("abcdefghijklm", range(1, 14), strict=True))
    kinds = {"a": "int", "e": "long", "f": "int", "g": "int", "l": "int"}
    return rows.select("s_suppkey", *(F.col(f"v._{i}").cast(kinds.get(n, "int" if n == "h" else "long")).alias(n) for n, i in names), F.col("v._15").alias("n"), F.col("v._14._1").alias("o"), F.col("v._14._2").alias("q"))


@query("SELECT n_nationkey, 'fail' AS kind, 2::BIGINT AS at, 'inner@2,outer@0' AS frames, 'parse failure at offset 2: expected tag' AS message FROM nation")
def error_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context and cut: the frames of an error, and its rendering."""
    n = table(spark, sf_dir, "nation")
    grammar = p.context("outer", p.preceded(p.tag("NA"), p.context("inner", p.cut(p.tag("xx")))))
    rows = n.select("n_nationkey", parse(n.n_name, grammar)["error"].alias("e"), rendered(n.n_name, grammar).alias("text"))
    frames = F.array_join(F.transform("e.context", lambda x: F.concat(x["label"], F.lit("@"), x["offset"].cast("string"))), ",")
    return rows.select("n_nationkey", "e.kind", F.col("e.offset").alias("at"), frames.alias("frames"), F.split("text", "\n")[0].alias("message"))


def _twin(src: p.Source, pos: int, end: int):
    """A parser by hand: two equal bytes, the second looked at only within bounds."""
    if end - pos < 2:
        return p.short(src, end, 2 - (end - pos))
    return (pos + 2, src.buf[pos]) if src.buf[pos] == src.buf[pos + 1] else p.Error(p.ERR, pos, "twin")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'incomplete' WHEN s_suppkey % 4 = 3 THEN 'err' END AS kind, CASE WHEN s_suppkey % 4 < 2 THEN 2 - s_suppkey % 4 WHEN s_suppkey % 4 = 3 THEN 0 END AS needed, CASE WHEN s_suppkey % 4 = 2 THEN 7 END::INT AS value FROM supplier")
def handwritten_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's parser that makes its own errors and asks for more bytes itself."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey % 4
    data = F.when(k == 0, F.unhex(F.lit(""))).when(k == 1, F.unhex(F.lit("07"))).when(k == 2, F.unhex(F.lit("0707"))).otherwise(F.unhex(F.lit("0708")))
    rows = s.select("s_suppkey", parse(data, p.parser(_twin, "int"), streaming=True).alias("r"))
    return rows.select("s_suppkey", "r.error.kind", "r.error.needed", "r.value")


def _ethernet_chain() -> p.Parser:
    """Ethernet, a VLAN tag, IPv4 and UDP, each verified within a context of its own: (vid, src, dst, src_port, dst_port, payload)."""
    eth = p.context("ethernet", p.verify(p.strct(pr.ETHERNET), lambda h: h["ethertype"] == 0x8100))
    tag = p.context("vlan", p.verify(p.strct(pr.VLAN), lambda h: h["inner_ethertype"] == 0x800))
    net = p.context("ipv4", p.verify(p.strct(pr.IPV4), lambda h: h["version"] == 4 and h["ihl"] >= 5 and h["protocol"] == 17))
    ports = p.context("udp", p.verify(p.strct(pr.UDP), lambda h: h["length"] >= 8))
    inner = p.flat_map(ports, lambda u: p.map_(p.take(u["length"] - 8), lambda data: (u["src_port"], u["dst_port"], len(data))), "struct<_1: int, _2: int, _3: int>")
    skip = lambda ip: p.preceded(p.take(4 * ip["ihl"] - 20), p.map_(inner, lambda u: (int.from_bytes(ip["src"]), int.from_bytes(ip["dst"]), *u)))
    whole = "struct<_1: bigint, _2: bigint, _3: int, _4: int, _5: int>"
    return p.preceded(eth, p.pair(p.map_(tag, lambda t: t["vid"], "int"), p.flat_map(net, skip, whole)))


@query("SELECT o_orderkey AS packet_id, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS ok, CASE WHEN o_orderkey % 2 = 1 THEN 'ethernet' WHEN o_orderkey % 3 = 0 THEN 'ipv4' END AS failed_in, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_custkey % 100 END::INT AS vid, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_custkey END AS src, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 16 END::INT AS payload FROM orders")
def ethernet_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strct, verify and flat_map down the layers of a frame; a packet of another kind tells in which layer it failed."""
    packets = order_packets(spark, sf_dir)
    r = packets.select("packet_id", parse(packets.payload, _ethernet_chain()).alias("r"))
    return r.select("packet_id", "r.ok", F.col("r.error.context")[0]["label"].alias("failed_in"), F.col("r.value._1").alias("vid"), F.col("r.value._2._1").alias("src"), F.col("r.value._2._5").alias("payload"))


def json_value() -> p.Parser:
    """Any JSON value, as compact JSON text: a value is one of seven kinds, told apart as it is parsed, and nests."""
    ws = p.multispace0
    spaced = lambda x: p.delimited(ws, x, ws)
    text = p.delimited(p.chr_('"'), p.recognize(p.many0(p.alt(p.recognize(p.pair(p.chr_("\\"), p.anychar)), p.take_till1('"\\')))), p.cut(p.chr_('"')))
    quoted = p.map_(text, lambda b: json.dumps(json.loads(b'"' + b + b'"'), ensure_ascii=False), "string")
    number = p.map_(p.recognize(p.double_), lambda b: b.decode(), "string")
    word = p.alt(*(p.value(w, p.tag(w)) for w in ("true", "false", "null")))
    value = p.lazy(lambda: spaced(p.alt(number, quoted, items, record, word)), "string")
    items = p.map_(p.delimited(p.chr_("["), p.alt(p.separated_list1(p.chr_(","), value), p.value([], ws, "array<string>")), p.cut(p.chr_("]"))), lambda v: f"[{','.join(v)}]", "string")
    member = p.separated_pair(spaced(quoted), p.chr_(":"), value)
    record = p.map_(p.delimited(p.chr_("{"), p.alt(p.separated_list1(p.chr_(","), member), p.value([], ws, "array<string>")), p.cut(p.chr_("}"))), lambda kv: "{" + ",".join(f"{k}:{v}" for k, v in kv) + "}", "string")
    return p.all_consuming(value)


@query("""SELECT event_id, '{"type":"' || event_type || '","props":{"k":' || json_extract(props, '$.k') || '},"odd":[true,null,{"n":' || (event_id % 9) || '},[]]}' AS value FROM events""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive grammar whose values are of several kinds."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{ "type" : "'), e.event_type, F.lit('", "props": '), e.props, F.lit(' , "odd":[ true,null , {"n": '), (e.event_id % 9).cast("string"), F.lit("}, [ ] ]}"))
    return e.select("event_id", parse(text, json_value())["value"].alias("value"))


# Layouts, schemas and values


@dataclasses.dataclass
class Described:
    """A record described by annotations alone."""

    key: Annotated[int, layout.be_u32]
    nation: Annotated[int, layout.u8]
    cents: Annotated[int, layout.le_i64]
    flag: Annotated[bool, layout.boolean()]
    pair: Annotated[list, layout.array(layout.le_u16, 2)]


@query("SELECT s_suppkey AS key, s_nationkey::INT AS nation, round(s_acctbal * 100)::BIGINT AS cents, s_suppkey % 2 = 1 AS flag, (s_suppkey % 100)::INT AS first, (s_nationkey + 1)::INT AS second FROM supplier")
def described_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout from annotations; its fields are assigned in Python and decoded by Catalyst."""
    record = Layout.of(Described)
    s = table(spark, sf_dir, "supplier")

    def pack(keys: pa.Array, nations: pa.Array, cents: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), nations.to_pylist(), cents.to_pylist(), strict=True)
        return pa.array([record.pack({"key": k, "nation": n, "cents": c, "flag": k % 2 == 1, "pair": [k % 100, n + 1]}) for k, n, c in rows], pa.binary())

    b = s.select(F.arrow_udf(pack, "binary")("s_suppkey", "s_nationkey", F.round(s.s_acctbal * 100).cast("long")).alias("b"))
    r = b.select(record.decode(b.b).alias("r"))
    return r.select("r.key", F.col("r.nation").cast("int").alias("nation"), "r.cents", "r.flag", F.col("r.pair")[0].alias("first"), F.col("r.pair")[1].alias("second"))


@query("SELECT * FROM (VALUES ('src_port',0,16,'int'),('dst_port',16,16,'int'),('seq',32,32,'bigint'),('ack',64,32,'bigint'),('data_offset',96,4,'smallint'),('reserved',100,3,'smallint'),('flags',103,9,'int'),('window',112,16,'int'),('checksum',128,16,'int'),('urgent',144,16,'int')) t(field, bit, bits, type)")
def layout_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema_of, columns_of and the bit offsets of a record."""
    tcp, kinds = pr.TCP, pr.TCP.schema()
    rows = [(n, tcp.offsets[n], tcp[n].bits, kinds[n].dataType.simpleString()) for n in tcp.leaf_columns()]
    return spark.createDataFrame(rows, "field string, bit int, bits int, type string")


@query("""SELECT n_nationkey, format('{:02x}{:02x}ab{:02x}04{:02x}{:02x}00', 2 * n_nationkey, 2 * n_regionkey, n_regionkey, 2 * n_nationkey, 2 * n_nationkey + 2) AS avro,
n_nationkey || ',' || n_regionkey || ',"ab' || format('{:02x}', n_regionkey) || '","[' || n_nationkey || ',' || (n_nationkey + 1) || ']"' AS csv FROM nation""")
def avro_and_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """avro_encode_row, depth first with zigzag integers, and csv_row."""
    n = table(spark, sf_dir, "nation")

    def values(key: int, region: int) -> dict:
        return {"key": key, "region": region, "tag": bytes([0xAB, region]), "pair": [key, key + 1]}

    def encode(keys: pa.Array, regions: pa.Array) -> pa.Array:
        rows = [values(k, r) for k, r in zip(keys.to_pylist(), regions.to_pylist(), strict=True)]
        return pa.array([{"avro": schemas.avro_row(NAMED, v).hex(), "csv": schemas.csv_row(NAMED, v)} for v in rows], pa.struct([("avro", pa.string()), ("csv", pa.string())]))

    return n.select("n_nationkey", F.arrow_udf(encode, "avro string, csv string")("n_nationkey", "n_regionkey").alias("r")).select("n_nationkey", "r.*")


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def ocf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro object container files of a table, written by tasks and read with the schema of their header; empty tables leave none."""
    spark.dataSource.register(ocf.Ocf)
    c = table(spark, sf_dir, "customer")
    (written,) = ocf.dump_tables({"customer": c.select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "none": c.limit(0)}, folder(spark))
    return spark.read.format("avro_ocf").load(written)


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as a stream of Arrow batches, as a consumer in Python takes it."""
    stream = export_stream(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10)
    return spark.createDataFrame(pa.Table.from_batches(list(stream), stream.schema))


# Files


_SIZES = "14 + CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END + 20 + CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 8 END + o_orderkey % 16"


def _written(spark: SparkSession, sf_dir: str, container: str) -> str:
    pcap.register(spark)
    path = folder(spark)
    packets = order_packets(spark, sf_dir).withColumn("ts_raw", F.col("packet_id") * (1 << 20)).withColumn("interface_id", F.col("packet_id") % 3)
    packets.write.format("pcap").option("container", container).option("byteOrder", "big" if container == "pcapng" else "little").mode("append").save(path)
    return path


@query(f"SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'tcp' ELSE 'udp' END AS proto, (o_custkey % 50 + 1000)::INT AS src_port, count(*) AS n, sum({_SIZES})::BIGINT AS bytes, sum(o_orderkey)::BIGINT AS stamps FROM orders GROUP BY 1, 2")
def pcap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classic captures, written by tasks, read whole, and walked: ports with lengths and timestamps."""
    packets = pcap.read_captures(spark, _written(spark, sf_dir, "pcap"))
    rows = Capture(packets, Options(reassembly=None)).union(["udp", "tcp"], ["src_port"], ["caplen", "ts_raw"])
    rows = rows.withColumnRenamed("table", "proto").withColumn("stamp", F.shiftright("ts_raw", 20))
    return rows.groupBy("proto", "src_port").agg(F.count(F.lit(1)).alias("n"), F.sum("caplen").alias("bytes"), F.sum("stamp").alias("stamps"))


@query(f"SELECT o_orderkey % 3 AS interface_id, 1::INT AS link_type, count(*) AS n, sum({_SIZES})::BIGINT AS bytes, sum(o_orderkey)::BIGINT AS stamps, (SELECT count(*) FROM orders) AS numbered FROM orders GROUP BY 1")
def pcapng_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pcapng of the other byte order in ranges of 64 KiB: blocks, interfaces and packet numbers over the cuts."""
    packets = pcap.scan_captures(spark, _written(spark, sf_dir, "pcapng"), 1 << 16)
    last = packets.groupBy("file").agg(F.max("packet_id").alias("last")).agg(F.sum(F.col("last") + 1).alias("numbered"))
    found = packets.groupBy("interface_id", "link_type").agg(F.count(F.lit(1)).alias("n"), F.sum("caplen").alias("bytes"), F.sum(F.shiftright("ts_raw", 20)).alias("stamps"))
    return found.join(F.broadcast(last))  # one row


@query(f"SELECT count(*) AS packets, sum({_SIZES})::BIGINT AS caplen, sum({_SIZES})::BIGINT AS origlen, 0::BIGINT AS options FROM orders")
def capture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of pcapng captures over a window that is refilled where a block is incomplete."""
    found = lines.totals(spark, _written(spark, sf_dir, "pcapng"), 4096)
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("packets", "caplen", "origlen", "options")))


@query(f"SELECT count(*) AS n, sum({_SIZES})::BIGINT AS bytes, count(DISTINCT o_orderkey) AS stamps FROM orders")
def pcap_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture as a stream: the packets of one file, read by tasks between offsets."""
    pcap.register(spark)
    path, out = folder(spark), folder(spark)
    packets = order_packets(spark, sf_dir).withColumn("ts_raw", F.col("packet_id") * (1 << 20))
    packets.coalesce(1).write.format("pcap").mode("append").save(path)
    (one,) = pcap._paths(path)
    stream = spark.readStream.format("pcap").option("splitBytes", 1 << 20).load(one)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark))
    query_ = writer.trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema("file string, " + pcap.SCHEMA).parquet(out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("caplen"), F.lit(0)).alias("bytes"), F.countDistinct("ts_raw").alias("stamps"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'big' ELSE 'little' END AS byte_order, 4096 * n_nationkey AS entry, n_regionkey::INT AS machine, i::INT AS segment, (n_nationkey * 1000 + i)::BIGINT AS offset FROM nation, range(3) t(i) WHERE i < n_regionkey % 3 + 1")
def elf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELF headers of either byte order and their program headers at a place that the header names."""
    contents = {}
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():  # a table of fixed size
        order, count = ("little", "big")[r.n_nationkey % 2 == 0], r.n_regionkey % 3 + 1
        head = {"magic": b"\x7fELF", "file_class": 2, "data": 2 if order == "big" else 1, "ident": bytes(10), "type": 2, "machine": r.n_regionkey, "version": 1, "entry": 4096 * r.n_nationkey, "phoff": 80, "shoff": 0, "flags": 0, "ehsize": 64, "phentsize": 56, "phnum": count, "shentsize": 0, "shnum": 0, "shstrndx": 0}
        segment = lambda i, key=r.n_nationkey: {"type": 1, "flags": 5, "offset": key * 1000 + i, "vaddr": 0, "paddr": 0, "filesz": 10, "memsz": 10, "align": 8}
        contents[f"n{r.n_nationkey}"] = files.ELF64.pack(head, order).ljust(80, b"\0") + b"".join(files.ELF64_SEGMENT.pack(segment(i), order) for i in range(count))
    path = folder(spark)
    put_files(path, contents)
    key = F.regexp_extract("path", "/n([0-9]+)$", 1).cast("int").alias("n_nationkey")
    heads = files.elf_headers(spark, path).select(key, F.col("entry").cast("int").alias("entry"), F.col("machine").cast("int").alias("machine"))
    segments = files.elf_segments(spark, path).select(key, F.col("order").alias("byte_order"), "segment", F.col("offset").cast("long").alias("offset"))
    return segments.join(heads, "n_nationkey")


@query("SELECT r_regionkey, 'N' || n_nationkey || '.T' AS name, n_nationkey::BIGINT AS size FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 <> 3")
def fat16_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of FAT16 images: an image for each region, an entry for each nation, of which some are deleted."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # a table of fixed size
    boot = files.FAT16_BOOT.pack({"jump": b"\xeb\0\x90", "oem": b"WIRELANE", "bytes_per_sector": 512, "sectors_per_cluster": 1, "reserved_sectors": 1, "fats": 2, "root_entries": 64, "total_sectors": 64, "media": 248, "sectors_per_fat": 1})

    def entry(key: int) -> bytes:
        name = f"N{key}".ljust(8).encode()
        return files.FAT16_ENTRY.pack({"name": b"\xe5" + name[1:] if key % 4 == 3 else name, "extension": b"T  ", "attributes": 32, "reserved": bytes(10), "time": 0, "date": 0, "cluster": 2, "size": key})

    path = folder(spark)
    regions = {r.n_regionkey for r in nations}
    put_files(path, {f"r{k}": boot.ljust(512 * 3, b"\0") + b"".join(entry(r.n_nationkey) for r in nations if r.n_regionkey == k).ljust(2048, b"\0") for k in regions})
    return files.fat16_directory(spark, path).select(F.regexp_extract("path", "/r([0-9]+)$", 1).cast("int").alias("r_regionkey"), "name", "size")


# Packets


def ipv6(key: Column, next_header: Column | int, body: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.concat(pr.IPV6.encode({"version": F.lit(6), "traffic_class": F.lit(0), "flow_label": key, "payload_length": F.octet_length(body), "next_header": lit(next_header), "hop_limit": F.lit(9), "src": F.concat(zeros(F.lit(8)), be(key, 8)), "dst": zeros(F.lit(16))}), body)


@query("SELECT s_suppkey AS packet_id, (s_suppkey % 1000 + 1)::INT AS src_port, [0, 3, 3, 4][(s_suppkey % 4 + 1)::INT]::INT AS extra, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ipv6.hop_by_hop,ipv6.option,ipv6.option' WHEN 2 THEN 'ipv6.routing,ipv6.srh_segment,ipv6.srh_segment' ELSE 'ipv6.dest_opts,ipv6.option,ipv6.ah,ipv6.fragment_hdr' END AS names FROM supplier")
def ipv6_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over IPv6 extension headers: options, segments, authentication and a fragment header of a whole datagram."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    ports = udp(k % 1000 + 1, F.lit(99), zeros(F.lit(3)))
    hop = F.concat(F.unhex(F.lit("1100" + "1E02AABB" + "0100")), ports)
    srh = F.concat(F.unhex(F.lit("1104040101000000")), zeros(F.lit(32)), ports)
    chain = F.concat(F.unhex(F.lit("3300" + "1E04AABBCCDD" + "2C040000" + "0000000700000008" + "000000000000000000000000" + "1100000000000009")), ports)
    kind = k % 4
    body = F.when(kind == 0, ports).when(kind == 1, hop).when(kind == 2, srh).otherwise(chain)
    head = F.when(kind == 0, 17).when(kind == 1, 0).when(kind == 2, 43).otherwise(60)
    packets = as_packets(s, "suppliers", k, frame(k, F.lit(0x86DD), ipv6(k, head, body)))
    rows = Capture(packets, Options(reassembly=None)).layers("udp", "extra")
    return rows.select("packet_id", F.col("layers.udp")[0]["src_port"].alias("src_port"), F.size("layers.extra").alias("extra"), F.array_join(F.transform("layers.extra", lambda x: x["name"]), ",").alias("names"))


def _fragments(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Two fragments of a datagram for each supplier, the second first, far from those of others."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    data = udp(k % 1000 + 1, F.lit(77), zeros(k % 20 + 8))
    parts = s.select(k.alias("k"), data.alias("b")).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    late = F.col("i") == 0
    body = F.when(late, F.substring("b", F.lit(17), F.octet_length("b") - 16)).otherwise(F.substring("b", 1, 16))
    key = F.col("k")
    if version == 4:
        packet = frame(key, F.lit(0x800), ipv4(key, F.lit(1), 17, key % 65536, F.when(late, 2).otherwise(0), ~late, body))
    else:
        head = pr.IPV6_FRAGMENT.encode({"next_header": F.lit(17), "reserved": F.lit(0), "offset_flags": F.when(late, 16).otherwise(1), "identification": key})
        packet = frame(key, F.lit(0x86DD), ipv6(key, pr.FRAGMENT, F.concat(head, body)))
    return as_packets(parts, "suppliers", F.col("k") * 50 + F.col("i"), packet)


_DATAGRAMS = "SELECT s_suppkey * 50 AS first_packet_id, s_suppkey * 50 + 1 AS last_packet_id, {v}::INT AS ip_version, (s_suppkey % 20 + 16)::BIGINT AS total_length, row_number() OVER (ORDER BY s_suppkey) AS datagram_id, (s_suppkey % 1000 + 1)::INT AS src_port FROM supplier"


def _reassembled(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    c = Capture(_fragments(spark, sf_dir, version))
    ports = c.table("udp").where("is_reassembled").select("file", F.col("packet_id").alias("last_packet_id"), "datagram_id", "src_port")
    found = c.table("datagram").where("completion_status = 0").join(ports, ["file", "last_packet_id", "datagram_id"])
    return found.select("first_packet_id", "last_packet_id", "ip_version", "total_length", "datagram_id", "src_port")


@query(_DATAGRAMS.format(v=6))
def defrag_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reassembly by IPv6 fragment headers, and the ports of the whole datagram."""
    return _reassembled(spark, sf_dir, 6)


@query(_DATAGRAMS.format(v=4))
def defrag_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reassembled(spark, sf_dir, 4)


@query("SELECT s_suppkey * 50 + i AS packet_id, v::INT AS version, CASE WHEN i = 0 THEN 16 ELSE 0 END::BIGINT AS at, i = 1 AS more, i = 1 AS is_first, i = 0 AS is_last, row_number() OVER (PARTITION BY v, i ORDER BY s_suppkey) AS datagram_id FROM supplier, range(2) t(i), (VALUES (4), (6)) u(v)")
def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of both versions with their datagrams."""
    rows = [Capture(_fragments(spark, sf_dir, v)).table(f"ipv{v}_frag").withColumn("version", F.lit(v)) for v in (4, 6)]
    return rows[0].unionByName(rows[1]).select("packet_id", "version", F.col("frag_offset_bytes").alias("at"), F.col("more_fragments").alias("more"), "is_first", "is_last", "datagram_id")


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END::INT AS completion_status, count(*) AS n, sum(o_orderkey * 50)::BIGINT AS first_packets FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def stream_defrag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reassembly of a stream of fragments, its state held by key until a datagram is complete."""
    path, out = folder(spark), folder(spark)
    parts = broken_fragments(spark, sf_dir)
    parts.write.parquet(path)
    stream = reassemble_stream(spark.readStream.schema(parts.schema).parquet(path), defrag.Config())
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark)).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out).where("completion_status = 0")
    return found.groupBy("completion_status").agg(F.count(F.lit(1)).alias("n"), F.sum("first_packet_id").alias("first_packets"))


def _someip_frame(key: Column, port: int, message: Column) -> Column:
    return frame(key, F.lit(0x800), ipv4(key, F.lit(1), 17, F.lit(0), F.lit(0), F.lit(False), udp(F.lit(port), F.lit(port), message)))


@query("""SELECT s_suppkey AS packet_id, 'entry' AS what, i::INT AS place, i::INT AS kind, (CASE WHEN i = 0 THEN 0 ELSE s_suppkey END)::BIGINT AS value, (s_suppkey % 65536)::INT AS service FROM supplier, range(2) t(i)
UNION ALL SELECT s_suppkey, 'option', 0, 4, s_suppkey, (30000 + s_suppkey % 1000)::INT FROM supplier""")
def someip_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service discovery: a find and an offer entry with its time to live, and an endpoint option with address and port."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    entry = lambda kind, ttl: pr.SD_ENTRY.encode({"type": F.lit(kind), "index_1st_opts": F.lit(0), "index_2nd_opts": F.lit(0), "num_opt_1": F.lit(kind), "num_opt_2": F.lit(0), "service_id": k, "instance_id": F.lit(1), "major_version": F.lit(1), "ttl": ttl, "minor_version": F.lit(0)})
    option = F.concat(F.unhex(F.lit("00090400")), be(k, 4), F.unhex(F.lit("0011")), be(k % 1000 + 30000, 2))
    body = F.concat(zeros(F.lit(4)), be(F.lit(32), 4), entry(0, F.lit(0)), entry(1, k), be(F.lit(12), 4), option)
    head = pr.SOMEIP.encode({"service_id": F.lit(0xFFFF), "method_id": F.lit(0x8100), "length": F.octet_length(body) + 8, "client_id": F.lit(0), "session_id": F.lit(1), "protocol_version": F.lit(1), "interface_version": F.lit(1), "message_type": F.lit(2), "return_code": F.lit(0)})
    c = Capture(as_packets(s, "suppliers", k, _someip_frame(k, 30490, F.concat(head, body))))
    entries = c.table("someip_sd_entry").select("packet_id", F.lit("entry").alias("what"), F.col("entry_index").cast("int").alias("place"), F.col("body.type").cast("int").alias("kind"), F.col("body.ttl").alias("value"), F.col("body.service_id").alias("service"))
    address = F.conv(F.hex(F.substring("address", 1, 4)), 16, 10).cast("long")
    options = c.table("someip_sd_option").where("l4proto = 17").select("packet_id", F.lit("option").alias("what"), F.col("option_index").cast("int").alias("place"), F.col("type").cast("int").alias("kind"), address.alias("value"), F.col("port").alias("service"))
    return entries.unionByName(options)


@query("""SELECT o_orderkey AS packet_id, ['sync', 'delay_req', 'pdelay_req', 'pdelay_resp', 'delay_resp', 'pdelay_resp_follow_up', 'follow_up'][(o_orderkey % 7 + 1)::INT] AS kind, o_orderkey AS seconds, 5::BIGINT AS nanoseconds,
CASE WHEN o_orderkey % 7 BETWEEN 3 AND 5 THEN (o_custkey % 65536)::INT WHEN o_orderkey % 7 = 6 THEN (-o_custkey)::INT END AS more FROM orders""")
def gptp_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All message kinds with a timestamp, the requesting port of responses, and the rate offset of a follow-up's information."""
    o = table(spark, sf_dir, "orders")
    kinds = [("sync", 0, "origin_timestamp"), ("delay_req", 1, "origin_timestamp"), ("pdelay_req", 2, "origin_timestamp"), ("pdelay_resp", 3, "request_receipt_timestamp"), ("delay_resp", 9, "receive_timestamp"), ("pdelay_resp_follow_up", 10, "response_origin_timestamp"), ("follow_up", 8, "precise_origin_timestamp")]
    which = (o.o_orderkey % 7).cast("int")
    code = F.element_at(F.array(*(F.lit(c) for _, c, _ in kinds)), which + 1)
    information = F.concat(F.unhex(F.lit("0003001C0080C2000001")), be(-o.o_custkey, 4), zeros(F.lit(18)))
    tail = F.when(which.between(3, 5), F.concat(zeros(F.lit(8)), be(o.o_custkey, 2))).when(which == 6, information).otherwise(zeros(F.lit(0)))
    body = F.concat(be(o.o_orderkey, 6), be(F.lit(5), 4), tail)
    head = F.concat(be(code + 16, 1), F.unhex(F.lit("02")), be(F.octet_length(body) + 34, 2), zeros(F.lit(30)))
    c = Capture(as_packets(o, "orders", o.o_orderkey, frame(o.o_custkey, F.lit(0x88F7), F.concat(head, body))))
    parts = []
    for kind, _, stamp in kinds:
        more = F.col("cumulative_scaled_rate_offset") if kind == "follow_up" else F.col("requesting_port_identity.port_number") if "resp" in kind else F.lit(None).cast("int")
        parts.append(c.table(f"gptp_{kind}").select("packet_id", F.lit(kind).alias("kind"), F.col(f"{stamp}_seconds").alias("seconds"), F.col(f"{stamp}_nanoseconds").alias("nanoseconds"), more.alias("more")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RULES = """
udp.dst_port == 5001 => someip_tlv udp_payload "members"
udp.dst_port == 5002 => oddtlv someip_payload "elements"
vlan.vid >= 2000 => lldp vlan_payload "units"
"""


@query("""SELECT s_suppkey AS packet_id, (s_suppkey % 3)::BIGINT AS rule_id, i::BIGINT AS place,
CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey % 4096) WHEN 1 THEN 33 ELSE 5 END::INT AS id FROM supplier, range(2) t(i)""")
def rules_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by rule: tagged members, elements of a member, and LLDP units under a VLAN tag."""
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    member = F.concat(be(k % 4096, 2), zeros(F.lit(1)))
    element = F.unhex(F.lit("10210708"))
    odd = F.concat(F.unhex(F.lit("6044" + "000C" + "00040002")), element, element)
    head = pr.SOMEIP.encode({"service_id": F.lit(1), "method_id": F.lit(2), "length": F.octet_length(odd) + 8, "client_id": F.lit(0), "session_id": F.lit(0), "protocol_version": F.lit(1), "interface_version": F.lit(1), "message_type": F.lit(0), "return_code": F.lit(0)})
    tag = pr.VLAN.encode({"pcp": F.lit(0), "dei": F.lit(0), "vid": k % 1000 + 2000, "inner_ethertype": F.lit(0x88CC)})
    units = F.unhex(F.lit("0A026162" + "0A0163" + "0000"))
    datagram = lambda port, body: frame(k, F.lit(0x800), ipv4(k, F.lit(1), 17, F.lit(0), F.lit(0), F.lit(False), udp(F.lit(9), F.lit(port), body)))
    data = F.when(k % 3 == 0, datagram(5001, F.concat(member, member))).when(k % 3 == 1, datagram(5002, F.concat(head, odd))).otherwise(frame(k, F.lit(0x8100), F.concat(tag, units)))
    tables = rules.run_rules(as_packets(s, "suppliers", k, data), rules.parse_rules(RULES))
    named = {"someip_tlv": ("tlv_index", "data_id"), "oddtlv": ("elem_index", "elem_data_id"), "lldp": ("tlv_index", "tlv_type")}
    parts = [tables[t].select("packet_id", "rule_id", F.col(place).cast("long").alias("place"), F.col(value).cast("int").alias("id")) for t, (place, value) in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FRAME = """format('{:012x}', k) AS dst, format('{:012x}', k + 1) AS src, 14 + 20 + 8 + k % 16 AS size, k % 1000 + 1 AS port, format('{:08x}', k) AS ip FROM (SELECT s_suppkey AS k FROM supplier)"""


def _supplier_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = s.s_suppkey
    return as_packets(s, "suppliers", k, frame(k, F.lit(0x800), ipv4(k, F.lit(1), 17, F.lit(0), F.lit(0), F.lit(False), udp(k % 1000 + 1, F.lit(77), zeros(k % 16)))))


@query(f"""SELECT k AS packet_id, '{{"_index":' || k || ',"_source":{{"layers":{{"frame":{{"interface_id":0,"timestamp_raw":0,"caplen":' || size || ',"origlen":' || size || ',"link_type":1}},"eth":{{"dst":"' || dst || '","src":"' || src || '","ethertype":2048}},"ip":{{"version":4,"ihl":5,"dscp":0,"ecn":0,"total_length":' || (size - 14) || ',"identification":0,"flags":0,"frag_offset":0,"ttl":64,"protocol":17,"checksum":0,"src":"' || ip || '","dst":"00000001"}},"udp":{{"src_port":' || port || ',"dst_port":77,"length":' || (size - 34) || ',"checksum":0}}}}}}}}' AS line FROM (SELECT k, {_FRAME})""")
def capture_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each packet, its layers decoded from the bytes and in their order."""
    return Capture(_supplier_packets(spark, sf_dir)).json().select("packet_id", "line")


@query(f"""SELECT k AS packet_id, '{{"packet_id":' || k || ',"interface_id":0,"timestamp_raw":0,"caplen":' || size || ',"origlen":' || size || ',"link_type":1,"layers":[{{"type":"ethernet","dst":"' || regexp_replace(dst, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') || '","src":"' || regexp_replace(src, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') || '","ethertype":"0x0800"}},{{"type":"ipv4","src":"' || (k // 16777216) || '.' || (k // 65536 % 256) || '.' || (k // 256 % 256) || '.' || (k % 256) || '","dst":"0.0.0.1","protocol":17,"ttl":64,"total_length":' || (size - 14) || '}},{{"type":"udp","src_port":' || port || ',"dst_port":77}}]}}' AS line FROM (SELECT k, {_FRAME})""")
def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat line for each packet, with readable addresses."""
    return lines.packet_lines(_supplier_packets(spark, sf_dir)).select("packet_id", "line")


@query("SELECT (CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 17 END)::INT AS protocol, CASE WHEN o_orderkey % 2 = 0 THEN 33024 ELSE 2048 END::INT AS eth_type, count(*) AS n, sum(o_orderkey % 20 + 30480)::BIGINT AS dst_ports FROM orders GROUP BY 1, 2")
def bulk_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bulk_decode: a kernel per packet fills columns, and the rows that it took are counted."""
    rows = bulk.bulk_decode(order_packets(spark, sf_dir), bulk.flow, bulk.FLOW).rows
    return rows.groupBy(F.col("protocol").cast("int").alias("protocol"), "eth_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dst_port").cast("long")).alias("dst_ports"))
