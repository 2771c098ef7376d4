"""The registered queries over the driver's tables, and the same in SQL.

Most queries encode a table's columns to bytes with Catalyst expressions and decode them with the
operator that they show, so the SQL over the plain columns is independent of both halves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.functions import schemas
from wirelane.operators import defrag, layout, parsers, protocols, rules
from wirelane.operators.layout import Layout, ibits, le_u16, le_u32, raw, u8, ubits, uint
from wirelane.operators.run import lower, parse
from wirelane.plans.capture import Capture, Options, fold_layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Tables of fewer bytes are not worth dealing out.
SPREAD_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if it has fewer splits than there are cores: a row's decoding costs far more than the row. Large tables are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(cores, df.columns[0])


def be(value: Column, n: int) -> Column:
    """The low n bytes of an integer, most significant first."""
    return Layout("bytes", [("x", uint(8 * n))]).encode({"x": value})


def blob(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


_LINK = Layout("Link", [("dst", layout.be_u48), ("src", layout.be_u48), ("ethertype", layout.be_u16)])


def frame(key: Column, ethertype: Column, body: Column) -> Column:
    """An Ethernet frame whose addresses hold a key."""
    return F.concat(_LINK.encode({"dst": key, "src": key + 1, "ethertype": ethertype}), body)


def as_packets(rows: DataFrame, file: str, packet_id: Column, data: Column) -> DataFrame:
    """The rows of a capture from rows with a frame each.

    The frame is an element of a list that is taken out again, so that it is made once, and not in each expression that reads it.
    """
    made = rows.select(packet_id.cast("long").alias("packet_id"), F.explode(F.array(data)).alias("payload"))
    size, none = F.octet_length("payload").cast("long"), F.lit(0).cast("long")
    return made.select(F.lit(file).alias("file"), "packet_id", none.alias("file_offset"), none.alias("interface_id"), F.lit(1).alias("link_type"), none.alias("ts_raw"), size.alias("caplen"), size.alias("origlen"), "payload")


def ipv4(src: Column, dst: Column, proto: Column | int, ident: Column, offset_units: Column, more: Column, body: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    head = protocols.IPV4.encode({
        "version": F.lit(4), "ihl": F.lit(5), "dscp": F.lit(0), "ecn": F.lit(0), "total_length": F.octet_length(body) + 20, "identification": ident,
        "flags": more.cast("int"), "frag_offset": offset_units, "ttl": F.lit(64), "protocol": lit(proto), "checksum": F.lit(0), "src": be(src, 4), "dst": be(dst, 4),
    })
    return F.concat(head, body)


def udp(src: Column, dst: Column, body: Column) -> Column:
    return F.concat(protocols.UDP.encode({"src_port": src, "dst_port": dst, "length": F.octet_length(body) + 8, "checksum": F.lit(0)}), body)


# Layouts

LINEITEM = Layout("Lineitem", [("orderkey", layout.be_u48), ("partkey", le_u32), ("suppkey", layout.be_i64), ("linenumber", u8), ("quantity", layout.le_i16)])


@query("SELECT l_orderkey::BIGINT AS orderkey, l_partkey::BIGINT AS partkey, l_suppkey::BIGINT AS suppkey, l_linenumber::INT AS linenumber, l_quantity::INT AS quantity FROM lineitem")
def strct_roundtrip_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strct: big- and little-endian integers of several widths, there and back."""
    rows = table(spark, sf_dir, "lineitem")
    data = rows.select(LINEITEM.encode({"orderkey": rows.l_orderkey, "partkey": rows.l_partkey, "suppkey": rows.l_suppkey, "linenumber": rows.l_linenumber, "quantity": rows.l_quantity.cast("int")}).alias("b"))
    r = data.select(LINEITEM.decode(F.col("b")).alias("r"))
    return r.select("r.orderkey", "r.partkey", "r.suppkey", F.col("r.linenumber").cast("int").alias("linenumber"), F.col("r.quantity").cast("int").alias("quantity"))


ORDER = Layout("Order", [("orderkey", layout.be_u64), ("custkey", le_u32), ("cents", layout.be_u48), ("status", raw(1)), ("pad", raw(16))])


@query("SELECT o_custkey % 7 AS bucket, count(*) AS n, max(o_custkey) AS most FROM orders GROUP BY 1")
def overlay_prune_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlay: one field of a wide record is decoded, the others are not."""
    o = table(spark, sf_dir, "orders")
    b = o.select(ORDER.encode({"orderkey": o.o_orderkey, "custkey": o.o_custkey, "cents": F.round(o.o_totalprice * 100).cast("long"), "status": blob(o.o_orderstatus), "pad": zeros(F.lit(16))}).alias("b"))
    key = ORDER.view(b.b)["custkey"]
    return b.select(key.alias("k")).groupBy((F.col("k") % 7).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most"))


@query("SELECT p_partkey, (p_size & 7)::INT AS pcp, (p_partkey & 1)::INT AS dei, (p_partkey & 4095)::INT AS vid FROM part")
def bitfields_vlan_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ubits, most significant bit first."""
    part = table(spark, sf_dir, "part")
    b = part.select("p_partkey", protocols.VLAN.encode({"pcp": part.p_size, "dei": part.p_partkey, "vid": part.p_partkey, "inner_ethertype": F.lit(0x800)}).alias("b"))
    v = protocols.VLAN.view(b.b)
    return b.select("p_partkey", *(v[n].cast("int").alias(n) for n in ("pcp", "dei", "vid")))


FLAGS = Layout("Flags", [("read_only", ubits(1, "lsb0")), ("hidden", ubits(1, "lsb0")), ("level", ubits(6, "lsb0"))])


@query("SELECT (s_suppkey & 1)::INT AS read_only, ((s_suppkey >> 1) & 1)::INT AS hidden, count(*) AS n, sum((s_suppkey >> 2) & 63)::BIGINT AS levels FROM supplier GROUP BY 1, 2")
def lsb0_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit fields, least significant bit first."""
    s = table(spark, sf_dir, "supplier")
    v = FLAGS.view(F.col("b"))
    b = s.select(be(s.s_suppkey, 1).alias("b")).select(*(v[n].cast("int").alias(n) for n in ("read_only", "hidden", "level")))
    return b.groupBy("read_only", "hidden").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels"))


SIGNED = Layout("Signed", [("small", ibits(4)), ("rest", ibits(12))])


@query("SELECT n_nationkey, (n_regionkey - 2)::INT AS small, (100 - n_nationkey * 40)::INT AS rest FROM nation")
def ibits_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed bit fields are sign-extended."""
    n = table(spark, sf_dir, "nation")
    b = n.select("n_nationkey", SIGNED.encode({"small": n.n_regionkey - 2, "rest": 100 - n.n_nationkey * 40}).alias("b"))
    v = SIGNED.view(b.b)
    return b.select("n_nationkey", v["small"].cast("int").alias("small"), v["rest"].cast("int").alias("rest"))


def _pack_doubles(code: str) -> Column:
    def run(x: pa.Array) -> pa.Array:
        data = x.to_numpy(zero_copy_only=False).astype(code).tobytes()
        return pa.array([data[i : i + 8] for i in range(0, len(data), 8)], pa.binary())

    return F.arrow_udf(run, "binary")


FLOATS = Layout("Floats", [("a", layout.be_f64), ("b", layout.le_f64)])


@query("SELECT o_orderkey, o_totalprice AS big, o_totalprice AS little FROM orders")
def be_f64_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """be_f64 and le_f64: bit patterns made by the kernel, decoded by Catalyst arithmetic."""
    o = table(spark, sf_dir, "orders")
    b = o.select("o_orderkey", F.concat(_pack_doubles(">f8")(o.o_totalprice), _pack_doubles("<f8")(o.o_totalprice)).alias("b"))
    v = FLOATS.view(b.b)
    return b.select("o_orderkey", v["a"].alias("big"), v["b"].alias("little"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def f32_array_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """many1(le_f32) in the kernel: vectors to bytes and back."""
    e = table(spark, sf_dir, "embeddings")

    def pack(column: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v, "<f4").tobytes() for v in column.to_pylist()], pa.binary())

    got = parse(F.arrow_udf(pack, "binary")(e.embedding), parsers.all_consuming(parsers.many1(parsers.le_f32)))
    r = e.select("vec_id", got["value"].alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return r.select("vec_id", F.size("v").alias("n"), F.round(total, 6).alias("total"))


# Text parsers


@query("SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer")
def tag_dec_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preceded(tag, dec), as Catalyst expressions."""
    c = table(spark, sf_dir, "customer")
    got = lower(parsers.all_consuming(parsers.preceded(parsers.tag("Customer#"), parsers.dec(64))), blob(c.c_name))
    return c.where(got.ok).select("c_custkey", got.value.alias("number"))


@query("SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS rank, split_part(o_orderpriority, '-', 2) AS name FROM orders")
def separated_pair_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = parsers.separated_pair(parsers.dec(32), parsers.chr_("-"), parsers.take_while1(lambda b: True).text())
    got = lower(p, blob(o.o_orderpriority))
    v = got.value
    return o.where(got.ok).select("o_orderkey", v["_1"].cast("int").alias("rank"), v["_2"].alias("name"))


@query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 100 + CAST(substr(p_brand, 7) AS BIGINT) WHEN p_brand LIKE 'Brand#%' THEN CAST(substr(p_brand, 7) AS BIGINT) ELSE -1 END AS code FROM part")
def alt_brand_or_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alt and map in the kernel: the first alternative that succeeds."""
    part = table(spark, sf_dir, "part")
    ones = parsers.map_(parsers.preceded(parsers.tag("Brand#"), parsers.verify(parsers.dec(32), lambda n: str(n).startswith("1"))), lambda n: 100 + n, "bigint")
    rest = parsers.preceded(parsers.tag("Brand#"), parsers.map_(parsers.dec(32), lambda n: n, "bigint"))
    got = parse(part.p_brand, parsers.alt(ones, rest, parsers.success(-1)))
    return part.select("p_partkey", got["value"].alias("code"))


def json_grammar() -> parsers.Parser:
    """JSON, with white space; the value as text of its numbers' sum, for objects of numbers: a grammar that contains itself."""
    p = parsers
    ws = p.multispace0
    spaced = lambda x: p.delimited(ws, x, ws)
    text = p.delimited(p.chr_('"'), p.take_till('"').text(), p.chr_('"'))
    value = p.lazy(lambda: spaced(p.alt(number, quoted, array, record, p.value(0.0, p.alt(p.tag("true"), p.tag("false"), p.tag("null"))))), "double")
    number = p.double_
    quoted = p.value(0.0, text)
    array = p.map_(p.delimited(p.chr_("["), p.separated_list0(p.chr_(","), value), p.cut(p.chr_("]"))), sum, "double")
    member = p.separated_pair(spaced(text), p.chr_(":"), value)
    record = p.map_(p.delimited(p.chr_("{"), p.separated_list0(p.chr_(","), member), p.cut(p.chr_("}"))), lambda kv: float(sum(v for _, v in kv)), "double")
    return p.all_consuming(value)


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = e.select("event_type", parse(e.props, json_grammar())["value"].alias("k"))
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("long")).alias("total"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '[?]([^#]*)', 1) END AS query FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+')")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """take_while1, tag, is_not, take_till and opt over URLs, as Catalyst expressions."""
    p = parsers
    url = p.seq(p.take_while1("abcdefghijklmnopqrstuvwxyz").text(), p.tag("://"), p.is_not("/?#").text(), p.take_till("?#").text(), p.opt(p.preceded(p.chr_("?"), p.take_till("#").text())))
    pages = table(spark, sf_dir, "pages")
    got = lower(url, blob(pages.url))
    r = pages.where(got.ok).select("page_id", got.value.alias("v"))
    return r.select("page_id", F.col("v._1").alias("scheme"), F.col("v._3").alias("host"), F.col("v._4").alias("path"), F.col("v._5").alias("query"))


_BLANK = " \t\n\r"


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def many0_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold_many0 of words between white space, over whole texts."""
    p = parsers
    word = p.preceded(p.multispace0, p.take_till1(_BLANK))
    words = p.terminated(p.fold_many0(word, lambda: 0, lambda n, _: n + 1, "bigint"), p.multispace0)
    d = table(spark, sf_dir, "documents")
    return d.where("text is not null").select("doc_id", parse(d.text, p.all_consuming(words))["value"].alias("words"))


@query("""SELECT conv_id, turn, CASE WHEN NOT contains(rest, chr(13)) THEN len(string_split(rest, chr(10))) END::INT AS lines,
CASE WHEN NOT contains(rest, chr(13)) THEN list_max(list_transform(string_split(rest, chr(10)), lambda x: strlen(x))) END::INT AS longest
FROM (SELECT conv_id, turn, replace(text, chr(13) || chr(10), chr(10)) AS rest FROM conversations WHERE text IS NOT NULL)""")
def lines_not_line_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """not_line_ending and line_ending in the kernel; a carriage return that ends no line is an error, and its message's result null."""
    p = parsers
    size = p.map_(p.recognize(p.not_line_ending), len, "int")
    c = table(spark, sf_dir, "conversations").where("text is not null")
    # A line may be empty, so each but the last is taken with its ending.
    lines = p.pair(p.many0(p.terminated(size, p.line_ending)), size)
    r = c.select("conv_id", "turn", parse(c.text, p.all_consuming(lines))["value"].alias("v"))
    every = F.concat("v._1", F.array("v._2"))
    return r.select("conv_id", "turn", F.when(every.isNotNull(), F.size(every)).alias("lines"), F.array_max(every).alias("longest"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def verify_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify: a record is kept where a predicate holds, in Catalyst."""
    rows = table(spark, sf_dir, "lineitem")
    data = rows.select(F.concat(be(rows.l_quantity.cast("int"), 2), blob(rows.l_returnflag)).alias("b"))
    got = lower(parsers.seq(parsers.verify(parsers.be_u16, lambda n: n > 25), parsers.take(1).text()), data.b)
    return data.where(got.ok).select(got.value["_2"].alias("l_returnflag")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, max(CAST(split_part(split_part(props, ':', 2), '}', 1) AS BIGINT)) AS most FROM events GROUP BY 1")
def take_till_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """take_till up to a colon, then is_a digits, in Catalyst."""
    p = parsers
    e = table(spark, sf_dir, "events")
    got = lower(p.preceded(p.seq(p.take_till(":"), p.chr_(":"), p.space0), p.is_a(p.DIGIT).text()), blob(e.props))
    return e.where(got.ok).select("event_type", got.value.cast("long").alias("k")).groupBy("event_type").agg(F.max("k").alias("most"))


@query("SELECT s_suppkey, s_suppkey * 31 AS number FROM supplier")
def hex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    b = s.select("s_suppkey", blob(F.concat(F.lit("0x"), F.lower(F.hex(s.s_suppkey * 31)), F.lit(";"))).alias("b"))
    got = lower(parsers.delimited(parsers.tag_no_case("0X"), parsers.hex_(32), parsers.chr_(";")), b.b)
    return b.where(got.ok).select("s_suppkey", got.value.alias("number"))


@query("SELECT s_suppkey, s_acctbal AS balance FROM supplier")
def double_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    b = s.select("s_suppkey", blob(s.s_acctbal.cast("string")).alias("b"))
    got = lower(parsers.all_consuming(parsers.double_), b.b)
    return b.where(got.ok).select("s_suppkey", got.value.alias("balance"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey::INT AS region FROM nation")
def permutation_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permutation: key=value pairs in any order."""
    p = parsers
    n = table(spark, sf_dir, "nation")
    parts = [F.concat(F.lit("name="), n.n_name, F.lit(";")), F.concat(F.lit("region="), n.n_regionkey.cast("string"), F.lit(";"))]
    text = F.when(n.n_nationkey % 2 == 0, F.concat(parts[0], parts[1])).otherwise(F.concat(parts[1], parts[0]))
    name = p.delimited(p.tag("name="), p.take_till(";").text(), p.chr_(";"))
    region = p.delimited(p.tag("region="), p.dec(32), p.chr_(";"))
    got = parse(text, p.all_consuming(p.permutation(name, region)))["value"]
    return n.select("n_nationkey", got["_1"].alias("name"), got["_2"].cast("int").alias("region"))


# Type-length-value units


@query("SELECT o_orderkey, (o_orderkey % 5 + i)::INT AS kind, (o_orderkey % 4 + i)::INT AS size FROM orders, range(3) t(i)")
def tlv_many0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """many0 of [type][length][value], one row per unit."""
    p = parsers
    o = table(spark, sf_dir, "orders")
    unit = lambda i: F.concat(be(o.o_orderkey % 5 + i, 1), be(o.o_orderkey % 4 + i, 1), zeros(o.o_orderkey % 4 + i))
    b = o.select("o_orderkey", F.concat(unit(0), unit(1), unit(2)).alias("b"))
    units = p.many0(p.map_(p.pair(p.u8, p.length_data(p.u8)), lambda v: (v[0], len(v[1])), "struct<_1: int, _2: int>"))
    r = b.select("o_orderkey", F.explode(parse(b.b, units)["value"]).alias("u"))
    return r.select("o_orderkey", F.col("u._1").alias("kind"), F.col("u._2").alias("size"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def length_value_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """length_value around two length_data, in Catalyst."""
    p = parsers
    c = table(spark, sf_dir, "customer")
    one = lambda x: F.concat(be(F.octet_length(x), 1), x)
    inner = F.concat(one(blob(c.c_name)), one(blob(c.c_mktsegment)))
    b = c.select("c_custkey", F.concat(be(F.octet_length(inner), 2), inner).alias("b"))
    got = lower(p.all_consuming(p.length_value(p.be_u16, p.pair(p.length_data(p.u8).text(), p.length_data(p.u8).text()))), b.b)
    return b.where(got.ok).select("c_custkey", got.value["_1"].alias("name"), got.value["_2"].alias("segment"))


@query("SELECT p_partkey, p_size::BIGINT AS a, (p_partkey & 31) AS b FROM part")
def take_bits_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bits, tag_bits and take_bits in the kernel."""
    p = parsers
    part = table(spark, sf_dir, "part")
    word = F.shiftleft(F.lit(5).cast("long"), 13).bitwiseOR(F.shiftleft(part.p_size.cast("long"), 5)).bitwiseOR(part.p_partkey.bitwiseAND(F.lit(31)))
    grammar = p.bits(p.bseq(p.tag_bits(5, 3), p.take_bits(8), p.take_bits(5)))
    got = parse(be(word, 2), grammar)["value"]
    return part.select("p_partkey", got["_2"].alias("a"), got["_3"].alias("b"))


@query("SELECT n_nationkey, 'err' AS kind, 3::BIGINT AS at, 'tag' AS expected FROM nation")
def error_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that got furthest among alternatives, with its place."""
    p = parsers
    n = table(spark, sf_dir, "nation")
    grammar = p.context("name", p.alt(p.pair(p.tag("NAT"), p.tag("x")), p.pair(p.tag("N"), p.tag("y"))))
    e = parse(n.n_name, grammar)["error"]
    return n.select("n_nationkey", e["kind"].alias("kind"), e["offset"].alias("at"), e["expected"].alias("expected"))


@query("SELECT s_suppkey, 'incomplete' AS kind, (4 - s_suppkey % 4)::BIGINT AS needed FROM supplier WHERE s_suppkey % 4 > 0")
def streaming_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On streaming input a short buffer tells how many bytes are missing."""
    s = table(spark, sf_dir, "supplier")
    got = parse(zeros(s.s_suppkey % 4), parsers.be_u32, streaming=True)
    r = s.where("s_suppkey % 4 > 0").select("s_suppkey", got["error"].alias("e"))
    return r.select("s_suppkey", F.col("e.kind").alias("kind"), F.col("e.needed").alias("needed"))


# Packets


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event: addresses from the user, ethertype from the type, event_id % 64 bytes of payload."""
    e = table(spark, sf_dir, "events")
    data = frame(e.user_id, F.lit(0x0600) + F.ascii(e.event_type), zeros(e.event_id % 64))
    return as_packets(e, "events", F.col("event_id"), data)


@query("SELECT (1536 + ascii(event_type))::INT AS ethertype, count(*) AS packets, round(avg(14 + event_id % 64), 6) AS mean_caplen FROM events GROUP BY 1")
def eth_mean_caplen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean captured length and packets by ethertype: the overlay decodes two bytes of each frame."""
    p = event_packets(spark, sf_dir)
    kind = protocols.ETHERNET.view(p.payload)["ethertype"]
    return p.select(kind.alias("ethertype"), "caplen").groupBy("ethertype").agg(F.count(F.lit(1)).alias("packets"), F.round(F.avg("caplen"), 6).alias("mean_caplen"))


def order_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each order: UDP, or TCP for every third, under a VLAN tag for every second; ports from the customer."""
    o = table(spark, sf_dir, "orders")
    src, dst = o.o_custkey % 50 + 1000, o.o_orderkey % 20 + 30480
    body = zeros(o.o_orderkey % 16)
    tcp = F.concat(protocols.TCP.encode({"src_port": src, "dst_port": dst, "seq": o.o_orderkey, "ack": F.lit(0), "data_offset": F.lit(5), "reserved": F.lit(0), "flags": F.lit(2), "window": F.lit(1024), "checksum": F.lit(0), "urgent": F.lit(0)}), body)
    is_tcp = o.o_orderkey % 3 == 0
    ip = ipv4(o.o_custkey, o.o_orderkey, F.when(is_tcp, 6).otherwise(17), F.lit(0), F.lit(0), F.lit(False), F.when(is_tcp, tcp).otherwise(udp(src, dst, body)))
    tag = protocols.VLAN.encode({"pcp": F.lit(0), "dei": F.lit(0), "vid": o.o_custkey % 100, "inner_ethertype": F.lit(0x800)})
    data = F.when(o.o_orderkey % 2 == 0, frame(o.o_custkey, F.lit(0x8100), F.concat(tag, ip))).otherwise(frame(o.o_custkey, F.lit(0x800), ip))
    return as_packets(o, "orders", F.col("o_orderkey"), data)


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'tcp' ELSE 'udp' END AS proto, (o_custkey % 50 + 1000)::INT AS src_port, count(*) AS n, sum(o_orderkey % 20 + 30480)::BIGINT AS dst_ports FROM orders GROUP BY 1, 2")
def l4_port_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet walk in the kernel: ports under optional VLAN tags, TCP and UDP."""
    c = Capture(order_packets(spark, sf_dir), Options(reassembly=None))
    rows = c.union(["udp", "tcp"], ["src_port", "dst_port"]).withColumnRenamed("table", "proto")
    return rows.groupBy("proto", "src_port").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dst_port").cast("long")).alias("dst_ports"))


@query("SELECT (o_custkey % 100)::INT AS vid, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def vlan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by Catalyst alone: bounded VLAN tags, no Python."""
    layers = rules.Layers(order_packets(spark, sf_dir))
    vid = layers.field("vlan", "vid")
    return layers.rows.select(vid.alias("vid")).where("vid is not null").groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


RULES = """
# Orders by their ports.
udp.dst_port == 30490 => raw_tlv udp_payload "one port"
tcp.src_port >= 1040 && vlan.vid < 50 => raw_tlv tcp_payload "tagged"
eth.ethertype == 0x86DD => lldp eth_payload "none"
"""


@query("""
SELECT r.rule_id::BIGINT AS rule_id, r.label, count(o.o_orderkey) AS matched, coalesce(sum(o.tlvs), 0)::BIGINT AS rows
FROM (VALUES (0, 'one port'), (1, 'tagged'), (2, 'none')) r(rule_id, label)
LEFT JOIN (
  SELECT 0 AS rule_id, o_orderkey, (o_orderkey % 16) // 2 AS tlvs FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 20 = 10
  UNION ALL
  SELECT 1, o_orderkey, (o_orderkey % 16) // 2 FROM orders
  WHERE o_orderkey % 3 = 0 AND o_custkey % 50 >= 40 AND o_orderkey % 2 = 0 AND o_custkey % 100 < 50) o ON o.rule_id = r.rule_id
GROUP BY 1, 2""")
def rules_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules: predicates and regions in Catalyst, rows by their parsers, counts of every rule."""
    return rules.rule_stats(order_packets(spark, sf_dir), rules.parse_rules(RULES))


#: Bytes of text in one datagram at most; the parts of a longer text are packets PART_IDS apart.
PART_BYTES, PART_IDS = 60_000, 1 << 40


def document_fragments(spark: SparkSession, sf_dir: str, unit: int = 1024) -> DataFrame:
    """Frames of the fragments of a document's datagrams: one UDP datagram, or as many of equal size as a long text needs.

    Each datagram's last fragment comes first. The part of the text is in the destination and in the packet's number.
    """
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", blob(F.col("text")).alias("text"))
    d = d.withColumn("size", F.octet_length("text").cast("long")).withColumn("n", F.greatest(F.ceil(F.col("size") / PART_BYTES), F.lit(1)))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    d = d.withColumn("at", F.expr("part * size div n")).withColumn("end", F.expr("(part + 1) * size div n"))
    body = F.substring(F.col("text"), (F.col("at") + 1).cast("int"), (F.col("end") - F.col("at")).cast("int"))
    d = d.select("doc_id", "part", udp(F.lit(7), F.lit(8), body).alias("b")).withColumn("last", F.floor((F.octet_length("b") - 1) / unit))
    parts = d.select("doc_id", "part", "b", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("i"))
    piece = F.substring(F.col("b"), (F.col("i") * unit + 1).cast("int"), F.lit(unit))
    data = frame(F.col("doc_id"), F.lit(0x800), ipv4(F.col("doc_id"), F.col("part") + 1, 17, (F.col("doc_id") + F.col("part")) % 65536, (F.col("i") * (unit // 8)).cast("int"), F.col("i") < F.col("last"), piece))
    number = F.col("part") * PART_IDS + F.col("doc_id") * 100 + (F.col("last") - F.col("i"))
    return as_packets(parts, "documents", number, data)


#: The datagrams of each text: it is cut into as many equal parts as it needs.
_PARTS_SQL = f"""SELECT doc_id, text, part, ((part + 1) * size // n - part * size // n + 8)::BIGINT AS total
FROM (SELECT doc_id, text, strlen(text) AS size, greatest((strlen(text) + {PART_BYTES - 1}) // {PART_BYTES}, 1) AS n FROM documents WHERE text IS NOT NULL), range(100000) r(part) WHERE part < n"""


@query(f"SELECT (part * {PART_IDS} + doc_id * 100 + (total - 1) // 1024)::BIGINT AS last_packet_id, total AS total_length, ((total - 1) // 1024 + 1)::BIGINT AS fragment_count FROM ({_PARTS_SQL}) WHERE total > 1024")
def defrag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reassembly of datagrams whose fragments come in reverse."""
    c = Capture(document_fragments(spark, sf_dir))
    return c.table("datagram").where("completion_status = 0").select("last_packet_id", "total_length", "fragment_count")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE strlen(text) >= 1017")
def defrag_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reassembled bytes, taken up again as UDP; a long text's datagrams are joined in their order."""
    c = Capture(document_fragments(spark, sf_dir))
    rows = c.table("udp", True).where("is_reassembled")
    rows = rows.withColumn("part", F.expr(f"(packet_id + {PART_IDS // 2}) div {PART_IDS}"))
    rows = rows.select(F.floor((F.col("packet_id") - F.col("part") * PART_IDS) / 100).alias("doc_id"), "part", "data")
    return rows.groupBy("doc_id").agg(F.md5(F.expr("listagg(data) WITHIN GROUP (ORDER BY part)")).alias("text_md5"))


def broken_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments per order, far from those of others: whole, without its end, or with a conflict, by o_orderkey % 3."""
    o = table(spark, sf_dir, "orders")
    kind = o.o_orderkey % 3
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("offset"), F.lit(True).alias("more"), F.lit("00" * 24).alias("data"))
    end = F.struct(F.lit(1).alias("i"), F.when(kind == 2, 8).otherwise(24).alias("offset"), (kind == 1).alias("more"), F.lit("ff" * 24).alias("data"))
    parts = o.select("o_orderkey", F.explode(F.array(first, end)).alias("p")).select("o_orderkey", "p.*")
    return parts.select(F.lit("orders").alias("file"), F.lit(4).alias("ip_version"), be(F.col("o_orderkey"), 8).alias("key"), (F.col("o_orderkey") * 50 + F.col("i")).alias("packet_id"), F.lit(17).cast("smallint").alias("protocol"), F.col("offset").cast("long").alias("frag_offset_bytes"), F.col("more").alias("more_fragments"), F.unhex("data").alias("data"))


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END::INT AS completion_status, count(*) AS n, sum(o_orderkey * 50)::BIGINT AS first_packets FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey * 50 + 1 + 30 <= (SELECT max(o_orderkey * 50 + 1) FROM orders) GROUP BY 1")
def defrag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, timed out and conflicting datagrams by the packet clock."""
    parts = broken_fragments(spark, sf_dir)
    last = parts.groupBy("file").agg(F.max("packet_id").alias("last"))
    found, _ = defrag.reassemble(parts, last)
    shown = found.where("is_reported")
    return shown.groupBy(F.col("completion_status").cast("int").alias("completion_status")).agg(F.count(F.lit(1)).alias("n"), F.sum("first_packet_id").alias("first_packets"))


# gPTP


def gptp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An announce with o_custkey % 4 clocks of path trace for each order, for every fifth a message of a kind without a table."""
    o = table(spark, sf_dir, "orders")
    known = o.o_orderkey % 5 != 0
    n = F.when(known, o.o_custkey % 4).otherwise(0)
    path = F.concat(be(F.lit(8), 2), be(n * 8, 2), F.unhex(F.repeat(F.hex(be(o.o_custkey, 8)), n.cast("int"))))
    body = F.concat(be(o.o_orderkey, 6), be(F.lit(7), 4), be(F.lit(-37), 2), zeros(F.lit(1)), be(F.lit(246), 1), be(F.lit(248), 1), be(F.lit(254), 1), be(F.lit(65535), 2), be(F.lit(247), 1), be(o.o_custkey, 8), be(F.lit(1), 2), be(F.lit(160), 1), path)
    size = F.octet_length(body) + 34
    head = F.concat(F.when(known, F.unhex(F.lit("1B"))).otherwise(F.unhex(F.lit("1D"))), F.unhex(F.lit("02")), be(size, 2), zeros(F.lit(4)), be(F.lit(-5), 8), zeros(F.lit(4)), be(o.o_custkey, 8), be(F.lit(1), 2), be(o.o_orderkey % 65536, 2), be(F.lit(5), 1), be(F.lit(-3), 1))
    data = frame(o.o_custkey, F.lit(0x88F7), F.concat(head, body))
    return as_packets(o, "orders", F.col("o_orderkey"), data)


@query("SELECT msg_index, packet_id, seconds, path FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS msg_index, o_orderkey AS packet_id, o_orderkey AS seconds, (o_custkey % 4)::INT AS path FROM orders) WHERE packet_id % 5 <> 0")
def msg_index_gptp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are numbered whether their kind has a table or not."""
    c = Capture(gptp_packets(spark, sf_dir))
    a = c.table("gptp_announce")
    return a.select("common.msg_index", "packet_id", F.col("origin_timestamp_seconds").alias("seconds"), F.col("path_trace_count").alias("path"))


@query("SELECT o_orderkey AS packet_id, count(*) FILTER (i < o_custkey % 4) AS clocks, lower(lpad(hex(o_custkey), 16, '0')) AS grandmaster FROM orders, range(4) t(i) WHERE o_orderkey % 5 <> 0 GROUP BY o_orderkey, o_custkey")
def path_trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announces left-joined with their path traces by msg_index."""
    c = Capture(gptp_packets(spark, sf_dir))
    a = c.table("gptp_announce").select("common.msg_index", "packet_id", F.lower(F.hex("grandmaster_identity")).alias("grandmaster"))
    p = c.table("gptp_path_trace").groupBy("msg_index").agg(F.count(F.lit(1)).alias("clocks"))
    # Both are as many as the messages, whatever Spark guesses from the table's size.
    return a.join(p.hint("merge"), "msg_index", "left").select("packet_id", F.coalesce("clocks", F.lit(0).cast("long")).alias("clocks"), "grandmaster")


# SOME/IP and LLDP


@query("SELECT o_orderkey AS packet_id, i::BIGINT AS tlv_index, (o_custkey % 4096)::INT AS data_id, (i + 1)::BIGINT AS length FROM orders, range(2) t(i)")
def someip_tlv_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged members of SOME/IP messages: one of a fixed width of 1 byte, one with a length of 8 bits."""
    o = table(spark, sf_dir, "orders")
    member = F.concat(be(o.o_custkey % 4096, 2), zeros(F.lit(1)), be(F.lit(5 << 12) + o.o_custkey % 4096, 2), be(F.lit(2), 1), zeros(F.lit(2)))
    message = F.concat(be(F.lit(0x1234), 2), be(F.lit(1), 2), be(F.octet_length(member) + 8, 4), zeros(F.lit(8)), member)
    data = frame(o.o_custkey, F.lit(0x800), ipv4(o.o_custkey, F.lit(1), 17, F.lit(0), F.lit(0), F.lit(False), udp(F.lit(41000), F.lit(30509), message)))
    p = as_packets(o, "o", F.col("o_orderkey"), data)
    return Capture(p, Options(someip_tlv_ports=(30509,))).table("someip_tlv").select("packet_id", "tlv_index", "data_id", "length")


@query("SELECT c_custkey AS packet_id, 1::INT AS tlv_type, strlen(c_name)::INT AS tlv_length, 0::INT AS ttl FROM customer UNION ALL SELECT c_custkey, 3, 2, (c_custkey % 300)::INT FROM customer")
def lldp_tlvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLDP units: a chassis id of the customer's name and a time to live."""
    c = table(spark, sf_dir, "customer")
    name = blob(c.c_name)
    region = F.concat(be(F.lit(1 << 9) + F.octet_length(name), 2), name, be(F.lit((3 << 9) + 2), 2), be(c.c_custkey % 300, 2), zeros(F.lit(2)))
    data = frame(c.c_custkey, F.lit(0x88CC), region)
    p = as_packets(c, "c", F.col("c_custkey"), data)
    return Capture(p).table("lldp").select("packet_id", "tlv_type", "tlv_length", F.col("ttl_seconds").alias("ttl"))


# Sinks


@query("""SELECT o_orderkey AS packet_id, '{"_index":' || o_orderkey || ',"_source":{"layers":{"order":{"customer":' || o_custkey || '},"item":' || CASE WHEN n = 1 THEN items[1] ELSE '[' || array_to_string(items, ',') || ']' END || '}}}' AS line
FROM (SELECT o_orderkey, o_custkey, o_custkey % 3 + 1 AS n, list_transform(range(o_custkey % 3 + 1), lambda i: '{"item":' || i || '}') AS items FROM orders)""")
def json_tree_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a packet as one JSON line; a layer that occurs again becomes an array."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"), "o_custkey")
    head = o.select("packet_id", F.lit(0).alias("layer_no"), F.lit(0).alias("sub"), F.lit("order").alias("name"), F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("json"))
    items = o.select("packet_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 3)).alias("i"))
    items = items.select("packet_id", F.lit(1).alias("layer_no"), F.col("i").cast("int").alias("sub"), F.lit("item").alias("name"), F.to_json(F.struct(F.col("i").alias("item"))).alias("json"))
    return fold_layers(head.unionByName(items), ["packet_id"])


NAMED = Layout("Named", [("key", uint(32)), ("region", u8), ("tag", raw(2)), ("pair", layout.array(le_u16, 2))])


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"region":' || n_regionkey || ',"tag":"ab' || lpad(lower(hex(n_regionkey)), 2, '0') || '","pair":[' || n_nationkey || ',' || (n_nationkey + 1) || ']}' AS line FROM nation""")
def record_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to_json of decoded records as a Catalyst expression."""
    n = table(spark, sf_dir, "nation")
    pair = F.array(n.n_nationkey.cast("long"), n.n_nationkey.cast("long") + 1)
    b = n.select("n_nationkey", NAMED.encode({"key": n.n_nationkey, "region": n.n_regionkey, "tag": F.concat(F.unhex(F.lit("AB")), be(n.n_regionkey, 1)), "pair": pair}).alias("b"))
    return b.select("n_nationkey", schemas.json_expression(NAMED, NAMED.decode(b.b)).alias("line"))


@query("""SELECT * FROM (VALUES
('Ethernet', 14, 'w:6,w:6,S', '{"type":"record","name":"Ethernet","fields":[{"name":"dst","type":{"type":"fixed","name":"Ethernet_dst_fx","size":6}},{"name":"src","type":{"type":"fixed","name":"Ethernet_src_fx","size":6}},{"name":"ethertype","type":"int"}]}', 'dst,src,ethertype'),
('VlanTag', 4, 'C,C,S,S', '{"type":"record","name":"VlanTag","fields":[{"name":"pcp","type":"int"},{"name":"dei","type":"int"},{"name":"vid","type":"int"},{"name":"inner_ethertype","type":"int"}]}', 'pcp,dei,vid,inner_ethertype'),
('Udp', 8, 'S,S,S,S', '{"type":"record","name":"Udp","fields":[{"name":"src_port","type":"int"},{"name":"dst_port","type":"int"},{"name":"length","type":"int"},{"name":"checksum","type":"int"}]}', 'src_port,dst_port,length,checksum'),
('Ipv6Fragment', 8, 'C,C,S,I', '{"type":"record","name":"Ipv6Fragment","fields":[{"name":"next_header","type":"int"},{"name":"reserved","type":"int"},{"name":"offset_flags","type":"int"},{"name":"identification","type":"long"}]}', 'next_header,reserved,offset_flags,identification'),
('PortIdentity', 10, 'w:8,S', '{"type":"record","name":"PortIdentity","fields":[{"name":"clock_identity","type":{"type":"fixed","name":"PortIdentity_clock_identity_fx","size":8}},{"name":"port_number","type":"int"}]}', 'clock_identity,port_number')
) t(name, size, arrow, avro, csv)""")
def arrow_avro_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow formats, Avro schema and CSV header of records, by the published formats."""
    some = (protocols.ETHERNET, protocols.VLAN, protocols.UDP, protocols.IPV6_FRAGMENT, protocols.PORT_IDENTITY)
    rows = [(v.name, v.size, ",".join(f for _, f in schemas.arrow_formats(v)), schemas.avro_schema(v), schemas.csv_header(v)) for v in some]
    return spark.createDataFrame(rows, "name string, size int, arrow string, avro string, csv string")
