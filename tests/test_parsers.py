"""Values, errors and propagation of every combinator; both back-ends agree."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelane.operators import layout as ly
from wirelane.operators import parsers as p
from wirelane.operators.run import NotLowered, lower, parse

VALUES = [
    (p.tag("ab"), "abc", b"ab", b"c"),
    (p.tag_no_case("AB"), "aBc", b"aB", b"c"),
    (p.take(2), "abc", b"ab", b"c"),
    (p.take_while("ab"), "abac", b"aba", b"c"),
    (p.take_while("ab"), "c", b"", b"c"),
    (p.take_while1("ab"), "ac", b"a", b"c"),
    (p.take_while_m_n(1, 2, "a"), "aaa", b"aa", b"a"),
    (p.take_till(";"), "ab;", b"ab", b";"),
    (p.take_till1(";"), "ab;", b"ab", b";"),
    (p.take_until("--"), "a-b--c", b"a-b", b"--c"),
    (p.is_a("ab"), "bac", b"ba", b"c"),
    (p.is_not("c"), "bac", b"ba", b"c"),
    (p.chr_("a"), "ab", "a", b"b"),
    (p.satisfy(str.isdigit), "1b", "1", b"b"),
    (p.one_of("ab"), "ba", "b", b"a"),
    (p.none_of("ab"), "cb", "c", b"b"),
    (p.anychar, "xy", "x", b"y"),
    (p.alpha1, "ab1", "ab", b"1"),
    (p.digit0, "x", "", b"x"),
    (p.hex_digit1, "fFg", "fF", b"g"),
    (p.oct_digit1, "178", "17", b"8"),
    (p.alphanumeric1, "a1-", "a1", b"-"),
    (p.space1, " \t\n", " \t", b"\n"),
    (p.multispace0, " \r\nx", " \r\n", b"x"),
    (p.newline, "\nx", "\n", b"x"),
    (p.tab, "\tx", "\t", b"x"),
    (p.crlf, "\r\nx", "\r\n", b"x"),
    (p.line_ending, "\r\nx", "\r\n", b"x"),
    (p.not_line_ending, "ab\r\n", "ab", b"\r\n"),
    (p.eof, "", None, b""),
    (p.rest, "ab", b"ab", b""),
    (p.rest_len, "ab", 2, b"ab"),
    (p.seq(p.u8, p.take(1)), b"\x01ab", (1, b"a"), b"b"),
    (p.pair(p.digit1, p.alpha1), "1a", ("1", "a"), b""),
    (p.separated_pair(p.digit1, p.chr_(","), p.digit1), "1,2", ("1", "2"), b""),
    (p.preceded(p.chr_("("), p.digit1), "(1", "1", b""),
    (p.terminated(p.digit1, p.chr_(")")), "1)", "1", b""),
    (p.delimited(p.chr_("("), p.digit1, p.chr_(")")), "(1)", "1", b""),
    (p.alt(p.tag("a"), p.tag("b")), "bc", b"b", b"c"),
    (p.permutation(p.tag("a"), p.tag("b"), p.tag("c")), "cab", (b"a", b"b", b"c"), b""),
    (p.many0(p.tag("a")), "aab", [b"a", b"a"], b"b"),
    (p.checked_many0(p.tag("a"), 2), "aab", [b"a", b"a"], b"b"),
    (p.many1(p.tag("a")), "ab", [b"a"], b"b"),
    (p.many_m_n(1, 2, p.tag("a")), "aaa", [b"a", b"a"], b"a"),
    (p.many_till(p.anychar, p.tag(";")), "ab;c", (["a", "b"], b";"), b"c"),
    (p.count(p.be_u16, 2), b"\0\1\0\2\3", [1, 2], b"\3"),
    (p.separated_list0(p.chr_(","), p.digit1), "1,2,x", ["1", "2"], b",x"),
    (p.separated_list0(p.chr_(","), p.digit1), "x", [], b"x"),
    (p.separated_list1(p.chr_(","), p.digit1), "1", ["1"], b""),
    (p.fold_many0(p.u8, lambda: 0, lambda a, x: a + x, "bigint"), b"\1\2", 3, b""),
    (p.fold_many1(p.digit1, lambda: 0, lambda a, x: a + 1, "bigint"), "12", 1, b""),
    (p.fold_many_m_n(1, 2, p.anychar, lambda: "", lambda a, x: x + a, "string"), "abc", "ba", b"c"),
    (p.length_data(p.u8), b"\2abc", b"ab", b"c"),
    (p.length_value(p.u8, p.tag("a")), b"\2abc", b"a", b"c"),
    (p.length_count(p.u8, p.anychar), b"\2abc", ["a", "b"], b"c"),
    (p.map_(p.digit1, int, "bigint"), "12", 12, b""),
    (p.map_opt(p.digit1, lambda x: int(x) or None, "bigint"), "12", 12, b""),
    (p.map_parser(p.take(3), p.digit1), "12abc", "12", b"bc"),
    (p.flat_map(p.u8, p.take, "binary"), b"\2abc", b"ab", b"c"),
    (p.opt(p.tag("a")), "b", None, b"b"),
    (p.cond(False, p.tag("a")), "a", None, b"a"),
    (p.cond(True, p.tag("a")), "a", b"a", b""),
    (p.peek(p.tag("a")), "ab", b"a", b"ab"),
    (p.not_(p.tag("a")), "b", None, b"b"),
    (p.recognize(p.pair(p.alpha1, p.digit1)), "a1-", b"a1", b"-"),
    (p.consumed(p.map_(p.digit1, int, "bigint")), "12", (b"12", 12), b""),
    (p.value(7, p.tag("a")), "ab", 7, b"b"),
    (p.verify(p.u8, lambda x: x > 1), b"\2", 2, b""),
    (p.success(5), "a", 5, b"a"),
    (p.all_consuming(p.tag("a")), "a", b"a", b""),
    (p.into(p.u8, float, "double"), b"\2", 2.0, b""),
    (p.be_u24, b"\1\2\3", 0x010203, b""),
    (p.le_u24, b"\1\2\3", 0x030201, b""),
    (p.be_u48, b"\0\0\0\0\1\0", 256, b""),
    (p.le_i16, b"\xff\xff", -1, b""),
    (p.be_i64, b"\xff" * 8, -1, b""),
    (p.be_u64, b"\xff" * 8, 2**64 - 1, b""),
    (p.be_f32, b"\x3f\x80\0\0", 1.0, b""),
    (p.le_f64, b"\0" * 6 + b"\xf0\x3f", 1.0, b""),
    (p.uint_(2, "little"), b"\1\0", 1, b""),
    (p.dec(8), "-128x", -128, b"x"),
    (p.hex_(16), "fFg", 255, b"g"),
    (p.double_, "-1.5e2x", -150.0, b"x"),
    (p.double_, "1e", 1.0, b"e"),
    (p.float_, "0.5", 0.5, b""),
    (p.bits(p.bseq(p.take_bits(3), p.bool_bit(), p.take_bits(6))), b"\xb7\xff\x01", (5, True, 31), b"\x01"),
    (p.bits(p.bseq(p.take_bits(4, "lsb0"), p.take_bits(8, "lsb0"))), b"\x21\x43", (1, 0x32), b""),
    (p.bits(p.bseq(p.tag_bits(1, 8), p.bytes_(p.tag("a")))), b"\1ab", (1, b"a"), b"b"),
    (p.strct(ly.Layout("x", [("a", ly.be_u16)])), b"\1\2\3", {"a": 258}, b"\3"),
]


@pytest.mark.parametrize("case", range(len(VALUES)))
def test_value(case):
    parser, data, value, rest = VALUES[case]
    assert parser(data) == (value, rest)


ERRORS = [
    (p.tag("ab"), "ax", p.Error("err", 0, "tag")),
    (p.tag("ab"), "a", p.Error("err", 1, "more input", 1)),
    (p.alt(p.pair(p.tag("a"), p.tag("b")), p.tag("c")), "ax", p.Error("err", 1, "tag")),
    (p.alt(p.tag("a"), p.tag_no_case("b")), "x", p.Error("err", 0, "tag")),
    (p.many0(p.success(1)), "a", p.Error("err", 0, "many0: inner parser must consume input")),
    (p.checked_many0(p.tag("a"), 1), "aa", p.Error("err", 1, "checked_many0: repetition cap exceeded")),
    (p.many_m_n(2, 3, p.tag("a")), "ab", p.Error("err", 1, "many_m_n: not enough repetitions")),
    (p.separated_list1(p.chr_(","), p.digit1), "x", p.Error("err", 0, "separated_list1: at least one element")),
    (p.length_value(p.u8, p.take(5)), b"\2abc", p.Error("err", 3, "more input", 3)),
    (p.verify(p.u8, lambda x: x > 1), b"\1", p.Error("err", 0, "verify")),
    (p.not_(p.tag("a")), "a", p.Error("err", 0, "not")),
    (p.cut(p.tag("a")), "b", p.Error("fail", 0, "tag")),
    (p.alt(p.cut(p.tag("a")), p.tag("b")), "b", p.Error("fail", 0, "tag")),
    (p.opt(p.cut(p.tag("a"))), "b", p.Error("fail", 0, "tag")),
    (p.many0(p.cut(p.tag("a"))), "ab", p.Error("fail", 1, "tag")),
    (p.all_consuming(p.tag("a")), "ab", p.Error("err", 1, "end of input")),
    (p.context("outer", p.context("inner", p.tag("a"))), "b", p.Error("err", 0, "tag", 0, (("inner", 0), ("outer", 0)))),
    (p.dec(8), "128", p.Error("err", 0, "decimal integer")),
    (p.dec(8, False), "-1", p.Error("err", 0, "decimal integer")),
    (p.hex_(8), "100", p.Error("err", 0, "hex integer")),
    (p.double_, "1e999", p.Error("err", 0, "floating point number")),
    (p.double_, "+1", p.Error("err", 0, "floating point number")),
    (p.bits(p.tag_bits(1, 4)), b"\x20", p.Error("err", 0, "bit tag")),
    (p.bits(p.bseq(p.take_bits(4), p.bytes_(p.u8))), b"\x20\x20", p.Error("err", 0, "byte alignment")),
    (p.fail, "a", p.Error("err", 0, "fail")),
]


@pytest.mark.parametrize("case", range(len(ERRORS)))
def test_error(case):
    parser, data, error = ERRORS[case]
    assert parser(data) == error


def test_streaming():
    short = p.tag("abc")("a", streaming=True)
    assert (short.kind, short.needed, short.offset) == ("incomplete", 2, 1)
    assert p.alt(p.tag("abc"), p.tag("a"))("a", True).kind == "incomplete"
    assert p.many0(p.tag("ab"))("aba", True).kind == "incomplete"
    assert p.opt(p.tag("ab"))("a", True) == (None, b"a")
    assert p.not_(p.tag("ab"))("a", True) == (None, b"a")
    assert p.separated_list0(p.chr_(","), p.tag("12"))("12,1", True) == ([b"12"], b",1")
    assert p.complete(p.tag("ab"))("a", True).kind == "err"
    assert p.cut(p.tag("ab"))("a", True).kind == "incomplete"
    assert p.take_while1("a")("a", True) == (b"a", b"")
    assert p.take_until("x")("a", True).needed == 1
    assert p.length_value(p.u8, p.take(5))(b"\2abc", True) == p.Error("err", 3, "value fitting its length prefix", 3)
    assert p.take(10**6)("", True).needed == p.MAX_NEEDED
    # A parser that grows byte by byte asks for more until it has all.
    data = b"\x03abc"
    for n in range(4):
        assert p.length_data(p.u8)(data[:n], True).kind == "incomplete"
    assert p.length_data(p.u8)(data, True) == (b"abc", b"")


def test_context_keeps_four():
    parser = p.tag("a")
    for i in range(6):
        parser = p.context(f"c{i}", parser)
    assert [label for label, _ in parser("b").context] == ["c0", "c1", "c2", "c3"]


def test_render():
    text = p.context("head", p.preceded(p.take(2), p.tag("x")))(b"abc").render(b"abc")
    assert text == "parse error at offset 2: expected tag\n  in head (starting at offset 0)\n  61 62 63 \n        ^^ "
    assert "need 1 more byte(s)" in p.take(2)(b"a").render(b"a")
    assert text.count("\n") == 3 and p.Error("fail", 9, "x").render(b"a").startswith("parse failure at offset 9: expected x (offset beyond")


def test_json_grammar():
    from wirelane.plans.catalog import json_grammar

    assert json_grammar()(' {"a": [1, 2.5, {"b": 3}], "c": null, "d": "x"} ') == (6.5, b"")
    assert json_grammar()('{"a": [1').kind == "fail"


LOWERED = [
    p.tag("ab"), p.tag_no_case("aB"), p.take(3), p.take_while("ab\xe9"), p.take_while_m_n(1, 2, "ab"), p.take_till("\n"), p.take_until("b"), p.one_of("ab"),
    p.digit1, p.line_ending, p.rest_len, p.separated_pair(p.alpha1, p.chr_(":"), p.dec(16)), p.alt(p.value(1, p.tag("a")), p.value(2, p.tag("b"))), p.opt(p.tag("a")),
    p.preceded(p.not_(p.tag("a")), p.take(1)), p.recognize(p.pair(p.alpha0, p.digit0)), p.verify(p.u8, lambda x: x > 97), p.length_data(p.u8), p.length_value(p.u8, p.tag("a")),
    p.be_u24, p.le_i32, p.be_u64, p.dec(8), p.hex_(16), p.double_, p.count(p.be_u16, 2), p.all_consuming(p.alpha1), p.seq(p.u8, p.opt(p.tag("b")), p.rest_len), p.context("x", p.tag("a")),
]


def test_backends_agree(spark):
    rng = random.Random(3)
    alphabet = [b"a", b"b", b"1", b"2", b"0", b":", b"\n", b"\r\n", b"-", b".", b"e", b"\x01", b"\x03", b"\xc3\xa9", b"\xff", b"F"]
    rows = [(b"",), (None,)] + [(b"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "b binary")
    for parser in LOWERED:
        low = lower(parser, F.col("b"))
        value = low.value if low.value is not None else F.lit(None)
        both = df.select("b", parse(F.col("b"), parser).alias("k"), low.ok.alias("ok"), F.when(low.ok, value).alias("v"), F.when(low.ok, low.rest).alias("rest")).where("b is not null")
        for r in both.collect():
            assert (r.k.ok, r.k.value, r.k.rest_pos) == (r.ok, r.v, r.rest), (parser.node, bytes(r.b))


def test_unbounded_work_is_not_lowered():
    with pytest.raises(NotLowered):
        lower(p.many0(p.tag("a")), F.lit(b""))


def test_null_and_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else b"a" * (i % 7)) for i in range(50)], "i int, b binary")
    many = p.many0(p.tag("a"))
    one = df.coalesce(1).select("i", parse(F.col("b"), many)["value"].alias("v")).orderBy("i").collect()
    assert one == df.repartition(7).select("i", parse(F.col("b"), many)["value"].alias("v")).orderBy("i").collect()
    assert one[0].v is None and len(one[6].v) == 6


GRAMMARS = [p.many0(p.length_value(p.u8, p.many0(p.alt(p.be_u16, p.map_(p.u8, lambda x: x))))), p.separated_list0(p.chr_(","), p.double_), p.many_till(p.anychar, p.eof)]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=96), st.integers(0, len(GRAMMARS) - 1), st.booleans())
def test_any_bytes_end(data, which, live):
    got = GRAMMARS[which](data, live)
    assert isinstance(got, p.Error) or data.endswith(got[1])


REGULAR = [p.preceded(p.multispace0, p.take_till1(" \t\r\n")), p.tag("ab"), p.one_of("ab"), p.take(3), p.pair(p.take_while_m_n(1, 2, "a"), p.take_while("b")), p.separated_pair(p.digit1, p.tag("-"), p.alpha0), p.seq(p.take_while("a"), p.take_while("a"))]


@pytest.mark.parametrize("case", range(len(REGULAR)))
@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=12) | st.text("ab1- \n", max_size=12).map(str.encode))
def test_patterns_take_what_parsers_take(case, data):
    """Repetitions of regular items, matched by a pattern, give what the parsers one by one give."""
    item = REGULAR[case]
    assert p.regular(item)
    plain = p.Parser(item.run, item.sql)
    for make in (p.many0, lambda x: p.many_m_n(1, 2, x), lambda x: p.fold_many0(x, lambda: 0, lambda n, _: n + 1, "bigint")):
        assert make(item)(data) == make(plain)(data)
        assert make(item)(data, streaming=True) == make(plain)(data, streaming=True)
