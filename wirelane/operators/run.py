"""Parsers over columns: Arrow batches in Python, or Catalyst expressions where the work is bounded."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wirelane.functions.types import sql_type
from wirelane.operators.parsers import Error, Parser, Source

ERROR_SQL = "struct<kind: string, offset: bigint, expected: string, needed: bigint, context: array<struct<label: string, offset: bigint>>>"


def converter(kind: T.DataType) -> Callable[[Any], Any]:
    """From a parser's value to what Arrow takes for the type: tuples and mappings become structs."""
    if isinstance(kind, T.StructType):
        names, inner = kind.names, [converter(f.dataType) for f in kind.fields]

        def record(x: Any) -> Any:
            if x is None:
                return None
            parts = [x[n] for n in names] if isinstance(x, dict) else x
            return {n: c(p) for n, c, p in zip(names, inner, parts, strict=True)}

        return record
    if isinstance(kind, T.ArrayType):
        item = converter(kind.elementType)
        return lambda x: None if x is None else [item(y) for y in x]
    if isinstance(kind, T.StringType):
        return lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else x
    if isinstance(kind, T.DecimalType):
        from decimal import Decimal

        return lambda x: None if x is None else Decimal(x)
    return lambda x: x


def parse(column: Column, p: Parser, streaming: bool = False) -> Column:
    """A struct (ok, value, rest_pos, error) for each buffer of a binary or text column; null for a null one.

    rest_pos is where the parser stopped; value and rest_pos are null where ok is false, error where it is true.
    """
    kind = sql_type(p.sql)
    result = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", kind), T.StructField("rest_pos", T.LongType()), T.StructField("error", sql_type(ERROR_SQL))])
    arrow = to_arrow_type(result)
    convert = converter(kind)
    start = p.run

    def one(buf: bytes | None) -> dict | None:
        if buf is None:
            return None
        got = start(Source(buf, streaming), 0, len(buf))
        if isinstance(got, Error):
            frames = [{"label": label, "offset": at} for label, at in got.context]
            return {"ok": False, "error": {"kind": got.kind, "offset": got.offset, "expected": got.expected, "needed": got.needed, "context": frames}}
        return {"ok": True, "value": convert(got[1]), "rest_pos": got[0]}

    def run(buffers: pa.Array) -> pa.Array:
        return pa.array([one(b) for b in buffers.to_pylist()], arrow)

    return F.arrow_udf(run, result)(column.cast("binary"))


def rendered(column: Column, p: Parser) -> Column:
    """The error of each buffer as a message with contexts and the bytes around its place; null where the parser succeeds."""

    def run(buffers: pa.Array) -> pa.Array:
        found = (None if b is None else (p.run(Source(b), 0, len(b)), b) for b in buffers.to_pylist())
        return pa.array([f[0].render(f[1]) if f and isinstance(f[0], Error) else None for f in found], pa.string())

    return F.arrow_udf(run, "string")(column.cast("binary"))


def parse_column(df: DataFrame, column: str, p: Parser, name: str = "parsed", streaming: bool = False) -> DataFrame:
    return df.withColumn(name, parse(df[column], p, streaming))


# Catalyst


class NotLowered(ValueError):
    """The parser's work is not bounded, or it holds Python functions."""


class Lowered:
    """Columns that tell whether the parser succeeds, its value, and the place after it."""

    def __init__(self, ok: Column, value: Column | None, rest: Column):
        self.ok, self.value, self.rest = F.coalesce(ok, F.lit(False)), value, rest


def lower(p: Parser, buf: Column, pos: Column | None = None, end: Column | None = None) -> Lowered:
    """The parser as expressions over a binary column: JVM-side, pruned and fused by Catalyst. Raises NotLowered.

    A place after a run of unknown length is an expression that all later parts hold: for a few such runs, not for long grammars.
    """
    pos = F.lit(0) if pos is None else pos
    end = F.octet_length(buf) if end is None else end
    kind, *args = p.node
    if kind not in _RULES:
        raise NotLowered(kind)
    return _RULES[kind](args, buf, pos, end)


def _slice(buf: Column, pos: Column, n: Column) -> Column:
    return F.substring(buf, pos + 1, n)


def _latin1(buf: Column, pos: Column, end: Column) -> Column:
    """What is left as text of one character a byte."""
    return F.decode(_slice(buf, pos, end - pos), "ISO-8859-1")


def _regex(members: frozenset[int]) -> str:
    return "[" + "".join(f"\\x{c:02x}" for c in sorted(members)) + "]" if members else "(?!)"


def _fixed(buf, pos, end, n: int, test: Callable[[Column], Column]) -> Lowered:
    got = _slice(buf, pos, F.lit(n))
    return Lowered((end - pos >= n) & test(got), got, pos + n)


def _run(args, buf, pos, end) -> Lowered:
    members, least, most, _ = args
    left = _slice(buf, pos, F.least(end - pos, F.lit(most)) if most < 1 << 30 else end - pos)
    got = F.octet_length(F.encode(F.regexp_extract(F.decode(left, "ISO-8859-1"), f"^{_regex(members)}*", 0), "ISO-8859-1")) if members else F.lit(0)
    return Lowered((end >= pos) & (got >= least), _slice(buf, pos, got), pos + got)


def _keep(args, buf, pos, end) -> Lowered:
    parts, keep = args
    ok, got = F.lit(True), []
    for part in parts:
        one = lower(part, buf, pos, end)
        ok, pos = ok & one.ok, one.rest
        got.append(one.value)
    kept = [got[k] for k in keep]
    return Lowered(ok, kept[0] if len(keep) == 1 else _tuple(kept), pos)


def _tuple(values: list[Column]) -> Column:
    return F.struct(*((F.lit(None).cast("boolean") if v is None else v).alias(f"_{i + 1}") for i, v in enumerate(values)))


def _alt(args, buf, pos, end) -> Lowered:
    (parts,) = args
    tried = [lower(p, buf, pos, end) for p in parts]
    ok, value, rest = F.lit(False), F.when(tried[0].ok, tried[0].value), F.when(tried[0].ok, tried[0].rest)
    for one in tried:
        ok = ok | one.ok
    for one in tried[1:]:
        value, rest = value.when(one.ok, one.value), rest.when(one.ok, one.rest)
    return Lowered(ok, value, rest)


def _until(args, buf, pos, end) -> Lowered:
    (want,) = args
    at = F.instr(_latin1(buf, pos, end), want.decode("latin-1"))
    return Lowered(at > 0, _slice(buf, pos, at - 1), pos + at - 1)


def _int(args, buf, pos, end) -> Lowered:
    from wirelane.operators.layout import Layout, sint, uint

    n, order, signed = args
    one = Layout("int", [("x", (sint if signed else uint)(8 * n, order))])
    return Lowered(one.fits(buf, pos, end), one.view(buf, pos)["x"], pos + n)


def _dec(args, buf, pos, end) -> Lowered:
    low, high, signed = args
    text = F.regexp_extract(_latin1(buf, pos, end), "^-?[0-9]+" if signed else "^[0-9]+", 0)
    value = text.try_cast("decimal(38,0)")
    return Lowered((text != "") & value.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), value.try_cast("bigint") if high < 1 << 63 else value.cast("decimal(20,0)"), pos + F.length(text))


def _hex(args, buf, pos, end) -> Lowered:
    (size,) = args
    text = F.regexp_extract(_latin1(buf, pos, end), "^[0-9A-Fa-f]+", 0)
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return Lowered((text != "") & (F.length(digits) <= size // 4), value.try_cast("bigint") if size < 64 else value, pos + F.length(text))


def _double(args, buf, pos, end) -> Lowered:
    text = F.regexp_extract(_latin1(buf, pos, end), r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    value = text.try_cast("double")
    lost = (F.abs(value) == float("inf")) | ((value == 0) & F.regexp_extract(text, "^[^eE]*", 0).rlike("[1-9]"))
    return Lowered((text != "") & ~lost, value, pos + F.length(text))


def _line_ending(args, buf, pos, end) -> Lowered:
    text = F.regexp_extract(_latin1(buf, pos, end), "^(\r\n|\n)", 0)
    return Lowered(text != "", text, pos + F.length(text))


def _opt(args, buf, pos, end) -> Lowered:
    one = lower(args[0], buf, pos, end)
    return Lowered(end >= pos, None if one.value is None else F.when(one.ok, one.value), F.when(one.ok, one.rest).otherwise(pos))


def _length_data(args, buf, pos, end) -> Lowered:
    size = lower(args[0], buf, pos, end)
    n = size.value.cast("long")
    return Lowered(size.ok & (size.rest + n <= end), _slice(buf, size.rest, F.least(n, end).cast("int")), size.rest + n)


def _length_value(args, buf, pos, end) -> Lowered:
    size = lower(args[0], buf, pos, end)
    stop = size.rest + size.value.cast("long")
    inner = lower(args[1], buf, size.rest, F.least(stop, end))
    return Lowered(size.ok & (stop <= end) & inner.ok, inner.value, stop)


def _strct(args, buf, pos, end) -> Lowered:
    layout, order = args
    return Lowered(layout.fits(buf, pos, end), layout.view(buf, pos, order).struct(), pos + layout.size)


def _count(args, buf, pos, end) -> Lowered:
    p, n = args
    one = _keep(((p,) * n, tuple(range(n))), buf, pos, end) if n else None
    if one is None:
        return Lowered(F.lit(True), F.expr(f"cast(array() as array<{p.sql}>)"), pos)
    return Lowered(one.ok, F.array(*(one.value[f"_{k + 1}"] for k in range(n))) if n > 1 else F.array(one.value), one.rest)


_RULES: dict[str, Callable] = {
    "tag": lambda a, b, p, e: _fixed(b, p, e, len(a[0]), lambda got: got == F.lit(a[0])),
    "tag_no_case": lambda a, b, p, e: _fixed(b, p, e, len(a[0]), lambda got: F.translate(F.decode(got, "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == a[0].decode("latin-1")),
    "take": lambda a, b, p, e: _fixed(b, p, e, a[0], lambda got: F.lit(True)),
    "run": _run,
    "one": lambda a, b, p, e: (lambda got: Lowered(got.ok, F.decode(got.value, "ISO-8859-1"), got.rest))(_fixed(b, p, e, 1, lambda got: F.decode(got, "ISO-8859-1").rlike(f"^{_regex(a[0])}") if len(a[0]) < 256 else F.lit(True))),
    "text": lambda a, b, p, e: (lambda got: Lowered(got.ok, F.decode(got.value, "UTF-8"), got.rest))(lower(a[0], b, p, e)),
    "take_until": _until,
    "line_ending": _line_ending,
    "eof": lambda a, b, p, e: Lowered(p == e, None, p),
    "rest": lambda a, b, p, e: Lowered(e >= p, _slice(b, p, e - p), e),
    "rest_len": lambda a, b, p, e: Lowered(e >= p, (e - p).cast("long"), p),
    "seq": lambda a, b, p, e: _keep((a[0], tuple(range(len(a[0])))), b, p, e) if len(a[0]) > 1 else (lambda got: Lowered(got.ok, _tuple([got.value]), got.rest))(lower(a[0][0], b, p, e)),
    "keep": _keep,
    "alt": _alt,
    "opt": _opt,
    "skip": lambda a, b, p, e: Lowered(F.lit(True), None, p),
    "peek": lambda a, b, p, e: (lambda got: Lowered(got.ok, got.value, p))(lower(a[0], b, p, e)),
    "not": lambda a, b, p, e: Lowered(~lower(a[0], b, p, e).ok, None, p),
    "recognize": lambda a, b, p, e: (lambda got: Lowered(got.ok, _slice(b, p, (got.rest - p).cast("int")), got.rest))(lower(a[0], b, p, e)),
    "consumed": lambda a, b, p, e: (lambda got: Lowered(got.ok, _tuple([_slice(b, p, (got.rest - p).cast("int")), got.value]), got.rest))(lower(a[0], b, p, e)),
    "value": lambda a, b, p, e: (lambda got: Lowered(got.ok, F.lit(a[0]), got.rest))(lower(a[1], b, p, e)),
    "verify": lambda a, b, p, e: (lambda got: Lowered(got.ok & a[1](got.value), got.value, got.rest))(lower(a[0], b, p, e)),
    "success": lambda a, b, p, e: Lowered(F.lit(True), F.lit(a[0]), p),
    "fail": lambda a, b, p, e: Lowered(F.lit(False), None, p),
    "same": lambda a, b, p, e: lower(a[0], b, p, e),
    "length_data": _length_data,
    "length_value": _length_value,
    "strct": _strct,
    "int": _int,
    "dec": _dec,
    "hex": _hex,
    "double": _double,
    "count": _count,
}
