"""SQL type names to Spark types, without a session."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_SIMPLE = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "void": T.BooleanType(),
}
_TOKEN = re.compile(r"\s*([A-Za-z_][\w]*|[0-9]+|[<>(),:])")


def sql_type(text: str) -> T.DataType:
    """The type that a name like array<struct<a: int, b: decimal(20,0)>> stands for; void is a boolean that is null."""
    tokens = _TOKEN.findall(text)
    kind, at = _read(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"not a type: {text}")
    return kind


def _read(tokens: list[str], at: int) -> tuple[T.DataType, int]:
    name = tokens[at].lower()
    if name == "array":
        item, end = _read(tokens, at + 2)
        return T.ArrayType(item), end + 1
    if name == "struct":
        fields, at = [], at + 2
        while tokens[at] != ">":
            field = tokens[at]
            kind, at = _read(tokens, at + 2)
            fields.append(T.StructField(field, kind))
            at += tokens[at] == ","
        return T.StructType(fields), at + 1
    if name == "decimal":
        return T.DecimalType(int(tokens[at + 2]), int(tokens[at + 4])), at + 6
    return _SIMPLE[name], at + 1
