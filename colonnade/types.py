"""The eight column types, their Spark types and the JSON values that each accepts."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import types as T

from .errors import ValidationError

# Fixed type names, in the order of the file format's type bytes.
NAMES = ("int", "float", "string", "boolean", "date", "array<int>", "array<float>", "array<string>")

SPARK = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
    "array<int>": T.ArrayType(T.LongType(), True),
    "array<float>": T.ArrayType(T.DoubleType(), True),
    "array<string>": T.ArrayType(T.StringType(), True),
}
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?Z\Z")


def spark_schema(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[t], True) for n, t in columns])


def kind_of(data_type: T.DataType) -> str:
    """The engine's type name of a Spark type; other types have their Spark name."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(data_type, T.ArrayType):
        return f"array<{kind_of(data_type.elementType)}>"
    return data_type.simpleString()


def parse_date(text: str) -> datetime | None:
    """An RFC 3339 time that ends in Z; None if it is not one."""
    if not (m := _RFC3339.match(text)):
        return None
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '.0')[:7]}").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def _scalar_ok(value: object, kind: str) -> bool:
    if kind == "int":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == "float":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "date":
        return isinstance(value, str) and parse_date(value) is not None
    return isinstance(value, str)


def accepts(value: object, kind: str) -> bool:
    """Whether a JSON value may stand in a column of this type; null always may."""
    if value is None:
        return True
    if kind.startswith("array<"):
        return isinstance(value, list) and all(e is None or _scalar_ok(e, kind[6:-1]) for e in value)
    return _scalar_ok(value, kind)


def to_spark(value: object, kind: str) -> object:
    """The Python value that Spark stores for an accepted JSON value."""
    if value is None:
        return None
    if kind == "date":
        return parse_date(value)
    if kind == "float":
        return float(value)
    if kind == "array<float>":
        return [None if e is None else float(e) for e in value]
    return value


def parse_columns(text: str) -> list[tuple[str, str]]:
    """``name:type,name:type`` as pairs."""
    out = []
    for part in re.split(r",(?![^<]*>)", text):
        name, colon, kind = part.strip().partition(":")
        if not colon or not name.strip() or kind.strip() not in NAMES:
            raise ValidationError(f"bad column definition {part.strip()!r}")
        out.append((name.strip(), kind.strip()))
    if len({n for n, _ in out}) < len(out):
        raise ValidationError("duplicate column name")
    return out
