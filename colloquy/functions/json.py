"""JSON text of columns of any type, as Python's encoder writes it; built-in expressions only.

``PYTHON`` is the encoder's default style (a space after commas and colons, characters outside ASCII
escaped), ``COMPACT`` has no spaces and leaves characters as they are. Nulls are written at every level.
Doubles are written as Python does from the engine's digits (older Java versions give some doubles more
digits than needed). Dates and times are texts in ISO form; keys of maps are texts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import python_json_string
from .time import iso_format


class Style(NamedTuple):
    comma: str
    colon: str
    ascii: bool


PYTHON, COMPACT = Style(", ", ": ", True), Style(",", ":", False)
#: Short escapes.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]


def raw_json_string(text: Column) -> Column:
    """A literal in which only quotes, backslashes and control characters are escaped."""
    out = text
    for plain, short in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(short))
    other = r"[\x00-\x07\x0b\x0e-\x1f]"
    coded = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(other), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)), "")
    escaped = F.when(out.rlike(other), coded).otherwise(out)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def python_double(x: Column) -> Column:
    """A double's digits in Python's notation: with an exponent below 1e-4 and from 1e16 on."""
    said = x.cast("string")
    sign = F.when(said.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(said, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(said, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    n = F.length(digits)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.lit("."), F.when(n > exponent + 1, F.substring(digits, exponent + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    point = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    science = F.concat(F.substring(digits, 1, 1), point, power)
    moved = F.when(exponent.between(0, 15), whole).when(exponent.between(-4, -1), small).otherwise(science)
    return F.when(F.isnan(x) | said.endswith("Infinity") | ~F.contains(said, F.lit("E")), said).otherwise(F.concat(sign, moved))


def json_text(value: Column, kind: T.DataType, style: Style = PYTHON) -> Column:
    """JSON of a column of this type."""
    return F.coalesce(filled(value, kind, style), F.lit("null"))


def filled(value: Column, kind: T.DataType, style: Style) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(text_literal(F.lit(f.name), style), F.lit(style.colon), json_text(value[f.name], f.dataType, style)) for f in kind.fields]
        return F.when(value.isNotNull(), braced(F.array(*parts), "{", "}", style))
    if isinstance(kind, T.ArrayType):
        return braced(F.transform(value, lambda x: json_text(x, kind.elementType, style)), "[", "]", style)
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(text_literal(e["key"].cast("string"), style), F.lit(style.colon), json_text(e["value"], kind.valueType, style)))
        return braced(pairs, "{", "}", style)
    if isinstance(kind, (T.StringType, T.DateType)):
        return text_literal(value.cast("string"), style)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return text_literal(iso_format(value.cast("timestamp")), style)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return python_double(value.cast("double"))
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType, T.NullType)):
        return value.cast("string")
    raise TypeError(f"no JSON for {kind.simpleString()}")


def text_literal(text: Column, style: Style) -> Column:
    return python_json_string(text) if style.ascii else raw_json_string(text)


def braced(parts: Column, left: str, right: str, style: Style) -> Column:
    return F.concat(F.lit(left), F.array_join(parts, style.comma), F.lit(right))


def with_json(frame: DataFrame, name: str, value: Column, style: Style = PYTHON) -> DataFrame:
    """frame with the JSON of an expression over its columns, whatever its type."""
    return frame.withColumn(name, json_text(value, frame.select(value.alias("v")).schema["v"].dataType, style))
