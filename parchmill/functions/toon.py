"""TOON text as Column expressions, chosen from the Spark type of each field.

TOON is a compact ``key: value`` notation. Strings are quoted only where
needed, numbers never use an exponent, arrays of records become a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that force quotes, escapes, and the last-byte
# values (as hex) that count as trailing white space.
_SPECIAL = r'[,|\t:\[\]{}\-\\"\n\r]'
_LEADING_SPACE = r"^[\t\n\x0b\f\r ]"
_TRAILING_SPACE_BYTES = ["09", "0A", "0B", "0C", "0D", "20", "85", "A0"]
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
INDENT = "  "


def needs_quoting(text: Column) -> Column:
    last_byte = F.hex(F.substring(text.cast("binary"), -1, 1))
    return (
        (text == "")
        | text.rlike(_SPECIAL)
        | text.rlike(_LEADING_SPACE)
        | last_byte.isin(_TRAILING_SPACE_BYTES)
    )


def quote(text: Column) -> Column:
    out = text
    for char, escaped in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def toon_string(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("null")).when(needs_quoting(text), quote(text)).otherwise(text)


def _plain_digits(scientific: Column) -> Column:
    """Rewrite ``d.dddE±n`` without an exponent, as text, so no digit is lost."""
    sign = F.regexp_extract(scientific, r"^(-?)", 1)
    whole = F.regexp_extract(scientific, r"^-?(\d)", 1)
    fraction = F.regexp_replace(F.regexp_extract(scientific, r"\.(\d+)E", 1), r"0+$", "")
    power = F.regexp_extract(scientific, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(whole, fraction)
    size = F.length(digits)
    large = F.when(power >= size - 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.concat(sign, F.when(power >= 0, large).otherwise(small))


def toon_double(value: Column) -> Column:
    """Shortest plain decimal; NaN and infinities are ``null``, minus zero is ``0``."""
    value = value.cast("double")
    text = value.cast("string")
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null"))
        .when(value == 0.0, F.lit("0"))
        .when(F.contains(text, F.lit("E")), _plain_digits(text))
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


def _decimal(value: Column) -> Column:
    plain = F.format_string("%s", value.cast("string"))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def toon_number(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return toon_double(value)
    text = _decimal(value) if isinstance(data_type, T.DecimalType) else value.cast("string")
    return F.coalesce(text, F.lit("null"))


def toon_bool(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def toon_scalar(value: Column, data_type: T.DataType) -> Column:
    """One value on one line; nested values fall back to quoted JSON."""
    if isinstance(data_type, T.StringType):
        return toon_string(value)
    if isinstance(data_type, T.BooleanType):
        return toon_bool(value)
    if isinstance(data_type, T.NumericType):
        return toon_number(value, data_type)
    if isinstance(data_type, T.NullType):
        return F.lit("null")
    if isinstance(data_type, (T.StructType, T.MapType, T.ArrayType)):
        return toon_string(F.to_json(value))
    return toon_string(value.cast("string"))


def _entry(prefix: str, key: str | Column, value: Column, data_type: T.DataType, depth: int) -> Column:
    name = toon_string(F.lit(key) if isinstance(key, str) else key)
    if isinstance(data_type, (T.StructType, T.MapType)):
        nested = toon_value(value, data_type, depth + 1)
        body = F.when(value.isNull(), F.lit(" null")).otherwise(
            F.when(nested == "", F.lit("")).otherwise(F.concat(F.lit("\n"), nested))
        )
        return F.concat(F.lit(prefix), name, F.lit(":"), body)
    return F.concat(F.lit(prefix), name, F.lit(": "), toon_value(value, data_type, depth))


def toon_object(value: Column, data_type: T.DataType, depth: int = 0) -> Column:
    """``key: value`` lines; nested objects are indented below their key."""
    prefix = INDENT * depth
    if isinstance(data_type, T.StructType):
        lines = [_entry(prefix, f.name, value[f.name], f.dataType, depth) for f in data_type.fields]
        return F.concat_ws("\n", *lines) if lines else F.lit("")
    entries = F.transform(
        F.map_entries(value),
        lambda e: _entry(prefix, e["key"].cast("string"), e["value"], data_type.valueType, depth),
    )
    return F.array_join(entries, "\n")


def toon_row(value: Column, fields: list[T.StructField]) -> Column:
    """The cells of one table row, comma separated."""
    cells = [toon_scalar(value[f.name], f.dataType) for f in fields]
    return F.concat(*[part for c in cells for part in (F.lit(","), c)][1:]) if cells else F.lit("")


def table_header(count: Column, fields: list[str]) -> Column:
    return F.concat(F.lit("results["), count.cast("string"), F.lit("]{" + ",".join(fields) + "}:"))


def toon_list(value: Column, data_type: T.ArrayType) -> Column:
    """An array: ``0`` when empty, a table for records, else one ``- item`` per line."""
    item = data_type.elementType
    if isinstance(item, T.StructType):
        names = [f.name for f in item.fields]
        rows = F.transform(value, lambda v: F.concat(F.lit(INDENT), toon_row(v, item.fields)))
        body = F.concat(table_header(F.size(value), names), F.lit("\n"), F.array_join(rows, "\n"))
    else:
        lines = F.transform(value, lambda v: F.concat(F.lit(INDENT + "- "), toon_scalar(v, item), F.lit("\n")))
        body = F.concat(F.size(value).cast("string"), F.lit(":\n"), F.array_join(lines, "\n"))
    return F.when(value.isNull(), F.lit("null")).when(F.size(value) == 0, F.lit("0")).otherwise(body)


def toon_value(value: Column, data_type: T.DataType, depth: int = 0) -> Column:
    """Any value, by its Spark type."""
    if isinstance(data_type, (T.StructType, T.MapType)):
        return toon_object(value, data_type, depth)
    if isinstance(data_type, T.ArrayType):
        return toon_list(value, data_type)
    return toon_scalar(value, data_type)


def without_final_newlines(text: Column) -> Column:
    """A finished TOON document never ends in a newline."""
    return F.regexp_replace(text, r"\n+$", "")
