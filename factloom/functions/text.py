"""Text and number idioms as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript counts it (wider than Java's class and than trim()).
WS = r"[\t\n\x0B\f\r\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NO_TEXTS = "array<string>"


def bound(value: Column, body) -> Column:
    """body(value), with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def collapsed(text: Column) -> Column:
    """Trimmed, inner runs of white space as one blank."""
    return F.regexp_replace(trimmed(text), f"{WS}+", " ")


def non_empty(text: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """The whole text matches; unlike ``$``, the end is the very end."""
    return text.rlike(rf"\A(?:{pattern})\z")


def utf16_length(text: Column) -> Column:
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def distinct_ignoring_case(texts: Column) -> Column:
    """First spellings, in order."""
    first = lambda t, keys: F.filter(t, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return bound(texts, lambda t: bound(F.transform(t, F.lower), lambda keys: first(t, keys)))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round4(x: Column) -> Column:
    """Half up on the double times 10,000; round(x, 4) would go by the decimal digits."""
    return F.floor(x * 10000.0 + 0.5) / 10000.0


def mean(values: Column) -> Column:
    """Sum in order over the number; 0 if empty. In order, so that doubles add up the same each time."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def merge_path(path: Column) -> Column:
    """A field path with its indices erased, lower case: what facts are merged by."""
    return F.lower(trimmed(F.regexp_replace(path, r"\[[0-9]+\]", "[]")))


def match_path(path: Column) -> Column:
    """As merge_path, underscores erased too: what provenance and weights are looked up by."""
    return trimmed(F.lower(F.replace(F.regexp_replace(path, r"\[[0-9]+\]", "[]"), F.lit("_"), F.lit(""))))


def serialised(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """A value's stable text: null is `null`, lists are `[a,b]`, records and maps `{k:v}` in the order of their keys, nothing is quoted.

    A record's null fields count as null, since records have no absent ones; whole numbers of doubles have no point.
    """
    if isinstance(kind, T.ArrayType):
        found = _joined("[", F.transform(value, lambda x: serialised(x, kind.elementType)), "]")
    elif isinstance(kind, T.StructType):
        # Lower case before upper case, as the collation of the maps' keys has it.
        names = sorted(kind.fieldNames(), key=lambda n: (n.lower(), n.swapcase()))
        found = F.when(value.isNotNull(), _joined("{", F.array(*(_entry(F.lit(n), value[n], kind[n].dataType) for n in names)), "}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(F.collate(e["key"].cast("string"), "UNICODE").alias("place"), e["key"].cast("string").alias("key"), e["value"].alias("value")))
        in_order = F.array_sort(entries, lambda x, y: F.when(x["place"] < y["place"], F.lit(-1)).when(x["place"] > y["place"], F.lit(1)).otherwise(F.lit(0)))
        found = _joined("{", F.transform(in_order, lambda e: _entry(e["key"], e["value"], kind.valueType)), "}")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        found = F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    else:
        found = value.cast("string")
    return F.coalesce(found, F.lit("null"))


def _entry(key: Column, value: Column, kind: T.DataType) -> Column:
    return F.concat(key, F.lit(":"), serialised(value, kind))


def _joined(begin: str, texts: Column, end: str) -> Column:
    return F.concat(F.lit(begin), F.array_join(texts, ","), F.lit(end))


def to_number(text: Column) -> Column:
    """A text as a number: blank is 0, hexadecimal and exponents count, anything else or infinite is null."""
    return bound(trimmed(text), _number)


def _number(t: Column) -> Column:
    decimal = F.when(matches(t, r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"), t.try_cast("double"))
    hexadecimal = F.when(matches(t, "0[xX][0-9A-Fa-f]{1,15}"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
    found = F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(decimal, hexadecimal))
    return F.when(F.abs(found) < float("inf"), found)
