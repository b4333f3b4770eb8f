"""Operators that coerce: values come as (column, kind), kind being null, bool, int, float, string, bytes, timestamp, array, object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = tuple[Column, str]
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def truth(x: Value) -> Column:
    """null, false, 0, NaN and what is empty are false; timestamps are true."""
    c, kind = x
    if kind == "null":
        return F.lit(False)
    test = {"bool": c, "int": c != 0, "float": (c != 0) & ~F.isnan(c), "string": c != "", "bytes": F.octet_length(c) > 0, "timestamp": c.isNotNull(), "array": F.size(c) > 0, "object": c.isNotNull()}[kind]
    return F.coalesce(test, F.lit(False))


def number(x: Value) -> Column:
    """As a double: true is 1, a string its number, anything else 0."""
    c, kind = x
    if kind in ("int", "float", "bool"):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if kind == "string":
        t = F.trim(c)
        return F.coalesce(F.when(t.rlike(NUMBER), t.try_cast("double")), F.lit(0.0))
    return F.lit(0.0)


def said(x: Value) -> Column:
    """As text: null is empty, a whole double prints as an integer, arrays and objects as [a, b] and {k: v}."""
    c, kind = x
    if kind == "null":
        return F.lit("")
    if kind == "float":
        text = F.when((F.abs(c) < 1e15) & (c == F.floor(c)), F.floor(c).cast("string")).otherwise(c.cast("string"))
    elif kind == "bytes":
        text = F.when(c.isNotNull(), "<bytes>")
    elif kind == "timestamp":
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def template(*parts: str | Value) -> Column:
    """Text with values in it; bytes can't stand there."""
    if any(not isinstance(p, str) and p[1] == "bytes" for p in parts):
        raise TypeError("bytes can't stand in a text")
    return F.concat(*[F.lit(p) if isinstance(p, str) else said(p) for p in parts])


def plus(a: Value, b: Value) -> Column:
    """Bytes are joined with bytes; with a string both are text and are joined; else both are numbers."""
    kinds = a[1], b[1]
    if "bytes" in kinds:
        if kinds != ("bytes", "bytes"):
            raise TypeError("bytes are joined with bytes only")
        return F.concat(a[0], b[0])
    return F.concat(said(a), said(b)) if "string" in kinds else _narrow(number(a) + number(b))


def _narrow(x: Column) -> Column:
    """What isn't finite is null."""
    return F.when(F.abs(x) < float("inf"), x)


def minus(a: Value, b: Value) -> Column:
    return _narrow(number(a) - number(b))


def times(a: Value, b: Value) -> Column:
    return _narrow(number(a) * number(b))


def over(a: Value, b: Value) -> Column:
    """By zero: 0."""
    return F.when(number(b) == 0, F.lit(0.0)).otherwise(_narrow(number(a) / F.nullif(number(b), F.lit(0.0))))


def rest(a: Value, b: Value) -> Column:
    """By zero: 0."""
    return F.when(number(b) == 0, F.lit(0.0)).otherwise(_narrow(number(a) % F.nullif(number(b), F.lit(0.0))))


def negative(a: Value) -> Column:
    return _narrow(-number(a))


def less(a: Value, b: Value) -> Column:
    """Numbers with numbers and bytes with bytes; anything else isn't less."""
    if {a[1], b[1]} <= {"int", "float"} or (a[1], b[1]) == ("bytes", "bytes"):
        return F.coalesce(a[0] < b[0], F.lit(False))
    return F.lit(False)


def equal(a: Value, b: Value) -> Column:
    """Of one kind, or both numbers, and equal; null equals null; timestamps equal nothing."""
    if a[1] == b[1] == "null":
        return F.lit(True)
    if a[1] != b[1] and not {a[1], b[1]} <= {"int", "float"} or a[1] == "timestamp":
        return a[0].isNull() & b[0].isNull() if a[1] != "timestamp" else F.lit(False)
    return a[0].eqNullSafe(b[0])
