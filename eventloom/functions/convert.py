"""Conversion, hashing, arrays and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

coalesce, append, prepend = F.coalesce, F.array_append, F.array_prepend


def to_int(x: Column, kind: str = "string") -> Column:
    """bool: 0 or 1; double: truncated, the nearest 64-bit integer where it is out of their range, null where it isn't finite;
    timestamp: nanoseconds; string: trimmed 64-bit integer or null."""
    if kind == "timestamp":
        return F.unix_micros(x) * 1000
    if kind == "string":
        return F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))
    if kind == "double":
        top, low = F.lit(2**63 - 1), F.lit(-(2**63))
        return F.when(F.abs(x) < float("inf"), F.when(x >= 2.0**63, top).when(x <= -(2.0**63), low).otherwise(F.when(F.abs(x) < 2.0**63, x).cast("long")))
    return x.cast("long")


def to_json(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def null_omit_json(x: Column) -> Column:
    """JSON of a struct without its null fields, at every depth."""
    return F.to_json(x, {"ignoreNullFields": "true"})


def find_by(array: Column, key: str, value: Column) -> Column:
    """The first element whose field equals value, else null."""
    return F.get(F.filter(array, lambda x: x[key].eqNullSafe(value)), F.lit(0))


def to_bytes(s: Column, encoding: str = "utf8") -> Column:
    return F.try_to_binary(s, F.lit({"utf8": "utf-8"}.get(encoding, encoding)))


def to_string(b: Column, encoding: str = "utf8", strict: bool = False) -> Column:
    if encoding == "hex":
        return F.lower(F.hex(b))
    if encoding == "base64":
        return F.base64(b)
    return F.try_validate_utf8(b.cast("string")) if strict else F.make_valid_utf8(b.cast("string"))


def md5(x: Column) -> Column:
    return F.md5(F.coalesce(x.cast("string"), F.lit("")))


def sha1(x: Column) -> Column:
    return F.sha1(F.coalesce(x.cast("string"), F.lit("")))


def sha256(x: Column) -> Column:
    return F.sha2(F.coalesce(x.cast("string"), F.lit("")), 256)


#: strftime's letters as Spark writes them. Fixed values.
LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "y": "yy", "I": "hh", "p": "a", "z": "xx", "f": "SSSSSSSSS", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def pattern(fmt: str) -> str:
    """strftime's format as Spark's."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] != "%" and fmt[i + 1] not in LETTERS:
                raise ValueError(f"%{fmt[i + 1]} is not known in a time format")
            out += "%" if fmt[i + 1] == "%" else LETTERS[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return out


def strftime(ts: Column, fmt: str, tz: str = "UTC") -> Column:
    """A timestamp's text in a time zone (by name or offset), whatever the session's zone is."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz")), pattern(fmt))


def strptime(s: Column, fmt: str, tz: str = "UTC") -> Column:
    """The timestamp that a text in a time zone means, null where it doesn't fit; a format with %z says the zone itself. The
    session's zone plays no part."""
    if "%z" in fmt:
        return F.try_to_timestamp(s, F.lit(pattern(fmt)))
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(s, F.lit(" +00:00")), F.lit(pattern(fmt) + " XXX")), tz)


def now() -> Column:
    """The clock's time, one for the whole query."""
    return F.current_timestamp()


def hostname() -> Column:
    import socket

    return F.lit(socket.gethostname())


def version() -> Column:
    from eventloom import VERSION

    return F.lit(VERSION)
