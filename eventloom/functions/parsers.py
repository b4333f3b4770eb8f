"""Parsers of log formats. Each gives null where the text isn't in its format, so that a flow can send it to the dead letters.

A text is cut once and looked at in place (`let`); patterns are possessive and anchored, so that long values neither recurse nor
backtrack. `defaults` fills in what a text doesn't say: keys that are missing or null.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REST = 1 << 30
PRI = r"^<([0-9]{1,3})>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _from(s: Column, at: Column | int) -> Column:
    """The text from a character on, the first being 1."""
    return F.substring(s, at if isinstance(at, Column) else F.lit(at), F.lit(REST))


def extract_pri(s: Column) -> Column:
    return let(F.regexp_extract(s, PRI, 1).try_cast("int"), lambda pri: F.when(pri <= 191, pri))


def strip_pri(s: Column) -> Column:
    return F.when(extract_pri(s).isNotNull(), _from(s, F.locate(">", s) + 1)).otherwise(s)


def set_pri(s: Column, facility: Column, severity: Column) -> Column:
    ok = facility.between(0, 23) & severity.between(0, 7)
    return F.when(ok, F.concat(F.lit("<"), (facility * 8 + severity).cast("string"), F.lit(">"), strip_pri(s)))


def _some(x: Column) -> Column:
    return F.when(~x.isin("", "-"), x)


#: One element of structured data and the spaces behind it, where the one before ended; it may be unfinished.
ELEMENT = r"(?s)\G\[[^\]\\]*+(?:\\.[^\]\\]*+)*+(?:\]|\\?\z)\x20*+"
TAG = r"^[A-Za-z0-9]{1,32}(?:\[[^\]]*+\])?+:(?=\x20|\z)"
FIELDS = ["timestamp", "hostname", "appname", "procid", "msgid", "msg"]


def _new(p: Column) -> list[Column]:
    """FIELDS of the new format; p: the text behind the PRI, cut at its first six spaces."""
    data = lambda r: F.when(F.startswith(r, F.lit("[")), F.regexp_replace(r, ELEMENT, "")).when(F.startswith(r, F.lit("-")), F.ltrim(_from(r, 2))).otherwise(r)
    msg = let(let(F.ltrim(F.get(p, F.lit(6))), data), lambda m: F.when(m != "", m))
    return [*(_some(F.get(p, F.lit(i))) for i in range(1, 6)), msg]


def syslog_parse(s: Column, defaults: dict[str, Column] | None = None) -> Column:
    """pri, facility, severity and FIELDS of a line in the new or the old syslog format; null without a valid PRI. The old
    format's time runs to the third space."""

    def record(pri: Column, fields: list[Column]) -> Column:
        fill = lambda name, x: F.coalesce(x, defaults[name].cast("string")) if defaults and name in defaults else x
        return F.struct(pri.alias("pri"), F.shiftright(pri, 3).alias("facility"), pri.bitwiseAND(F.lit(7)).alias("severity"), *(fill(n, f).alias(n) for n, f in zip(FIELDS, fields, strict=True)))

    def old(pri: Column, rest: Column, upto: Column) -> Column:
        timed = F.length(upto) < F.length(rest)
        timestamp = F.when(timed, let(F.trim(upto), _some))
        body = F.ltrim(F.when(timed, _from(rest, F.length(upto) + 2)).otherwise(rest))

        def fields(host: Column, tail: Column, head: Column, app: Column) -> Column:
            pid = F.when(F.endswith(head, F.lit("]:")), let(F.substring(head, F.length(app) + 2, F.length(head) - F.length(app) - 3), _some))
            msg = F.when(head == "", tail).otherwise(_from(tail, F.length(head) + 2))
            return record(pri, [timestamp, _some(host), F.when(app != "", app), pid, F.lit(None).cast("string"), F.nullif(msg, F.lit(""))])

        tag = lambda head: F.rtrim(F.substring_index(head, "[", 1), F.lit(":"))
        from_tail = lambda host: lambda tail: let(F.regexp_extract(tail, TAG, 0), lambda head: let(tag(head), lambda app: fields(host, tail, head, app)))
        return let(body, lambda b: let(F.substring_index(b, " ", 1), lambda host: let(F.ltrim(_from(b, F.length(host) + 2)), from_tail(host))))

    def body(pri: Column, rest: Column) -> Column:
        is_new = F.substring(rest, 1, 2).isin(*[f"{i} " for i in range(10)])
        return F.when(is_new, let(F.split(rest, " ", 7), lambda p: record(pri, _new(p)))).otherwise(let(F.substring_index(rest, " ", 3), lambda upto: old(pri, rest, upto)))

    def line(s: Column) -> Column:
        rest = _from(s, F.locate(">", s) + 1)
        return let(F.regexp_extract(s, PRI, 1).try_cast("int"), lambda pri: F.when(pri <= 191, let(rest, lambda r: body(pri, r))))

    return let(s, line)


def first_wins(entries: Column) -> Column:
    """A map from an array of structs (k, v); of equal keys the first counts. Work grows with n log n."""

    def distinct(e: Column) -> Column:
        order = F.array_sort(F.transform(e, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
        first = lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["k"] != x["k"]))
        return F.transform(let(order, first), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))

    keys = lambda e: F.transform(e, lambda x: x["k"])
    return let(entries, lambda e: F.map_from_entries(F.when(F.size(F.array_distinct(keys(e))) == F.size(e), e).otherwise(distinct(e))))


def _filled(found: Column, defaults: dict[str, Column] | None) -> Column:
    if not defaults:
        return found
    rest = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))])
    return let(found, lambda m: F.when(m.isNotNull(), F.map_concat(m, F.map_filter(rest, lambda k, v: ~F.map_contains_key(m, k)))))


def parse_kv(s: Column, sep: str = " ", defaults: dict[str, Column] | None = None) -> Column:
    """key=value tokens as a map; values in double quotes may hold the separator, and aren't unescaped; one without its closing
    quote runs to the end. Tokens without = or key are passed over."""
    if len(sep) != 1 or not sep.isascii():
        raise ValueError("the separator must be one ASCII character")
    c = rf"\x{ord(sep):02x}"
    body = r'[^"\\]*+(?:\\.[^"\\]*+)*+\\?+'
    # A key starts behind a separator, or where the token before ended.
    quoted = rf'(?s)(?:\G|(?<={c}))[^={c}]*+=(?:"{body}(?:"|\z)|[^{c}]*+)'
    tokens = lambda s: F.when(F.contains(s, F.lit('"')), F.regexp_extract_all(s, F.lit(quoted), F.lit(0))).otherwise(F.split(s, sep if sep.isalnum() or sep in " ,;" else c))

    def pair(t: Column) -> Column:
        def split(k: Column) -> Column:
            v = _from(t, F.length(k) + 2)
            return F.struct(k.alias("k"), F.when(F.startswith(v, F.lit('"')), F.regexp_replace(v, rf'(?s)^"({body})(?:"|\z).*$', "$1")).otherwise(v).alias("v"))

        return let(F.substring_index(t, "=", 1), split)

    some = lambda tokens: F.filter(tokens, lambda t: F.locate("=", t) > 1)
    return let(s, lambda s: _filled(F.when(s.isNotNull(), first_wins(F.transform(some(tokens(s)), pair))), defaults))


def csv_parse(s: Column, names: list[str]) -> Column:
    """One record as a struct: empty or missing fields are null, further ones are left out; an empty name skips a field."""
    full = [n or f"_skip{i}" for i, n in enumerate(names)]
    row = F.from_csv(s, ", ".join(f"`{n}` string" for n in full), {"mode": "PERMISSIVE", "nullValue": "", "escape": '"'})
    return F.when(s.isNotNull(), let(row, lambda r: F.struct(*[F.nullif(r[n], F.lit("")).alias(n) for n in full if not n.startswith("_skip")])))


KEY_LETTERS = string.ascii_letters + string.digits + "_"
CEF_HEADER = ["version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]


def cef_parse(s: Column, defaults: dict[str, Column] | None = None) -> Column:
    """The header's seven parts, severity as a number too (severity_id, null where it is none), and the extensions as a map; a
    value runs to the next key behind a space. The text starts with CEF:, so a syslog header goes before. Nothing is unescaped."""
    first = r"(?s)(?<![A-Za-z0-9_])[A-Za-z0-9_]++=.*+$"
    pair = lambda t: let(F.substring_index(t, "=", 1), lambda k: F.struct(k.alias("k"), F.trim(_from(t, F.length(k) + 2)).alias("v")))

    def record(p: Column) -> Column:
        number = F.when(F.get(p, F.lit(6)).rlike(r"^[+-]?[0-9]+$"), F.get(p, F.lit(6)).try_cast("long"))
        header = [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(CEF_HEADER[:-1])]
        # Mostly the first key stands first; else what is before it goes.
        tail = let(F.get(p, F.lit(7)), lambda t: F.when((F.locate("=", t) > 1) & (F.translate(F.substring_index(t, "=", 1), KEY_LETTERS, "") == ""), t).otherwise(F.regexp_extract(t, first, 0)))
        tokens = let(tail, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\x20(?=[A-Za-z0-9_]++=)")))
        return F.struct(*header, F.coalesce(number.cast("string"), F.get(p, F.lit(6))).alias("severity"), number.alias("severity_id"), _filled(first_wins(F.transform(tokens, pair)), defaults).alias("extensions"))

    return let(s, lambda s: F.when(F.startswith(s, F.lit("CEF:")), let(F.split(_from(s, 5), r"\|", 8), lambda p: F.when(F.size(p) == 8, record(p)))))


#: A key that starts with $ where JSON has one: reserved, but for doubled ones and the form of bytes.
RESERVED = r'[{,]\s*+"\$(?!\$|bytes_b64"\s*+:)[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:'


def parse_json(s: Column, schema: str, defaults: dict[str, Column] | None = None) -> Column:
    """A struct by schema; other JSON than an object is its field _json, as text, if the schema has it. Null where the text is no
    JSON or has a reserved key."""
    import re

    names = re.findall(r"(?:^|,)\s*`?(\w+)`?[ :]", re.sub(r"[<(][^<>()]*[>)]", "", re.sub(r"<[^<>]*>", "", schema)))
    value = F.from_json(s, schema)
    whole = F.when(F.json_object_keys(s).isNull(), F.trim(s))

    def field(v: Column, n: str) -> Column:
        x = F.coalesce(whole, v[n]) if n == "_json" else v[n]
        return (F.coalesce(x, defaults[n]) if defaults and n in defaults else x).alias(n)

    rich = bool(defaults) or "_json" in names
    valid = F.json_object_keys(s).isNotNull() if "_json" not in names else F.try_parse_json(s).isNotNull()
    found = let(value, lambda v: F.struct(*[field(v, n) for n in names])) if rich else value
    return F.when(valid & ~F.coalesce(s.rlike(RESERVED), F.lit(False)), found)
