"""String and regular-expression functions: Column in, Column out, all inside the JVM. Null strings count as empty where noted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def contains(s: Column, part) -> Column:
    return F.contains(_s(s), part if isinstance(part, Column) else F.lit(part))


def starts_with(s: Column, part) -> Column:
    return F.startswith(_s(s), part if isinstance(part, Column) else F.lit(part))


def ends_with(s: Column, part) -> Column:
    return F.endswith(_s(s), part if isinstance(part, Column) else F.lit(part))


def lower(s: Column) -> Column:
    return F.lower(_s(s))


def upper(s: Column) -> Column:
    return F.upper(_s(s))


def regex_match(s: Column, pattern: str) -> Column:
    return _s(s).rlike(_plain(pattern))


def _took_part(s: Column, pattern: str, i: int) -> Column:
    """Whether group i took part in the first match. Where it is empty, a reference to it tells: that fails if it took no part,
    and then matches, if at all, at a later place only."""
    return (F.regexp_extract(s, pattern, i) != "") | (F.regexp_instr(s, F.lit(pattern)) == F.regexp_instr(s, F.lit(rf"(?>{pattern})\{i}")))


def _group(s: Column, pattern: str, i: int) -> Column:
    return F.when(_took_part(s, pattern, i), F.regexp_extract(s, pattern, i))


def regex_extract(s: Column, pattern: str) -> Column:
    """Group 1, or the whole match if there is no group 1 or it took no part; null without a match."""
    s = _s(s)
    whole = F.regexp_extract(s, pattern, 0)
    value = F.coalesce(_group(s, pattern, 1), whole) if re.compile(_python(pattern)).groups else whole
    return F.when(s.rlike(pattern), value)


def regex_replace(s: Column, pattern: str, to: str) -> Column:
    """Every match replaced; $1, ${1}, $name and ${name} stand for groups, $$ for a dollar."""
    names = re.compile(_python(pattern)).groupindex

    def java(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else f"${names[name.replace('.', '__')]}" if name.replace(".", "__") in names else ""

    return F.regexp_replace(_s(s), _plain(pattern), re.sub(r"\$\$|\$\{([\w.]+)\}|\$(\w+)", java, to.replace("\\", "\\\\")))


NAMED = r"\(\?P?<([A-Za-z_][\w.]*)>"


def _plain(pattern: str) -> str:
    """The pattern with plain groups instead of named ones."""
    return re.sub(NAMED, "(", pattern)


def _python(pattern: str) -> str:
    return re.sub(NAMED, lambda m: f"(?P<{m[1].replace('.', '__')}>", pattern)


def regex_parse(s: Column, pattern: str) -> Column:
    """A struct of the named groups, null for those that took no part; dots in names nest; null without a match."""
    names = re.compile(_python(pattern)).groupindex
    s, java = _s(s), _plain(pattern)
    tree: dict = {}
    for name, i in names.items():
        *above, leaf = name.split("__")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[leaf] = _group(s, java, i)
    build = lambda node: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])
    return F.when(s.rlike(java), build(tree))


def length(x: Column, kind: str = "string") -> Column:
    """Characters of a string, bytes of a binary, elements of an array or a map."""
    return {"string": F.length, "binary": F.octet_length}.get(kind, F.size)(x).cast("long")
