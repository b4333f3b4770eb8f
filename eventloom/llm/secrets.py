"""Secret scan with linking of multipart credentials, DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weak kinds (user, blob, endpoint) are too common to report alone: each is
a part of a credential with a role (access identifier, secret, endpoint), and is reported only where the complementary parts
occur within `scope` code points. With `gaps`, nearness is the gap between the parts, however long they are (0 where they touch
or overlap); without, the distance of their starts, which a long part in front uses up. Parts are joined by interval, by a sweep
over a text's parts: of the parts of a role that start no later than `scope` behind a weak part, the largest end decides exactly
whether one is near. A part gives a row and a weak part one more; no pairs of parts arise.

Texts are scanned once; their spans, a small table, wait in the shared folder. A weak part that overlaps a base one is part of it
and is left out.

Results for special cases: a null text counts as empty (no spans, the digest of the empty string); repeated rows, equal or null
identifiers are scanned row by row; very long texts are whole, with work in proportion to their matches; of parts at one place the
order of kinds decides, of partners that end alike the one that starts last; an empty table gives an empty result; other columns
are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, saved

KINDS = ["assign", "access", "hex", "user", "blob", "endpoint"]
ROLE = {"assign": "secret", "access": "access", "hex": "secret", "user": "access", "blob": "secret", "endpoint": "endpoint"}
#: What must be near for a weak part to be reported.
NEEDS = {"user": ["secret"], "blob": ["access"], "endpoint": ["access", "secret"]}
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # A run that is too short can't hold a longer one, so the least length may stand in the pattern here.
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "user": r"""(?i:client_id|access_key_id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""",
    "blob": r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=_.-])",
    "endpoint": r"""(?i:https?|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)(?::[a-z]+)?://[^\x20\x09-\x0D"'<>]+""",
}
SPAN = "struct<start:int,k:int,end:int>"


CHUNK = 256


def spans_of(text: Column, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches of a kind, in code points: the gaps between matches, as split() returns
    them, and the matches themselves give the places by their lengths. Lengths are added up in chunks, so that a text with very many
    matches doesn't copy its list for each."""
    pattern, k = PATTERNS[kind], KINDS.index(kind)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    parts = F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("end"))
        ok = x["m"].isNotNull() & (F.length(x["v"]) >= 8 if kind == "assign" else F.lit(True))
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def added(all_parts):
        def chunk(acc, c):
            joined_on = lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out"))
            return F.aggregate(F.slice(all_parts, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), step, joined_on)

        chunks = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), chunk)["out"]

    return F.when(text.rlike(pattern), let(parts, added)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def apart(parts: DataFrame, key: list[str]) -> DataFrame:
    """parts without the weak ones that overlap a base one. A sweep: of the base parts that start before a weak part ends, the
    largest end decides whether one reaches into it."""
    weak = F.col("k") >= 3
    at = F.when(weak, F.col("end") - 1).otherwise(F.col("start")).cast("long")
    passed = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    points = parts.withColumn("at", at).withColumn("reach", F.max(F.when(~weak, F.col("end"))).over(passed))
    return points.where(~weak | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("at", "reach")


def linked(parts: DataFrame, key: list[str], scope: int, gaps: bool = False) -> DataFrame:
    """Of parts (key, start, k, end, role), the weak ones that have all complementary roles within scope: key, span, and partners
    (of each needed role the near part that ends last).

    The interval join: each part stands at its start, each weak part asks once more at its end plus the scope, where all parts
    that start in time have been passed."""
    last = F.col("end" if gaps else "start")
    stands, asks = F.struct(F.col("start").cast("long").alias("at"), F.lit(False).alias("asks")), F.struct((last + scope).cast("long").alias("at"), F.lit(True).alias("asks"))
    points = parts.withColumn("p", F.explode(F.when(F.col("k") >= 3, F.array(stands, asks)).otherwise(F.array(stands)))).select("*", "p.at", "p.asks")
    passed = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    roles = sorted(set(ROLE.values()))
    own = F.struct(last.alias("last"), F.col("start").cast("int").alias("start"), F.col("k").cast("int").alias("k"), F.col("end").cast("int").alias("end"))
    points = points.select("*", *[F.max(F.when(~F.col("asks") & (F.col("role") == r), own)).over(passed).alias(f"_{r}") for r in roles])
    within = lambda role: F.coalesce(F.col(f"_{role}")["last"] >= F.col("start") - scope, F.lit(False))
    ok, partners = F.lit(False), F.array().cast(f"array<{SPAN}>")
    span = lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))
    for kind, needed in NEEDS.items():
        here = F.col("k") == KINDS.index(kind)
        partners = F.when(here, F.array(*[span(F.col(f"_{r}")) for r in needed])).otherwise(partners)
        for role in needed:
            here = here & within(role)
        ok = ok | here
    return points.where(F.col("asks") & ok).select(*key, F.struct(F.col("start").cast("int").alias("start"), F.col("k").cast("int").alias("k"), F.col("end").cast("int").alias("end")).alias("span"), partners.alias("partners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, gaps: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, links (each reported weak part
    with its partners, as part>partner, comma-joined)."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("_text").alias("_h"), F.length(text).alias("_len"), *[spans_of(text, k).alias(k) for k in KINDS])
    rows = rows.select("doc_id", "_h", "_len", F.concat(*KINDS[:3]).alias("base"), F.concat(*KINDS[3:]).alias("weak"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]])
    # A null identifier gets a place of its own beside all others.
    rows = saved(rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))), "spans")
    key = ["_id", "_h", "_len"]
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("s.k") + 1)
    parts = rows.where(F.size("weak") > 0).dropDuplicates(key).select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(*key, "s.start", "s.k", "s.end", role.alias("role"))
    more = linked(apart(parts, key), key, scope, gaps).groupBy(*key).agg(F.collect_list(F.struct("span", "partners")).alias("found"))
    more = more.select(*key, F.col("found.span").alias("more"), F.flatten(F.transform("found", lambda f: F.transform(f["partners"], lambda p: F.struct(f["span"].alias("a"), p.alias("b"))))).alias("pairs"))
    out = rows.join(more, key, "left")
    link = F.transform(F.array_sort("pairs"), lambda p: F.concat_ws(">", joined(F.array(p["a"])), joined(F.array(p["b"]))))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.concat_ws(",", link), F.lit("")).alias("links"),
    )
