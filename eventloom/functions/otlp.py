"""OTLP logs as structs and JSON: decoding, encoding, taking requests apart and merging records.

Structs have snake_case names and numbers; the JSON has camelCase names, 64-bit numbers as text, and trace and span identifiers
as hex text. A value is a struct of which one field is not null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value's scalar forms; arrays and maps of values are kept as their JSON text.
VALUE = "string_value string, bool_value boolean, int_value long, double_value double, bytes_value string, array_value string, kvlist_value string"
_VALUE = f"struct<{VALUE.replace(' ', ':').replace(',:', ', ')}>"
ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
RECORD = f"struct<time_unix_nano:long,observed_time_unix_nano:long,severity_number:int,severity_text:string,body:{_VALUE},attributes:{ATTRS},dropped_attributes_count:int,flags:int,trace_id:string,span_id:string>"
RESOURCE = f"struct<attributes:{ATTRS},dropped_attributes_count:int>"
SCOPE = f"struct<name:string,version:string,attributes:{ATTRS},dropped_attributes_count:int>"
RESOURCE_LOGS = f"struct<resource:{RESOURCE},scope_logs:array<struct<scope:{SCOPE},log_records:array<{RECORD}>,schema_url:string>>,schema_url:string>"
#: Numbers of 64 bits are text in the JSON.
TEXT_NUMBERS = ("time_unix_nano", "observed_time_unix_nano", "int_value")


def _camel(ddl: str) -> str:
    ddl = re.sub(rf"\b({'|'.join(TEXT_NUMBERS)}):long", r"\1:string", ddl)
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), ddl)


def _cast(x: Column, ddl: str) -> Column:
    """The JSON's structs are the same but for names and the text of numbers, so a cast by place does."""
    return x.cast(ddl)


def decode_resource_json(s: Column) -> Column:
    """One ResourceLogs; null where the text is no JSON object."""
    return F.when(F.json_object_keys(s).isNotNull(), _cast(F.from_json(s, _camel(RESOURCE_LOGS)), RESOURCE_LOGS))


def decode_json(s: Column) -> Column:
    """The resource_logs of an export request; null where the text is no JSON object."""
    return F.when(F.json_object_keys(s).isNotNull(), _cast(F.from_json(s, f"struct<resourceLogs:array<{_camel(RESOURCE_LOGS)}>>")["resourceLogs"], f"array<{RESOURCE_LOGS}>"))


def encode_json(resource_logs: Column) -> Column:
    """The JSON of one ResourceLogs; null fields are left out."""
    return F.to_json(_cast(resource_logs, _camel(RESOURCE_LOGS)), {"ignoreNullFields": "true"})


def _filled(ddl: str, **fields: Column) -> Column:
    """A struct of these types, null but for the fields given."""
    depth, part, parts = 0, "", []
    for ch in ddl[len("struct<") : -1] + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(part.strip())
            part = ""
        else:
            part += ch
    kinds = dict(p.split(":", 1) for p in parts)
    return F.struct(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def any_value(**one: Column) -> Column:
    return _filled(_VALUE, **one)


def resource(attributes: Column) -> Column:
    return _filled(RESOURCE, attributes=attributes)


def scope(name: str, version: str | None = None) -> Column:
    return _filled(SCOPE, name=F.lit(name), version=F.lit(version))


def log_record(**fields: Column) -> Column:
    return _filled(RECORD, **fields)


def split(requests: DataFrame, resource_logs: Column) -> DataFrame:
    """A row for each log record, with its resource, scope and schema_url beside it."""
    r = requests.select(F.explode(resource_logs).alias("r"))
    s = r.select(F.col("r.resource").alias("resource"), F.col("r.schema_url").alias("schema_url"), F.explode("r.scope_logs").alias("s"))
    return s.select("resource", F.col("s.scope").alias("scope"), F.coalesce("schema_url", "s.schema_url").alias("schema_url"), F.explode("s.log_records").alias("record"))


def _key(x: Column) -> Column:
    """Attributes in the order of their keys, as text: equal for equal attributes in any order."""
    ordered = F.array_sort(F.transform(x["attributes"], lambda a: F.struct(a["key"].alias("key"), F.to_json(a["value"]).alias("value"))))
    return F.to_json(F.struct(ordered.alias("a"), x["dropped_attributes_count"].alias("n")))


def merge(records: DataFrame, level: str = "resource", most: int = 1000, most_bytes: int = 1_000_000) -> DataFrame:
    """resource_logs: one for each resource (level resource: each record keeps a scope_logs of its own; scope: one scope_logs for
    each scope) from resource, scope, record and schema_url. Of schema_urls the first that isn't empty counts.

    A request has room for `most_bytes` of its records' JSON, of which each takes at least one part in `most`; only its last record
    may go beyond. A resource that fits gets one request, the records of one that doesn't are all dealt over several. Records of
    different `batch`, if there is such a column, don't meet."""
    by = [c for c in ("batch",) if c in records.columns]
    url = F.nullif(F.col("schema_url"), F.lit(""))
    least = max(1, most_bytes // most)
    room = min(least * most, most_bytes)
    rows = records.withColumn("_r", _key(F.col("resource"))).withColumn("_took", F.greatest(F.octet_length(F.to_json(F.struct("scope", "record"))), F.lit(least)).cast("long"))
    # Resources that don't fit are few beside their records. Groups are planned to be four fifths full, as dealing is by chance.
    names = [f"_of_{c}" for c in (*by, "_r")]
    total = rows.groupBy(*[F.col(c).alias(n) for c, n in zip((*by, "_r"), names, strict=True)], url.alias("_url")).agg(F.sum("_took").alias("_total"))
    total = total.groupBy(*names).agg(F.sum("_total").alias("_total"), F.min("_url").alias("_url"))  # apart, as Spark sorts rows to find a least text
    large = total.where(F.col("_total") > room).withColumn("_groups", F.ceil(F.col("_total") / (0.8 * room)))
    same = F.col("_r") == F.col("_of__r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(large), same, "left")
    rows = rows.withColumn("_group", F.when(F.col("_groups").isNotNull(), F.pmod(F.xxhash64("_n"), F.col("_groups"))).otherwise(0))
    before = F.sum("_took").over(Window.partitionBy(*by, "_r", "_group").orderBy("_n")) - F.col("_took")
    rows = rows.withColumn("_part", F.floor(before / room))
    of = [*by, "_r", "_group", "_part"]
    if level == "scope":
        rows = rows.withColumn("_s", F.concat_ws("|", F.col("scope.name"), F.col("scope.version"), _key(F.col("scope"))))
        rows = rows.groupBy(*of, "_s").agg(F.first("resource").alias("resource"), F.first("scope").alias("scope"), F.collect_list("record").alias("log_records"), F.min(url).alias("schema_url"), F.first("_url").alias("_url"))
    else:
        rows = rows.select(*of, "resource", "scope", F.array("record").alias("log_records"), url.alias("schema_url"), "_url")
    one = F.struct("scope", "log_records", "schema_url")
    merged = rows.groupBy(*of).agg(F.first("resource").alias("resource"), F.collect_list(one).alias("scope_logs"), F.coalesce(F.first("_url"), F.min("schema_url")).alias("schema_url"))
    return merged.select(*by, F.struct("resource", "scope_logs", "schema_url").alias("resource_logs"))
