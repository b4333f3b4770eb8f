"""Queries over the given tables, and the SQL that gives the same rows. Log lines are made of the events' columns, so that SQL
can say what a parser must find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import convert, parsers, text
from eventloom.operators import tables
from eventloom.operators.flow import Flow

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _str(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _flow(spark, sf_dir) -> Flow:
    """props parsed, errors dead-lettered, views dropped, the rest routed by type."""
    flow = Flow(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), "route")
    flow = flow.parse("props", "k", parsers.parse_json(F.col("props"), "k long")["k"], "no k in props")
    flow = flow.error_if(F.col("value") > 90, "value too large").drop_if((F.col("event_type") == "view") & (F.col("k") % 2 == 0))
    body = convert.to_json(F.struct("event_id", "user_id", "k"))
    return flow.switch(F.col("event_type"), {"click": ("clicks", body), "purchase": ("sales", body)}, ("rest", body))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_OUTCOME = f"CASE WHEN {_K} IS NULL OR value > 90 THEN 'errored' WHEN event_type = 'view' AND {_K} % 2 = 0 THEN 'dropped' ELSE 'finished' END"


@query(f"SELECT event_id, {_K} AS k, {_OUTCOME} AS outcome FROM events")
def pipeline_route(spark, sf_dir):
    return _flow(spark, sf_dir).result().select("event_id", "k", F.col("_outcome").alias("outcome"))


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'sales' ELSE 'rest' END AS output,
  '{{"event_id":' || event_id || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || ',"k":' || {_K} || '}}' AS payload FROM events WHERE {_OUTCOME} = 'finished'""")
def pipeline_outputs(spark, sf_dir):
    return _flow(spark, sf_dir).shipped("event_id")


@query(f"SELECT outcome, count(*) AS events FROM (SELECT {_OUTCOME} AS outcome FROM events) GROUP BY outcome")
def pipeline_counters(spark, sf_dir):
    return _flow(spark, sf_dir).counters()


@query(f"SELECT event_id, CASE WHEN {_K} IS NULL THEN 'process failed: no k in props' ELSE 'value too large' END AS reason, CASE WHEN {_K} IS NULL THEN 'props' ELSE '(pipeline)' END AS process, 'route' AS pipeline FROM events WHERE {_OUTCOME} = 'errored'")
def dead_letters(spark, sf_dir):
    return _flow(spark, sf_dir).dead_letters().select(F.get_json_object("event", "$.event_id").cast("long").alias("event_id"), "reason", "process", "pipeline")


@query("SELECT event_id, event_type || CASE WHEN value > 90 THEN '!' ELSE '' END AS label FROM events")
def pipeline_recover(spark, sf_dir):
    flow = Flow(read(spark, sf_dir, "events").select("event_id", "event_type", "value")).set(label=F.col("event_type"))
    flow = flow.error_if(F.col("value") > 90, "value too large", "check").recover("check", label=_str(F.col("event_type"), "!"))
    return flow.result().select("event_id", "label")


def _pri():
    return F.pmod("event_id", F.lit(192)).cast("int")


@query("""SELECT event_id, (event_id % 192)::INT AS pri, (event_id % 192 // 8)::INT AS facility, (event_id % 8)::INT AS severity, 'Feb 21 04:05:06' AS timestamp, 'host' || (user_id % 5) AS hostname,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'app' END AS appname, CASE WHEN event_id % 3 = 1 THEN user_id::VARCHAR END AS procid, CASE WHEN event_id % 3 = 0 THEN 'plain ' ELSE '' END || event_type AS msg FROM events""")
def syslog_old(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    tag = F.when(F.col("event_id") % 3 == 0, "plain ").when(F.col("event_id") % 3 == 1, _str("app[", F.col("user_id").cast("string"), "]: ")).otherwise("app: ")
    line = _str("<", _pri().cast("string"), ">Feb 21 04:05:06 host", (F.col("user_id") % 5).cast("string"), " ", tag, F.col("event_type"))
    return e.select("event_id", parsers.syslog_parse(line).alias("s")).select("event_id", *[f"s.{c}" for c in ("pri", "facility", "severity", "timestamp", "hostname", "appname", "procid", "msg")])


@query("""SELECT event_id, (event_id % 192)::INT AS pri, '2027-02-21T04:05:06Z' AS timestamp, 'h' || (user_id % 5) AS hostname, event_type AS appname, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS procid,
  'id' || (event_id % 7) AS msgid, 'value ' || (event_id * 3) AS msg FROM events""")
def syslog_new(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    proc = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("-")
    data = F.when(F.col("event_id") % 4 == 0, r'[x@1 a="b \] c"][y k="v"]').otherwise("-")
    line = _str("<", _pri().cast("string"), ">1 2027-02-21T04:05:06Z h", (F.col("user_id") % 5).cast("string"), " ", F.col("event_type"), " ", proc, " id", (F.col("event_id") % 7).cast("string"), " ", data, " value ", (F.col("event_id") * 3).cast("string"))
    return e.select("event_id", parsers.syslog_parse(line).alias("s")).select("event_id", *[f"s.{c}" for c in ("pri", "timestamp", "hostname", "appname", "procid", "msgid", "msg")])


@query("SELECT event_id, CASE WHEN event_id % 250 <= 191 THEN (event_id % 250)::INT END AS pri, CASE WHEN event_id % 250 <= 191 THEN event_type ELSE '<' || (event_id % 250) || '>' || event_type END AS bare, '<165>' || CASE WHEN event_id % 250 <= 191 THEN event_type ELSE '<' || (event_id % 250) || '>' || event_type END AS again FROM events")
def syslog_priority(spark, sf_dir):
    line = _str("<", (F.col("event_id") % 250).cast("string"), ">", F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", parsers.extract_pri(line).alias("pri"), parsers.strip_pri(line).alias("bare"), parsers.set_pri(line, F.lit(20), F.lit(5)).alias("again"))


@query("SELECT event_id, 'Acme' AS vendor, event_type AS name, (event_id % 10)::VARCHAR AS severity, user_id::VARCHAR AS suser, 'a b ' || event_id AS msg FROM events")
def cef(spark, sf_dir):
    line = _str("<29>Feb 21 04:05:06 gate CEF:0|Acme|Sensor|2|77|", F.col("event_type"), "|", (F.col("event_id") % 10).cast("string"), "|suser=", F.col("user_id").cast("string"), " msg=a b ", F.col("event_id").cast("string"), " suser=later")
    c = read(spark, sf_dir, "events").select("event_id", parsers.cef_parse(parsers.syslog_parse(line)["msg"]).alias("c"))
    return c.select("event_id", F.col("c.device_vendor").alias("vendor"), "c.name", "c.severity", F.col("c.extensions")["suser"].alias("suser"), F.col("c.extensions")["msg"].alias("msg"))


@query("SELECT event_id, user_id::VARCHAR AS uid, 'two words' AS note, '' AS nothing, event_type AS type FROM events")
def key_values(spark, sf_dir):
    line = _str("uid=", F.col("user_id").cast("string"), ' note="two words" nothing= stray uid=other type=', F.col("event_type"))
    m = read(spark, sf_dir, "events").select("event_id", parsers.parse_kv(line).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("uid", "note", "nothing", "type")])


@query("SELECT event_id, event_id::VARCHAR AS id, 'a,\"b' AS q, NULL::VARCHAR AS gap, event_type AS type, NULL::VARCHAR AS short FROM events")
def csv_record(spark, sf_dir):
    line = _str(F.col("event_id").cast("string"), ',"a,""b",,skipped,', F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", parsers.csv_parse(line, ["id", "q", "gap", "", "type", "short"]).alias("r")).select("event_id", "r.*")


@query(f"SELECT event_id, {_K} AS k FROM events WHERE {_K} IS NOT NULL")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", parsers.parse_json(F.col("props"), "k long")["k"].alias("k")).where("k is not null")


@query(r"SELECT event_id, CASE WHEN regexp_matches(props, '\d+') THEN regexp_extract(props, '(\d)\d*', 1) END AS digit, regexp_matches(event_type, '^c') AS is_c, regexp_replace(event_type, '([aeiou])', '<\1>', 'g') AS marked, CASE WHEN regexp_matches(props, '\d+') THEN regexp_extract(props, '(\d+)', 1) END AS num FROM events")
def regex_functions(spark, sf_dir):
    e, p, t = read(spark, sf_dir, "events"), F.col("props"), F.col("event_type")
    return e.select("event_id", text.regex_extract(p, r"(\d)\d*").alias("digit"), text.regex_match(t, "^c").alias("is_c"), text.regex_replace(t, "([aeiou])", "<${1}>").alias("marked"), text.regex_parse(p, r"(?<num>\d+)")["num"].alias("num"))


@query("SELECT event_id, contains(event_type, 'i') AS has_i, starts_with(event_type, 'c') AS starts, ends_with(event_type, 'k') AS ends, upper(event_type) AS up, lower(upper(event_type)) AS low, length(event_type)::BIGINT AS n FROM events")
def string_functions(spark, sf_dir):
    t = F.col("event_type")
    return read(spark, sf_dir, "events").select("event_id", text.contains(t, "i").alias("has_i"), text.starts_with(t, "c").alias("starts"), text.ends_with(t, "k").alias("ends"), text.upper(t).alias("up"), text.lower(text.upper(t)).alias("low"), text.length(t).alias("n"))


@query("SELECT event_id, md5(event_type) AS m, sha1(event_type) AS s1, sha256(event_type) AS s2, lower(hex(encode(event_type))) AS h, base64(encode(event_type)) AS b FROM events")
def hash_functions(spark, sf_dir):
    t = F.col("event_type")
    return read(spark, sf_dir, "events").select("event_id", convert.md5(t).alias("m"), convert.sha1(t).alias("s1"), convert.sha256(t).alias("s2"), convert.to_string(convert.to_bytes(t), "hex").alias("h"), convert.to_string(convert.to_bytes(t), "base64").alias("b"))


@query("SELECT event_id, trunc(value)::BIGINT AS whole, CASE WHEN event_id % 2 = 0 THEN user_id END AS maybe, coalesce(NULLIF(event_id % 3, 0), user_id) AS first_some, epoch_us(ts) * 1000 AS ns FROM events")
def conversion_functions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 2 == 0, _str(" ", F.col("user_id").cast("string"), " ")).otherwise("12x")
    return e.select("event_id", convert.to_int(F.col("value"), "double").alias("whole"), convert.to_int(s).alias("maybe"), convert.coalesce(F.nullif(F.col("event_id") % 3, F.lit(0)), F.col("user_id")).alias("first_some"), convert.to_int(F.col("ts").cast("timestamp"), "timestamp").alias("ns"))


@query("SELECT event_id, '{\"a\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"b\":\"x\"}' ELSE '}' END AS omitted, '{\"a\":' || event_id || ',\"b\":' || CASE WHEN event_id % 2 = 0 THEN '\"x\"}' ELSE 'null}' END AS kept, user_id AS found, 3::BIGINT AS n FROM events")
def object_functions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = F.struct(F.col("event_id").alias("a"), F.when(F.col("event_id") % 2 == 0, "x").alias("b"))
    pairs = F.array(F.struct(F.lit("id").alias("key"), F.col("event_id").alias("val")), F.struct(F.lit("user").alias("key"), F.col("user_id").alias("val")))
    more = convert.append(F.array(F.col("event_id")), F.col("user_id"))
    return e.select("event_id", convert.null_omit_json(s).alias("omitted"), convert.to_json(s).alias("kept"), convert.find_by(pairs, "key", F.lit("user"))["val"].alias("found"), text.length(convert.prepend(more, F.lit(0).cast("long")), "array").alias("n"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS there, strptime(strftime(ts, '%d/%b/%Y:%H:%M:%S'), '%d/%b/%Y:%H:%M:%S') AS back FROM events")
def time_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    back = convert.strptime(convert.strftime(ts, "%d/%b/%Y:%H:%M:%S"), "%d/%b/%Y:%H:%M:%S")
    return read(spark, sf_dir, "events").select("event_id", convert.strftime(ts, "%Y-%m-%d %H:%M:%S", "+09:00").alias("there"), back.cast("timestamp_ntz").alias("back"))


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def table_lookup(spark, sf_dir):
    return tables.lookup(read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def table_known(spark, sf_dir):
    return tables.known(read(spark, sf_dir, "events"), read(spark, sf_dir, "customer").where("c_acctbal > 0"), "user_id", "c_custkey").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = e.user_id)")
def table_unknown(spark, sf_dir):
    return tables.unknown(read(spark, sf_dir, "events"), read(spark, sf_dir, "customer").where("c_acctbal > 0"), "user_id", "c_custkey").select("event_id", "user_id")


@query("SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) >= 3600000000")
def dedup_refreshed(spark, sf_dir):
    return tables.dedup_refreshed(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, event_type, n, ts AS last, true AS passes FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(r.last) >= 3600000000 THEN e.ts ELSE r.last END, epoch_us(e.ts) - epoch_us(r.last) >= 3600000000
  FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.event_type IS NOT DISTINCT FROM r.event_type AND e.n = r.n + 1)
SELECT event_id FROM r WHERE passes""")
def dedup_ttl(spark, sf_dir):
    return tables.dedup_ttl(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 600) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def rate_limit(spark, sf_dir):
    return tables.rate_limit(read(spark, sf_dir, "events"), ["event_type"], "ts", 3, 600, "event_id").select("event_id")


@query("SELECT user_id, part, '[' || string_agg(event_id::VARCHAR, ',' ORDER BY event_id) || ']' AS items, count(*) AS n FROM (SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100)::BIGINT AS part FROM events) GROUP BY user_id, part")
def merge_batches(spark, sf_dir):
    return tables.merged(read(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), 100, "event_id")


#: Event class and activity by type, as the common schema numbers them. Fixed values.
CLASSES = {"login": (3002, 1), "logout": (3002, 2), "click": (6001, 1), "view": (6001, 2), "purchase": (6003, 1), "error": (2004, 1)}


@query("""SELECT event_id, '{"class_uid":' || c || ',"category_uid":' || c // 1000 || ',"activity_id":' || a || ',"type_uid":' || c * 100 + a || ',"time":' || epoch_us(ts) // 1000 || ',"actor":{"user":{"uid":"' || user_id || '"}}}' AS event
FROM (SELECT *, CASE event_type WHEN 'login' THEN 3002 WHEN 'logout' THEN 3002 WHEN 'click' THEN 6001 WHEN 'view' THEN 6001 WHEN 'purchase' THEN 6003 WHEN 'error' THEN 2004 ELSE 0 END AS c,
  CASE event_type WHEN 'login' THEN 1 WHEN 'logout' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 WHEN 'error' THEN 1 ELSE 99 END AS a FROM events)""")
def normalised(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for k, (c, a) in CLASSES.items() for x in (k, c)])
    act = F.create_map(*[F.lit(x) for k, (c, a) in CLASSES.items() for x in (k, a)])
    c, a = F.coalesce(kind[F.col("event_type")], F.lit(0)), F.coalesce(act[F.col("event_type")], F.lit(99))
    user = F.struct(F.struct(F.col("user_id").cast("string").alias("uid")).alias("user"))
    body = F.struct(c.alias("class_uid"), F.floor(c / 1000).alias("category_uid"), a.alias("activity_id"), (c * 100 + a).alias("type_uid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), user.alias("actor"))
    return read(spark, sf_dir, "events").select("event_id", convert.null_omit_json(body).alias("event"))


from eventloom.plans import products  # noqa: E402, F401  registers more queries
