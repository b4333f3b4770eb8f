"""Queries over made-up log lines of common products, the common event schema, coercions, and hard values."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import coerce, convert, ocsf, otlp, parsers, text, vendors
from eventloom.operators import tables
from eventloom.operators.flow import Flow
from eventloom.plans.registry import _str, query, read


def _id():
    return F.col("event_id").cast("string")


def _user():
    return F.col("user_id").cast("string")


def _type():
    return F.col("event_type")


def _ip():
    return _str("10.1.", (F.col("event_id") % 200).cast("string"), ".", (F.col("user_id") % 250).cast("string"))


_SQL_IP = "'10.1.' || (event_id % 200) || '.' || (user_id % 250)"
_NAMES = ["class_uid", "activity_id", "severity_id", "status_id", "user", "src_endpoint", "auth_protocol", "auth_protocol_id", "service", "metadata"]


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 4 THEN NULL ELSE '{{"class_uid":3002,"category_uid":3,"activity_id":' || a || ',"type_uid":' || 300200 + a || ',"severity_id":' || sev || ',"status_id":' || st || ',"time":' || event_id ||
  ',"user":{{' || CASE WHEN event_id % 6 = 3 THEN '' ELSE '"name":"u' || user_id || '"' END || '}},"src_endpoint":{{"ip":"' || {_SQL_IP} || '","port":' || (1000 + event_id % 50000) || '}},"auth_protocol":"SSH","auth_protocol_id":99,"service":{{"name":"ssh"}},"metadata":{{"product":{{"vendor_name":"OpenBSD","name":"OpenSSH"}},"version":"1.3.0"}}}}' END AS event,
  CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 4 THEN 'dropped' ELSE 'record' END AS kind
FROM (SELECT *, CASE event_id % 6 WHEN 2 THEN 2 WHEN 3 THEN 99 ELSE 1 END AS a, CASE event_id % 6 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 0 THEN 2 ELSE 1 END AS st, CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS sev FROM events) WHERE event_id % 6 <> 5
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 6 = 5""")
def openssh_logins(spark, sf_dir):
    kind, at = F.col("event_id") % 6, _str(_ip(), " port ", (1000 + F.col("event_id") % 50000).cast("string"))
    msg = F.when(kind == 0, _str("Failed password for invalid user u", _user(), " from ", at, " ssh2")).when(kind == 1, _str("Failed publickey for u", _user(), " from ", at, " ssh2")).when(kind == 2, _str("Disconnected from authenticating user u", _user(), " ", at, " [preauth]"))
    msg = msg.when(kind == 3, _str("Did not receive identification string from ", at)).when(kind == 4, _str("Received disconnect from ", _ip(), " port 77:11: bye")).otherwise("Server listening on :: port 22.")
    line = _str("<86>Feb 21 04:05:06 host sshd[", _id(), "]: ", msg)
    e = read(spark, sf_dir, "events").select("event_id", vendors.openssh(line).alias("r"))
    return e.select("event_id", ocsf.compose(F.col("r.record"), _NAMES, F.col("event_id"), [3002]).alias("event"), F.col("r.kind").alias("kind"))


_HTTP = [n for n in "class_uid activity_id severity_id status_id time src_endpoint actor http_request http_response metadata".split()]


@query(f"""SELECT event_id, '{{"class_uid":4002,"category_uid":4,"activity_id":' || a || ',"type_uid":' || 400200 + a || ',"severity_id":' || CASE event_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END || ',"status_id":' || CASE WHEN event_id % 4 >= 2 THEN 2 ELSE 1 END ||
  ',"time":' || (epoch_us(date_trunc('second', ts)) - 32400000000) * 1000 || ',"src_endpoint":{{"ip":"' || {_SQL_IP} || '"}},"actor":{{"user":{{' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"name":"u' || user_id || '"' END || '}}}},"http_request":{{"url":{{"url_string":"/' || event_type || '"}},"http_method":"' || m || '","version":"HTTP/1.1","user_agent":"agent ' || user_id || '"' ||
  CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"referrer":"http://x.example/"' END || '}},"http_response":{{"code":' || (200 + 100 * (event_id % 4)) || ',"length":' || event_id || '}},"metadata":{{"product":{{"vendor_name":"Apache Software Foundation","name":"HTTP Server"}},"version":"1.3.0"}}}}' AS event
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 99 END AS a, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PATCH' END AS m FROM events) WHERE event_id % 4 > 0
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0""")
def access_log(spark, sf_dir):
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    user, refer = F.when(F.col("event_id") % 3 == 0, "-").otherwise(_str("u", _user())), F.when(F.col("event_id") % 2 == 0, "-").otherwise("http://x.example/")
    time = convert.strftime(F.col("ts").cast("timestamp"), "%d/%b/%Y:%H:%M:%S")
    line = _str(_ip(), " - ", user, " [", time, " +0900] \"", pick(3, "GET", "POST", "PATCH"), " /", _type(), " HTTP/1.1\" ", (200 + 100 * (F.col("event_id") % 4)).cast("string"), " ", _id(), " \"", refer, "\" \"agent ", _user(), "\"")
    line = F.when(F.col("event_id") % 4 == 0, F.substring(line, 1, 20)).otherwise(line)
    return read(spark, sf_dir, "events").select("event_id", vendors.combined_log(line).alias("r")).select("event_id", ocsf.compose(F.col("r.record"), _HTTP, F.col("event_id"), [4002]).alias("event"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END::BIGINT AS status, CASE event_id % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'db' WHEN 2 THEN 'root' END AS target, CASE WHEN event_id % 4 IN (0, 1) THEN 'u' || user_id WHEN event_id % 4 = 2 THEN 'bob' END AS actor,
  CASE event_id % 4 WHEN 0 THEN '/bin/' || event_type || ' -x' WHEN 1 THEN '3 incorrect password attempts; command was /bin/' || event_type WHEN 2 THEN 'pam:session opened' END AS message, CASE WHEN event_id % 4 = 3 THEN 'dropped' ELSE 'record' END AS kind FROM events""")
def sudo_sessions(spark, sf_dir):
    kind = F.col("event_id") % 4
    msg = F.when(kind == 0, _str("   u", _user(), " : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/", _type(), " -x")).when(kind == 1, _str("   u", _user(), " : 3 incorrect password attempts ; PWD=/tmp ; USER=db ; ENV=A=1 ; COMMAND=/bin/", _type()))
    msg = msg.when(kind == 2, "pam_unix(sudo:session): session opened for user root by bob(uid=1000)").otherwise(_str("   u", _user(), " : (command continued) more"))
    e = read(spark, sf_dir, "events").select("event_id", vendors.sudo(_str("<85>Feb 21 04:05:06 host sudo[", _id(), "]: ", msg)).alias("r")).select("event_id", "r.*")
    return e.select("event_id", F.col("record.status_id").alias("status"), F.col("record.user.name").alias("target"), F.col("record.actor.user.name").alias("actor"), F.col("record.message").alias("message"), "kind")


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3002 WHEN 1 THEN 4001 WHEN 2 THEN 4001 END::BIGINT AS class_uid, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 5 END::BIGINT AS activity, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 END::BIGINT AS severity,
  CASE WHEN event_id % 4 < 3 THEN {_SQL_IP} END AS ip, CASE event_id % 4 WHEN 1 THEN 443 WHEN 2 THEN 22 END::BIGINT AS to_port, CASE event_id % 4 WHEN 0 THEN 'u' || user_id END AS name, CASE event_id % 4 WHEN 0 THEN 'ASA admin login denied (service=ssh)' WHEN 1 THEN 'ASA TCP connection built (id=' || event_id || ', direction=inbound)' WHEN 2 THEN 'ASA ACL deny (acl=outside in)' END AS message FROM events""")
def asa_events(spark, sf_dir):
    kind = F.col("event_id") % 4
    msg = F.when(kind == 0, _str("%ASA-6-605004: Login denied from ", _ip(), "/99 to outside:192.0.2.7/ssh for user u", _user())).when(kind == 1, _str("%ASA-6-302013: Built inbound TCP connection ", _id(), " for outside:", _ip(), "/5000 (", _ip(), "/5000) to inside:10.0.0.9/443 (10.0.0.9/443)"))
    msg = msg.when(kind == 2, _str("%ASA-4-106023: Deny udp src outside:", _ip(), "/7 dst inside:10.0.0.9/22 by access-group \"outside in\" [0x0, 0x0]")).otherwise("%ASA-5-111008: User did something")
    e = read(spark, sf_dir, "events").select("event_id", vendors.asa(_str("<164>Feb 21 04:05:06 fw : ", msg)).alias("r")).select("event_id", "r.record")
    return e.select("event_id", *[F.col(f"record.{a}").alias(b) for a, b in (("class_uid", "class_uid"), ("activity_id", "activity"), ("severity_id", "severity"), ("src_endpoint.ip", "ip"), ("dst_endpoint.port", "to_port"), ("user.name", "name"), ("message", "message"))])


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'purchase' THEN 4 ELSE 99 END::BIGINT AS activity, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS status, epoch_us(date_trunc('second', ts)) * 1000 AS time, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'role' END AS name, CASE WHEN event_id % 5 = 0 THEN 'no access' END AS message FROM events WHERE event_id % 9 > 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 9 = 0""")
def cloudtrail_calls(spark, sf_dir):
    call = F.when(_type() == "click", "ListThings").when(_type() == "view", "AssumeRole").when(_type() == "purchase", "RevokeThing").otherwise("Ponder")
    who = F.when(F.col("event_id") % 2 == 0, F.struct(_str("u", _user()).alias("userName"), F.lit(None).cast("struct<sessionIssuer:struct<userName:string>>").alias("sessionContext"))).otherwise(F.struct(F.lit(None).cast("string").alias("userName"), F.struct(F.struct(F.lit("role").alias("userName")).alias("sessionIssuer")).alias("sessionContext")))
    bad = F.col("event_id") % 5 == 0
    line = F.to_json(F.struct(call.alias("eventName"), convert.strftime(F.col("ts").cast("timestamp"), "%Y-%m-%dT%H:%M:%SZ").alias("eventTime"), who.alias("userIdentity"), F.when(bad, "Denied").alias("errorCode"), F.when(bad, "no access").alias("errorMessage"), F.struct(F.lit(1).alias("x")).alias("requestParameters")))
    line = F.when(F.col("event_id") % 9 == 0, F.concat(line, F.lit("{"))).otherwise(line)
    r = read(spark, sf_dir, "events").select("event_id", vendors.cloudtrail(F.when(F.col("event_id") % 9 == 0, F.lit("{oops")).otherwise(line)).alias("r"))
    return r.select("event_id", *[F.col(f"r.record.{a}").alias(b) for a, b in (("activity_id", "activity"), ("status_id", "status"), ("time", "time"), ("actor.user.name", "name"), ("message", "message"))])


@query("SELECT event_id, event_id % 2 = 1 AS noise FROM events")
def openssh_journal(spark, sf_dir):
    line = _str("<86>Feb 21 04:05:06 host sshd[7]: ", F.when(F.col("event_id") % 2 == 1, "pam_unix(sshd:session): session opened").otherwise("Accepted publickey for x from y port 1"))
    return read(spark, sf_dir, "events").select("event_id", vendors.openssh_journal_noise(line).alias("noise"))


@query("SELECT event_id, '{\"received_at\":' || epoch_us(ts) * 1000 || ',\"source\":{\"ip\":\"10.0.0.1\",\"port\":514},\"ingress\":\"' || event_type || '\"}' AS event FROM events")
def replayable(spark, sf_dir):
    source = F.struct(F.lit("10.0.0.1").alias("ip"), F.lit(514).alias("port"))
    return read(spark, sf_dir, "events").select("event_id", ocsf.replayable(F.unix_micros(F.col("ts").cast("timestamp")) * 1000, source, _type()).alias("event"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'k=' WHEN 2 THEN 'k' || event_id END AS first, CASE event_id % 5 WHEN 0 THEN '' WHEN 2 THEN 'k' || event_id END AS part, CASE event_id % 4 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN NULL WHEN 2 THEN -9223372036854775808 ELSE event_id END::BIGINT AS whole,
  CASE event_id % 3 WHEN 0 THEN '[' || event_id || ']' END AS json, CASE event_id % 3 WHEN 1 THEN event_id END AS a, event_id % 10 AS severity, CASE WHEN event_id % 5 = 1 THEN NULL ELSE 'x' || event_id END AS open FROM events""")
def hard_values(spark, sf_dir):
    """Groups that are empty or take no part, numbers out of range, JSON that is no object or has reserved keys, open quotes."""
    i = F.col("event_id")
    s = F.when(i % 5 == 0, "a=<>;").when(i % 5 == 1, "k=;").when(i % 5 == 2, _str("a=<k", _id(), ">;")).otherwise("none")
    whole = F.when(i % 4 == 0, 1e300).when(i % 4 == 1, float("nan")).when(i % 4 == 2, -1e300).otherwise(i.cast("double"))
    json = F.when(i % 3 == 0, _str("[", _id(), "]")).when(i % 3 == 1, _str('{"a":', _id(), "}")).otherwise('{"$a":1}')
    line = _str("CEF:0|Acme|Sensor|2|1|n|0", (i % 10).cast("string"), "|")
    kv = F.when(i % 5 == 1, "nothing here").otherwise(_str('v="x', _id()))
    e = read(spark, sf_dir, "events").select("event_id", text.regex_extract(s, r"k=|<(\w*)>").alias("first"), text.regex_parse(s, r"(?:k=|<(?<g.v>\w*)>)").alias("p"), convert.to_int(whole, "double").alias("whole"), parsers.parse_json(json, "a long, _json string").alias("j"), parsers.cef_parse(line).alias("c"), parsers.parse_kv(kv).alias("m"))
    return e.select("event_id", F.when(F.col("first") == "k=", "k=").otherwise(F.col("first")).alias("first"), F.col("p.g.v").alias("part"), "whole", F.col("j._json").alias("json"), "j.a", F.col("c.severity_id").alias("severity"), F.col("m")["v"].alias("open"))


@query("""WITH RECURSIVE e AS (SELECT event_id, k, ts, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM (SELECT event_id, ts, CASE WHEN user_id % 4 > 0 THEN 9007199254740992 + user_id % 4 END AS k FROM events)),
r AS (SELECT event_id, k, n, ts AS last, true AS passes FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.k, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(r.last) >= 3600000000 THEN e.ts ELSE r.last END, epoch_us(e.ts) - epoch_us(r.last) >= 3600000000
  FROM r JOIN e ON e.k IS NOT DISTINCT FROM r.k AND e.n = r.n + 1)
SELECT event_id FROM r WHERE passes""")
def dedup_ttl_keys(spark, sf_dir):
    """Null keys, and keys that differ beyond a double's precision."""
    k = F.when(F.col("user_id") % 4 > 0, F.lit(9007199254740992) + F.col("user_id") % 4)
    return tables.dedup_ttl(read(spark, sf_dir, "events").select("event_id", k.alias("k"), "ts"), ["k"], "ts", 3600, "event_id").select("event_id")


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'caught: too large' ELSE event_type || '!' END AS label, CASE WHEN value > 90 THEN event_id ELSE event_id + 1 END AS n, CASE WHEN value <= 90 AND event_type = 'view' THEN 'dropped' WHEN value > 95 THEN 'errored' ELSE 'discarded' END AS outcome FROM events""")
def flow_attempt(spark, sf_dir):
    """try and catch: what the body set before it failed is undone; an error in catch stays."""
    flow = Flow(read(spark, sf_dir, "events").select("event_id", "event_type", "value")).set(label=F.lit("none"), n=F.col("event_id"))
    body = lambda f: f.set(label=_str(F.col("event_type"), "!"), n=F.col("n") + 1).error_if(F.col("value") > 90, "too large", "check").drop_if(F.col("event_type") == "view")
    catch = lambda f: f.set(label=F.concat(F.lit("caught: "), F.col("_error"))).error_if(F.col("value") > 95, "again", "catch")
    return flow.attempt(body, catch).result().select("event_id", "label", "n", F.col("_outcome").alias("outcome"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN (event_id % 4) * (event_id % 4 + 1) // 2 ELSE -1 END AS total, CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS last, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE event_type END AS kind FROM events")
def flow_each(spark, sf_dir):
    """A loop whose state goes from item to item, and a record merged into the columns."""
    items = F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("event_id") % 4))
    flow = Flow(read(spark, sf_dir, "events").select("event_id", "event_type")).set(total=F.lit(-1).cast("long"), kind=F.lit("old"))
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last"))
    flow = flow.each(items, state, lambda s, x: F.struct((s["sum"] + x).alias("sum"), x.alias("last")), total=lambda s: s["sum"], last=lambda s: s["last"])
    flow = flow.merge(F.when(F.col("event_id") % 3 > 0, F.struct(F.col("event_type").alias("kind"))), ["kind"])
    return flow.result().select("event_id", "total", "last", "kind")


@query("SELECT 'e' AS input, event_id AS id, NULL::BIGINT AS c_custkey FROM events UNION ALL SELECT 'c', NULL, c_custkey FROM customer")
def fan_in(spark, sf_dir):
    return tables.fan_in(read(spark, sf_dir, "events").select(F.lit("e").alias("input"), F.col("event_id").alias("id")), read(spark, sf_dir, "customer").select(F.lit("c").alias("input"), "c_custkey"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id - 2.0 ELSE -2.0 END::DOUBLE AS minus, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id / (user_id % 3) END::DOUBLE AS ratio, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id % (user_id % 3) END::DOUBLE AS rest, event_id || 'x' AS plus, event_id % 3 <> 0 AS truth, event_id % 2 = 0 AS less, 'n=' || event_id || ' v=' AS line FROM events""")
def coercions(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    s = F.when(i % 3 == 0, _id()).otherwise("bad")
    c = coerce
    cols = [c.minus((s, "string"), (F.lit(2), "int")).alias("minus"), c.over((i, "int"), (u % 3, "int")).alias("ratio"), c.rest((i, "int"), (u % 3, "int")).alias("rest"), c.plus((i, "int"), (F.lit("x"), "string")).alias("plus"), c.truth((i % 3, "int")).alias("truth"), c.less((i % 2, "int"), (F.lit(0.5), "float")).alias("less"), c.template("n=", (i, "int"), " v=", (F.lit(None).cast("string"), "string")).alias("line")]
    return read(spark, sf_dir, "events").select("event_id", *cols)


@query("""SELECT event_id, event_type AS body, (event_id % 20)::INT AS severity, 'svc' || (user_id % 3) AS service FROM events""")
def otlp_split(spark, sf_dir):
    """Requests of several records, taken apart: a row for each log record, with its resource and scope."""
    e = read(spark, sf_dir, "events").withColumn("svc", _str("svc", (F.col("user_id") % 3).cast("string")))
    record = F.struct(F.lit("1").alias("timeUnixNano"), (F.col("event_id") % 20).cast("int").alias("severityNumber"), F.struct(F.col("event_type").alias("stringValue")).alias("body"), F.array(F.struct(F.lit("id").alias("key"), F.struct(_id().alias("intValue")).alias("value"))).alias("attributes"))
    scope = e.groupBy("svc", (F.col("event_id") % 50).alias("batch")).agg(F.collect_list(record).alias("logRecords"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("svc").alias("stringValue")).alias("value"))).alias("attributes"))
    request = scope.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), "logRecords")).alias("scopeLogs"))).alias("resourceLogs"))).alias("request"))
    r = otlp.split(request, otlp.decode_json(F.col("request")))
    of = lambda attrs, key: F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]
    return r.select(of(F.col("record.attributes"), "id")["int_value"].alias("event_id"), F.col("record.body.string_value").alias("body"), F.col("record.severity_number").alias("severity"), of(F.col("resource.attributes"), "service.name")["string_value"].alias("service"))


@query("SELECT 'svc' || (user_id % 3) AS service, count(*) AS records FROM events GROUP BY ALL")
def otlp_merge(spark, sf_dir):
    """Single records merged into requests by resource, whatever the order of its attributes, and written as JSON."""
    e = read(spark, sf_dir, "events")
    value = lambda s: otlp.any_value(string_value=s)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), value(v).alias("value"))
    svc, host = pair("service.name", _str("svc", (F.col("user_id") % 3).cast("string"))), pair("host", F.lit("h"))
    attrs = F.when(F.col("event_id") % 2 == 0, F.array(svc, host)).otherwise(F.array(host, svc))
    single = e.select(otlp.resource(attrs).alias("resource"), otlp.scope("lib").alias("scope"), otlp.log_record(body=value(F.col("event_type")), severity_number=F.lit(9)).alias("record"), F.lit("").alias("schema_url"))
    merged = otlp.merge(single, "resource").select(otlp.encode_json(F.col("resource_logs")).alias("json"))
    back = otlp.split(merged, F.array(otlp.decode_resource_json(F.col("json"))))
    of = F.get(F.filter(F.col("resource.attributes"), lambda a: a["key"] == "service.name"), F.lit(0))["value"]["string_value"]
    return back.groupBy(of.alias("service")).agg(F.count("*").alias("records"))


@query("SELECT event_id, CASE WHEN event_id % 300 < 256 THEN 'C' || (event_id % 300 // 64) END AS country FROM events")
def geo_lookup(spark, sf_dir):
    """Addresses looked up in ranges."""
    ranges = spark.createDataFrame([(f"10.0.{a}.0", f"10.0.{a + 63}.255", f"C{a // 64}") for a in range(0, 256, 64)], "first string, last string, country string")
    ip = F.when(F.col("event_id") % 300 < 256, _str("10.0.", (F.col("event_id") % 300).cast("string"), ".7")).otherwise("10.9.9.9")
    return tables.in_range(read(spark, sf_dir, "events").select("event_id", ip.alias("ip")), ranges, "ip", "first", "last", ["country"]).select("event_id", "country")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 END::BIGINT AS severity, CASE event_id % 4 WHEN 1 THEN 'a@x.example' WHEN 2 THEN '' END AS sender, CASE event_id % 4 WHEN 0 THEN 'u' || user_id || '@x.example' WHEN 1 THEN 'b@x.example' WHEN 3 THEN 'u' || user_id || '@x.example' END AS recipient,
  CASE event_id % 4 WHEN 0 THEN 'Postfix smtp delivery (status=bounced dsn=5.1.1)' WHEN 1 THEN 'Postfix smtpd reject: 554 5.7.1 no ' || event_type WHEN 2 THEN 'Postfix qmgr queue active' WHEN 3 THEN 'Postfix smtp delivery (status=deferred dsn=4.4.1)' END AS message, CASE event_id % 4 WHEN 2 THEN event_id END AS size FROM events""")
def postfix_mail(spark, sf_dir):
    kind, to = F.col("event_id") % 4, _str("to=<u", _user(), "@x.example>, ")
    msg = F.when(kind == 0, _str("smtp[7]: ABC1: ", to, "relay=mx.x.example[192.0.2.9]:25, delay=1.2, delays=0.1/0/1/0.1, dsn=5.1.1, status=bounced (no such user)")).when(kind == 1, _str("smtpd[7]: NOQUEUE: reject: RCPT from h.example[192.0.2.5]: 554 5.7.1 no ", _type(), "; from=<a@x.example> to=<b@x.example> proto=ESMTP"))
    msg = msg.when(kind == 2, _str("qmgr[7]: ABC2: from=<>, size=", _id(), ", nrcpt=1 (queue active)")).otherwise(_str("smtp[7]: ABC3: ", to, "relay=none, delay=9, delays=1/1/7/0, dsn=4.4.1, status=deferred (timed out)"))
    e = read(spark, sf_dir, "events").select("event_id", vendors.postfix(_str("<22>Feb 21 04:05:06 mail postfix/", msg)).alias("r")).select("event_id", "r.record.*")
    return e.select("event_id", F.col("severity_id").alias("severity"), F.col("email.from").alias("sender"), F.get(F.col("email.to"), F.lit(0)).alias("recipient"), "message", F.col("email.size").alias("size"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 3002 WHEN 1 THEN 3002 WHEN 2 THEN 1007 WHEN 3 THEN 3006 END::BIGINT AS class_uid, CASE event_id % 5 WHEN 0 THEN 'D\\u' || user_id WHEN 1 THEN 'u' || user_id WHEN 3 THEN 'cn=u' || user_id END AS who, CASE event_id % 5 WHEN 0 THEN 'D\\admin' WHEN 2 THEN 'D\\admin' WHEN 3 THEN 'D\\admin' END AS actor,
  CASE event_id % 5 WHEN 0 THEN 'Windows logon failure (status=0xc substatus=0x0)' WHEN 1 THEN 'Windows logoff' WHEN 2 THEN 'Process created' WHEN 3 THEN 'Group member added' END AS message, CASE WHEN event_id % 5 < 4 THEN epoch_us(date_trunc('second', ts)) * 1000 END AS time, CASE event_id % 5 WHEN 2 THEN event_type || '.exe' END AS process, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 END::BIGINT AS logon FROM events""".replace("\\\\", "\\"))
def windows_events(spark, sf_dir):
    kind = F.col("event_id") % 5
    number = F.when(kind == 0, 4625).when(kind == 1, 4634).when(kind == 2, 4688).when(kind == 3, 4732).otherwise(1)
    target = F.when(kind == 3, "team").otherwise(_str("u", _user()))
    event = F.struct(number.alias("EventID"), convert.strftime(F.col("ts").cast("timestamp"), "%Y-%m-%d %H:%M:%S").alias("EventTime"), F.lit("pc").alias("Hostname"), target.alias("TargetUserName"), F.when(kind == 0, "D").otherwise("-").alias("TargetDomainName"), F.lit("admin").alias("SubjectUserName"), F.lit("D").alias("SubjectDomainName"), F.lit("-").alias("IpAddress"), F.lit("3").alias("LogonType"), F.lit("0xc").alias("Status"), F.lit("0x0").alias("SubStatus"), _str(_type(), ".exe").alias("NewProcessName"), _str("cn=u", _user()).alias("MemberName"))
    r = read(spark, sf_dir, "events").select("event_id", vendors.windows(F.to_json(event)).alias("r")).select("event_id", "r.record.*")
    return r.select("event_id", "class_uid", F.col("user.name").alias("who"), F.col("actor.user.name").alias("actor"), "message", "time", F.col("process.name").alias("process"), F.col("logon_type_id").alias("logon"))


@query("""WITH c AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id) AS o, event_type FROM events),
ch AS (SELECT user_id, o, ts, event_id AS v, event_type = 'error' AS gone FROM c WHERE event_type IN ('signup', 'error'))
SELECT l.event_id, CASE WHEN NOT ch.gone AND epoch_us(l.ts) - epoch_us(ch.ts) < 36000000000 THEN ch.v END AS session FROM (SELECT * FROM c WHERE event_type NOT IN ('signup', 'error')) l ASOF LEFT JOIN ch ON l.user_id = ch.user_id AND l.o > ch.o""")
def table_as_of(spark, sf_dir):
    """A table that events change (a signup opens a session for ten hours, an error closes it) and others look into."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    changes = e.where("event_type in ('signup', 'error')").select("user_id", "ts", "event_id", F.col("event_id").alias("value"), (F.col("event_type") == "error").alias("gone"))
    lookups = e.where("event_type not in ('signup', 'error')")
    return tables.lookup_as_of(lookups, changes, "user_id", ["ts", "event_id"], "session", 36000).select("event_id", "session")


@query("SELECT user_id, event_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'error')) WHERE n = 1 AND event_type = 'signup' AND user_id IS NOT NULL")
def table_current(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type in ('signup', 'error')").where("user_id is not null")
    return tables.current(e.select("user_id", "ts", "event_id", F.col("event_id").alias("value"), (F.col("event_type") == "error").alias("gone")), "user_id", ["ts", "event_id"])


_FIELDS = sorted({f for fields in ocsf.CLASSES.values() for f in fields.split()} | {"message"})


@query(f"""SELECT event_id, '{{"class_uid":' || c || ',"category_uid":' || c // 1000 || ',"activity_id":7,"type_uid":' || c * 100 + 7 || ',"severity_id":1' || CASE WHEN list_contains(f, 'status_id') THEN ',"status_id":"status_id"' ELSE '' END || ',"time":' || event_id ||
  coalesce(list_reduce(list_transform(list_filter(f, lambda x: x <> 'status_id'), lambda x: ',"' || x || '":"' || x || '"'), lambda a, b: a || b), '') || ',"message":"message"}}' AS event
FROM (SELECT event_id, c, string_split(f, ' ') AS f FROM events JOIN (VALUES {', '.join(f"({i}, {c}, '{f}')" for i, (c, f) in enumerate(ocsf.CLASSES.items()))}) v(i, c, f) ON event_id % 28 = i)
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 28 = 27""")
def compose_classes(spark, sf_dir):
    """A record of each of the 27 classes, and one of an unknown class, that has every field: each class keeps its own."""
    uid = F.get(F.array(*[F.lit(c) for c in ocsf.CLASSES], F.lit(9999)), (F.col("event_id") % 28).cast("int"))
    record = F.struct(uid.alias("class_uid"), F.lit(7).alias("activity_id"), F.lit(1).alias("severity_id"), *[F.lit(f).alias(f) for f in _FIELDS])
    e = read(spark, sf_dir, "events").select("event_id", record.alias("r"))
    return e.select("event_id", ocsf.compose(F.col("r"), ["class_uid", "activity_id", "severity_id", *_FIELDS], F.col("event_id")).alias("event"))
