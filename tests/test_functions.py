import pytest
from pyspark.sql import functions as F
from eventloom.functions import convert, otlp, parsers
from eventloom.operators.flow import Flow


def one(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("<29>1 2027-02-21T04:05:06Z edge-7 cron 88 - - job finished", (29, 3, 5, "2027-02-21T04:05:06Z", "edge-7", "cron", "88", None, "job finished")),
        ("<29>Feb 21 04:05:06 edge-7 cron[88]: job finished", (29, 3, 5, "Feb 21 04:05:06", "edge-7", "cron", "88", None, "job finished")),
        ("<29>Feb 21 04:05:06 edge-7 ntpd: clock stepped", (29, 3, 5, "Feb 21 04:05:06", "edge-7", "ntpd", None, None, "clock stepped")),
        ("<29>Feb 21 04:05:06 edge-7 a-tag[1]: x", (29, 3, 5, "Feb 21 04:05:06", "edge-7", None, None, None, "a-tag[1]: x")),
        ("<29>Feb 21 04:05:06 gate CEF:0|A|S|2|1|n|3|msg=a: b", (29, 3, 5, "Feb 21 04:05:06", "gate", None, None, None, "CEF:0|A|S|2|1|n|3|msg=a: b")),
        ("<29>Feb  1 04:05:06 host app: m", (29, 3, 5, "Feb  1", "04:05:06", None, None, None, "host app: m")),
        ('<29>1 - - - - - [a b="c \\] d"][e] hi there', (29, 3, 5, None, None, None, None, None, "hi there")),
        ("<29>1 t h a p m [unfinished", (29, 3, 5, "t", "h", "a", "p", "m", None)),
        ("<29>short", (29, 3, 5, None, "short", None, None, None, None)),
        ("plain words", None),
        ("<192>x", None),
        ("<>x", None),
        ("x<1>", None),
        (None, None),
    ],
)
def test_syslog(spark, line, want):
    got = one(spark, parsers.syslog_parse, line)
    assert (got and tuple(got)) == want


def test_parsers_edges(spark):
    assert one(spark, parsers.parse_kv, 'a=1 a=2 b="x \\" y" c= d =z') == {"a": "1", "b": 'x \\" y', "c": ""}
    assert one(spark, parsers.parse_kv, None) is None
    assert one(spark, parsers.cef_parse, "CEF:0|v|p") is None
    assert tuple(one(spark, lambda s: parsers.csv_parse(s, ["a", "", "b"]), "1,2")) == ("1", None)
    assert one(spark, lambda s: parsers.parse_json(s, "a long"), "[1]") is None
    assert one(spark, convert.to_int, " 12 ") == 12
    assert one(spark, convert.to_int, "1.5") is None


def test_parsers_take_long_values(spark):
    """Values of a megabyte and hundreds of thousands of escapes neither recurse nor take long."""
    big = "x" * 1_000_000
    assert one(spark, parsers.syslog_parse, f"<29>1 t h a p m [{big}] hi")["msg"] == "hi"
    assert one(spark, parsers.syslog_parse, "<29>1 t h a p m " + "[a]" * 200_000 + " hi")["msg"] == "hi"
    assert one(spark, parsers.syslog_parse, "<29>1 t h a p m [" + "\\]" * 200_000 + "] hi")["msg"] == "hi"
    assert one(spark, parsers.syslog_parse, f"<29>{big}")["hostname"] == big
    assert one(spark, parsers.parse_kv, f'a="{big}" b=1') == {"a": big, "b": "1"}
    assert one(spark, parsers.parse_kv, 'a="' + '\\"' * 200_000 + '" b=1')["b"] == "1"
    assert one(spark, parsers.parse_kv, f'a="{big}') == {"a": big}
    assert one(spark, parsers.parse_kv, big + ' "') == {}
    assert len(one(spark, parsers.parse_kv, " ".join(f"k{i % 30_000}={i}" for i in range(60_000)))) == 30_000
    assert one(spark, parsers.cef_parse, f"CEF:0|A|S|2|1|n|3|{big}")["extensions"] == {}
    assert one(spark, parsers.cef_parse, f"CEF:0|A|S|2|1|n|3|k={big} j=2")["extensions"] == {"k": big, "j": "2"}


def test_defaults_and_wrapping(spark):
    d = {"z": F.lit("9"), "a": F.lit("8")}
    assert one(spark, lambda s: parsers.parse_kv(s, ",", d), 'a=1,b="2,3"') == {"a": "1", "b": "2,3", "z": "9"}
    assert one(spark, lambda s: parsers.syslog_parse(s, {"appname": F.lit("none")}), "<29>short")["appname"] == "none"
    assert one(spark, lambda s: parsers.cef_parse(s, d), "CEF:0|A|S|2|1|n|High|a=1")["extensions"] == {"a": "1", "z": "9"}
    wrapped = lambda s: parsers.parse_json(s, "a string, _json string", {"a": F.lit("d")})
    assert [tuple(one(spark, wrapped, s)) for s in ("[1]", "5", "{}", '{"a":"x"}')] == [("d", "[1]"), ("d", "5"), ("d", None), ("x", None)]
    assert [one(spark, wrapped, s) for s in ("nope", '{"$x":1}', '{"b":{"$x":1}}', "", None)] == [None] * 5
    assert one(spark, wrapped, '{"a":"{, \\"$x\\":"}')["a"] == '{, "$x":'
    with pytest.raises(ValueError):
        parsers.parse_kv(F.lit(""), "::")


def test_cef_severity(spark):
    got = [one(spark, parsers.cef_parse, f"CEF:0|A|S|2|1|n|{x}|") for x in ("7", "07", "High")]
    assert [(r["severity"], r["severity_id"]) for r in got] == [("7", 7), ("7", 7), ("High", None)]
    assert one(spark, parsers.cef_parse, "hello CEF:0|A|S|2|1|n|7|") is None
    assert [one(spark, parsers.cef_parse, f"CEF:0|A|S|2|1|n|7|{x}")["extensions"] for x in ("", "word", "=v", "=v a=1")] == [{}, {}, {}, {"a": "1"}]
    assert one(spark, parsers.cef_parse, "CEF:0|A|S|2|1|n|7|junk a.b=c x.y=2 d= k=1 k=2")["extensions"] == {"b": "c x.y=2", "d": "", "k": "1"}


def test_regex_names(spark):
    from eventloom.functions import text

    assert one(spark, lambda s: text.regex_parse(s, r"(?P<d.month>\w{3}) (?P<d.day>\d+)"), "Feb 21")["d"]["day"] == "21"
    assert one(spark, lambda s: text.regex_replace(s, r"(?P<a>\d)(x)", "${a}-$2-$$"), "1x2x") == "1-x-$2-x-$"


def test_time_without_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 doesn't exist there on this day.
        got = one(spark, lambda s: F.unix_micros(convert.strptime(s, "%Y-%m-%d %H:%M:%S", "+00:00")), "2027-03-14 02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == 1804991400 * 1_000_000
    with pytest.raises(ValueError):
        convert.pattern("%Q")


def test_dedup_ttl_rules(spark):
    from eventloom.operators.tables import dedup_ttl

    rows = [(i, k, t) for i, (k, t) in enumerate([(None, 0), (None, 5), (None, 12), (1, 0), (1, 9), (1, 10), (1, 19), (1, 20), (2, None), (2, None), (2, 3), (2, 4)])]
    docs = spark.createDataFrame(rows, "i long, k long, t long").select("i", "k", F.timestamp_seconds("t").alias("ts"))
    for df in (docs, docs.repartition(5)):
        assert sorted(r["i"] for r in dedup_ttl(df, ["k"], "ts", 10, "i").collect()) == [0, 2, 3, 5, 7, 8, 9, 10]
    import random

    rng = random.Random(3)
    many = [(i, rng.randrange(4), rng.randrange(20_000)) for i in range(40_000)]
    want, last = set(), {}
    for i, k, t in sorted(many, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or t - last[k] >= 7:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(many, "i long, k long, t long").select("i", "k", F.timestamp_seconds("t").alias("ts"))
    assert {r["i"] for r in dedup_ttl(df, ["k"], "ts", 7, "i").collect()} == want
    assert dedup_ttl(docs.limit(0), ["k"], "ts", 10, "i").count() == 0


def test_attempt_undoes(spark):
    start = Flow(spark.range(4).withColumn("x", F.lit("a")))
    body = lambda f: f.output("early", F.col("id")).set(x=F.lit("b"), y=F.lit("new")).error_if(F.col("id") == 2, "two").drop_if(F.col("id") == 3)
    flow = start.attempt(body, lambda f: f.set(x=F.col("_error"))).output("late", F.col("x"))
    got = {r["id"]: (r["_outcome"], r["x"], r["y"]) for r in flow.result().collect()}
    assert got == {0: ("finished", "b", "new"), 1: ("finished", "b", "new"), 2: ("finished", "two", None), 3: ("dropped", "b", "new")}
    assert sorted(map(tuple, flow.shipped().collect())) == [("early", "0"), ("early", "1"), ("early", "3"), ("late", "b"), ("late", "b"), ("late", "two")]
    assert not [c for c in flow.df.columns if c.startswith(("_try", "_failed", "_error"))]
    nested = start.attempt(lambda f: f.attempt(lambda g: g.error_if(F.col("id") == 1, "in"), lambda g: g.set(x=F.lit("inner")).error_if(F.col("id") == 1, "again")), lambda f: f.set(x=F.concat(F.lit("outer "), F.col("_error"))))
    assert {r["id"]: r["x"] for r in nested.result().collect()} == {0: "a", 1: "outer again", 2: "a", 3: "a"}
    again = Flow(spark.range(2)).error_if(F.col("id") == 1, "one", "check").recover("check", z=F.lit(5)).error_if(F.col("id") == 1, "later")
    assert [tuple(r)[:3] for r in again.dead_letters().collect()] == [("later", "(pipeline)", "flow")]


def test_coercions(spark):
    from eventloom.functions import coerce as c

    r = spark.range(1).select(
        c.plus((F.lit(1), "int"), (F.lit("2"), "string")).alias("a"), c.plus((F.lit(None).cast("int"), "null"), (F.lit(1), "int")).alias("b"), c.plus((F.lit(True), "bool"), (F.lit(1), "int")).alias("c"),
        c.over((F.lit(1), "int"), (F.lit(0), "int")).alias("d"), c.less((F.lit("a"), "string"), (F.lit("b"), "string")).alias("e"), c.equal((F.current_timestamp(), "timestamp"), (F.current_timestamp(), "timestamp")).alias("f"),
        c.template("x", (F.lit(2.0), "float"), (F.array(F.lit(1), F.lit(2)), "array")).alias("g"), c.truth((F.lit(float("nan")), "float")).alias("h"), c.equal((F.lit(1), "int"), (F.lit(1.0), "float")).alias("i"),
    ).first()
    assert tuple(r) == ("12", 1.0, 2.0, 0.0, False, False, "x2[1, 2]", False, True)


@pytest.mark.parametrize("level", ["resource", "scope"])
def test_otlp_merge_bounds_requests(spark, level):
    """A resource of too many records, or of too many bytes, gets several requests that hold all of them; one that fits gets one."""
    text = lambda s: otlp.any_value(string_value=s)
    pair = lambda k, s: F.struct(F.lit(k).alias("key"), text(s).alias("value"))
    e = spark.range(0, 3706, 1, 4).withColumn("name", F.expr("case when id < 2600 then 'many' when id < 3600 then 'exact' when id < 3606 then 'few' else 'long' end"))
    e = e.withColumn("batch", F.expr("if(name = 'few', id % 2, null)"))
    svc, host = pair("service.name", F.col("name")), pair("host", F.lit("h"))
    attrs = F.when(F.col("id") % 4 < 2, F.array(svc, host)).otherwise(F.array(host, svc))
    body = F.when(F.col("name") == "long", F.repeat(F.lit("x"), 99_000)).otherwise("y")
    e = e.select("batch", otlp.resource(attrs).alias("resource"), otlp.scope("lib").alias("scope"), otlp.log_record(body=text(body), time_unix_nano=F.col("id")).alias("record"), F.when(F.col("id") == 1234, "u").otherwise("").alias("schema_url"))
    r = otlp.merge(e, level).select("batch", "resource_logs", F.filter("resource_logs.resource.attributes", lambda a: a["key"] == "service.name")[0]["value"]["string_value"].alias("name"))
    got = r.select("batch", "name", "resource_logs.schema_url", F.flatten("resource_logs.scope_logs.log_records").alias("records")).select("*", F.col("records.time_unix_nano").alias("ids"), F.length(F.to_json("records")).alias("size")).drop("records").collect()
    of = lambda name: [x for x in got if x["name"] == name]
    assert sorted(i for x in got for i in x["ids"]) == list(range(3706))
    assert all(len(x["ids"]) <= 1000 and x["size"] <= 1_200_000 for x in got)
    assert 3 <= len(of("many")) <= 8 and {x["schema_url"] for x in of("many")} == {"u"}
    assert [len(x["ids"]) for x in of("exact")] == [1000]
    assert sorted((x["batch"], sorted(x["ids"])) for x in of("few")) == [(0, [3600, 3602, 3604]), (1, [3601, 3603, 3605])]
    assert 10 <= len(of("long")) <= 25

    small = otlp.merge(e.where("record.time_unix_nano < 500").drop("batch"), level, most=50, most_bytes=20)
    assert {len(x["n"]) for x in small.select(F.flatten("resource_logs.scope_logs.log_records").alias("n")).collect()} == {1}


def test_products(spark):
    from eventloom.functions import ocsf, vendors

    r = one(spark, vendors.openssh, "<86>Feb 21 04:05:06 h sshd[9]: Invalid user eve from 192.0.2.44 port 4444")["record"]
    assert (r["activity_id"], r["status_id"], r["severity_id"], r["user"]["name"], r["src_endpoint"]["port"]) == (1, 2, 3, "eve", 4444)
    assert one(spark, vendors.openssh, "<86>Feb 21 04:05:06 h sshd[9]: error: kex_exchange_identification: read")["kind"] == "dropped"
    r = one(spark, vendors.sudo, "<85>Feb 21 04:05:06 h sudo[9]: pam_unix(sudo:auth): authentication failure; logname= uid=7 euid=0 tty=/dev/pts/2 ruser=x rhost=  user=x")["record"]
    assert (r["message"], r["actor"]["user"]["name"], r["user"]["name"]) == ("pam:auth authentication failure (uid=7, tty=/dev/pts/2)", "x", None)
    said = {"611103": "User logged out: Uname: ann", "109017": "User at limit for user ann now", "302016": "Teardown UDP connection 7 for a:192.0.2.4/53 to b:10.0.0.4/999 duration", "611101": "another wording"}
    got = {n: one(spark, vendors.asa, f"<164>Feb 21 04:05:06 fw %ASA-5-{n}: {body}")["record"] for n, body in said.items()}
    assert [(r["class_uid"], r["activity_id"], r["status_id"]) for r in got.values()] == [(3002, 2, 1), (3002, 1, 99), (4001, 2, None), (3002, 1, 1)]
    assert (got["109017"]["user"]["name"], got["109017"]["message"]) == ("ann", "ASA AAA insufficient resources: User at limit for user ann now")
    assert (got["302016"]["connection_info"]["protocol_num"], got["302016"]["dst_endpoint"]["port"]) == (17, 999)
    assert (got["611101"]["user"]["name"], got["611101"]["severity_id"]) == (None, 2)
    assert len(ocsf.CLASSES) == 27
    event = F.struct(F.lit(1234).alias("class_uid"), F.lit(1).alias("activity_id"), F.lit(1).alias("severity_id"))
    assert spark.range(1).select(ocsf.compose(event, ["class_uid", "activity_id", "severity_id"], F.lit(1)).alias("x")).first()["x"] is None


def test_flow_keeps_what_was_taken(spark):
    flow = Flow(spark.range(4)).output("all", F.col("id")).drop_if(F.col("id") == 1).error_if(F.col("id") == 2, "two").finish_if(F.col("id") == 3).output("late", F.col("id"))
    assert {r["id"]: r["_outcome"] for r in flow.result().collect()} == {0: "finished", 1: "dropped", 2: "errored", 3: "finished"}
    assert sorted(map(tuple, flow.shipped().collect())) == [("all", "0"), ("all", "1"), ("all", "2"), ("all", "3"), ("late", "0")]
    assert [tuple(r) for r in flow.dead_letters().collect()] == [("two", "(pipeline)", "flow", '{"id":2}')]


def test_files(spark, tmp_path):
    from eventloom.sources import files

    (tmp_path / "a.log").write_text("<134>x\n\n<999>y\n")
    got = files.valid_pri(files.lines(spark, f"{tmp_path}/a.log"))
    assert [r["ingress"] for r in got.collect()] == ["<134>x"]
    (tmp_path / "r.jsonl").write_text('{"ingress":"a","received_at":1}\nnot json\n')
    assert [(r["ingress"], r["egress"]) for r in files.replay(spark, f"{tmp_path}/r.jsonl").collect()] == [("a", "a")]
    (tmp_path / "s.jsonl").write_text('{"ingress":{"$bytes_b64":"YWI="},"egress":"e","received_at":1,"source":{"ip":"10.0.0.1","port":7},"workspace":{"k":{"v":1}}}\n')
    r = files.replay(spark, f"{tmp_path}/s.jsonl").first()
    assert (r["ingress"], r["egress"], r["source"]["port"], r["workspace"]) == ("ab", "e", 7, '{"k":{"v":1}}')
    (tmp_path / "t.json").write_text('{"a": "x", "b": {"n": 1}}')
    assert sorted(map(tuple, files.table(spark, f"{tmp_path}/t.json").collect())) == [("a", "x"), ("b", '{"n":1}')]
    (tmp_path / "t.csv").write_text("k , v\na, 1\n")
    assert [tuple(r) for r in files.table(spark, f"{tmp_path}/t.csv").collect()] == [("a", "1")]
    shipped = spark.createDataFrame([("o", "p1", "../x"), ("o", "p2", "h/1"), ("o", "p3", "")], "output string, payload string, host string")
    placed = files.placed(shipped, "logs/", F.col("host"), ".log")
    assert sorted((r["payload"], r["path"]) for r in placed.collect()) == [("p1", None), ("p2", "logs/h_1.log"), ("p3", None)]
    files.write_placed(placed.where("path is not null"), f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["p2"]
    flow = Flow(files.lines(spark, f"{tmp_path}/a.log"), "in").error_if(F.col("ingress").isNotNull())
    files.write_dead_letters(flow.dead_letters(), f"{tmp_path}/dead")
    assert {(r["reason"], r["process"], r["pipeline"]) for r in spark.read.json(f"{tmp_path}/dead").collect()} == {("explicit error routing", "(pipeline)", "in")}


def test_stream_dedup(spark, tmp_path):
    from eventloom.streaming.dedup import dedup_ttl

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k":"a"}\n{"k":"a"}\n{"k":"b"}\n')
    stream = dedup_ttl(spark.readStream.schema("k string").json(f"{tmp_path}/in"), ["k"], 3600)
    q = stream.writeStream.format("memory").queryName("passed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("passed").collect())) == [("a", 2), ("b", 1)]


def test_stream_event_time(spark, tmp_path):
    from eventloom.streaming import dedup

    (tmp_path / "in").mkdir()
    rows = [("a", "2027-02-21 00:00:00", "finished"), ("a", "2027-02-21 00:00:05", "finished"), ("b", "2027-02-21 00:01:10", "errored")]
    (tmp_path / "in/a.json").write_text("\n".join(f'{{"k":"{k}","ts":"{t}","outcome":"{o}"}}' for k, t, o in rows))
    (tmp_path / "in/b.json").write_text('{"k":"z","ts":"2027-02-21 03:00:00","outcome":"dropped"}')
    read = lambda: spark.readStream.schema("k string, ts timestamp, outcome string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert [r[0] for r in run(dedup.dedup_event_time(read(), ["k"], "ts", "10 minutes").select("k"), "first_events")] == ["a", "b", "z"]
    got = run(dedup.counters(read(), "ts", "1 minute", "10 minutes").selectExpr("cast(start as string)", "outcome", "events"), "counts")
    assert got == [("2027-02-21 00:00:00", "finished", 2), ("2027-02-21 00:01:00", "errored", 1)]


def test_http_sink(spark):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from eventloom.sources.http import post

    got, fails = [], [1]

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = gzip.decompress(self.rfile.read(int(self.headers["Content-Length"]))).decode()
            bad = "p7" in body or bool(fails and fails.pop())
            if not bad:
                got.extend(body.split("\n"))
            self.send_response(503 if bad else 200)
            self.end_headers()
            self.wfile.write(b"busy")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(f"p{i}",) for i in range(8)] + [(None,)], "payload string").coalesce(1)
    out = post(rows, f"http://127.0.0.1:{server.server_port}/", batch=3, compress=True, attempts=2, wait=0.01).collect()
    server.shutdown()
    assert [(r["rows"], r["status"], r["error"], r["attempts"]) for r in out] == [(3, 200, None, 2), (3, 200, None, 1), (2, 503, "busy", 2)]
    assert sorted(got) == [f"p{i}" for i in range(6)]
