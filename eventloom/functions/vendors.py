"""Log lines of common products as records of the common event schema.

A product's messages are given as shapes: a pattern with named groups, and what the record says of it. A line's first shape
counts; where a shape starts with plain text, that is looked at before the pattern. Each parser gives a struct (`kind` and
`record`); a kind in DROPPED is noise, and a null kind is no message of the product, for the dead letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import convert, ocsf, parsers
from .parsers import let

DROPPED = "dropped"


@dataclass
class Shape:
    """pattern: with named groups; starts: plain text that a message starts with; make: the record, from a function that gives a
    group's text (null where it took no part), or the message's as `body`."""

    pattern: str
    make: Callable[[Callable[[str], Column]], Column] | None
    starts: str = ""
    kind: str = field(default="record")


def _none() -> Column:
    return F.lit(None).cast("string")


#: Stands between a match's groups; a message that has it is in no shape.
CUT = "\x01"


def first_shape(msg: Column, shapes: list[Shape], empty: Column | None = None) -> Column:
    """kind and record of the first shape that a message has, else null. A match's groups are taken in one go: the message is
    replaced by them, with CUT before each, and split there."""

    def value(s: Shape) -> Column:
        names = re.compile(s.pattern).groupindex
        bare = re.sub(r"\?P<\w+>", "", s.pattern)
        whole = ("(?s)^" + bare[1:] if bare.startswith("^") else "(?s)^.*?" + bare) + ".*$"
        groups = F.regexp_replace(msg, whole, CUT + "".join(f"${i}{CUT}" for i in range(1, len(names) + 1)))
        found = F.when(F.startswith(msg, F.lit(s.starts)), groups) if s.starts else groups

        def build(parts: Column) -> Column:
            get = lambda n: msg if n == "body" else F.nullif(F.get(parts, F.lit(names[n])), F.lit("")) if n in names else _none()
            return F.struct(F.lit(s.kind).alias("kind"), (s.make(get) if s.make else empty).alias("record"))

        return let(found, lambda j: F.when(F.startswith(j, F.lit(CUT)), let(F.split(j, CUT), build)))

    return let(msg, lambda m: F.when(~F.contains(m, F.lit(CUT)), F.coalesce(*map(value, shapes))))


def _one(shape: Shape, msg: Column) -> Column:
    return first_shape(msg, [shape])


def _endpoint(ip: Column, port: Column | None = None) -> Column:
    return F.struct(ip.alias("ip")) if port is None else F.struct(ip.alias("ip"), port.try_cast("long").alias("port"))


def _named(name: Column) -> Column:
    return F.struct(name.alias("name"))


#: HTTP methods by their activity, 99 for others. Fixed values.
HTTP = {"CONNECT": 1, "DELETE": 2, "GET": 3, "HEAD": 4, "OPTIONS": 5, "POST": 6, "PUT": 7, "TRACE": 8}


def _by_name(value: Column, table: dict[str, int], other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(other))


def combined_log(line: Column) -> Column:
    """A web server's access log line (class 4002)."""
    pattern = r'^(?P<ip>\S+) (?P<ident>\S+) (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<method>[A-Z]+) (?P<uri>\S+) (?P<proto>HTTP/[0-9.]+)" (?P<status>\d+) (?P<bytes>\d+) "(?P<referer>[^"]*)" "(?P<agent>[^"]*)"'

    def make(g):
        code, some = g("status").try_cast("long"), lambda x: F.nullif(x, F.lit("-"))
        status = F.when(code.between(100, 399), 1).when(code.between(400, 599), 2).otherwise(99)
        severity = F.when(code.between(400, 499), 2).when(code.between(500, 599), 3).otherwise(1)
        request = F.struct(F.struct(g("uri").alias("url_string")).alias("url"), g("method").alias("http_method"), g("proto").alias("version"), F.coalesce(g("agent"), F.lit("")).alias("user_agent"), some(F.coalesce(g("referer"), F.lit(""))).alias("referrer"))
        response = F.struct(code.alias("code"), g("bytes").try_cast("long").alias("length"))
        return ocsf.record(4002, _by_name(g("method"), HTTP, 99), severity, "Apache Software Foundation", "HTTP Server", status_id=status.cast("long"), time=convert.to_int(convert.strptime(g("time"), "%d/%b/%Y:%H:%M:%S %z"), "timestamp"), src_endpoint=_endpoint(g("ip")), actor=F.struct(_named(some(g("user"))).alias("user")), http_request=request, http_response=response)

    return first_shape(line, [Shape(pattern, make)])


def openssh(line: Column) -> Column:
    """A syslog line of sshd (class 3002)."""

    def login(activity: int, status: int, severity: int):
        def make(g):
            guess = g("invalid")
            rank = F.when(guess.isNotNull(), 3).otherwise(severity)
            return ocsf.record(3002, F.lit(activity), rank, "OpenBSD", "OpenSSH", status_id=F.lit(status).cast("long"), user=_named(F.coalesce(guess, g("user"))), src_endpoint=_endpoint(g("ip"), g("port")), auth_protocol=F.lit("SSH"), auth_protocol_id=F.lit(99), service=_named(F.lit("ssh")))

        return make

    at = r"(?P<ip>\S+) port (?P<port>\d+)"
    left = r"(?:(?:authenticating |invalid )?user (?P<user>\S+) )?"
    shapes = [
        Shape(rf"^Accepted (?P<method>\S+) for (?P<user>\S+) from {at}", login(1, 1, 1), "Accepted "),
        Shape(rf"^Failed (?P<method>\S+) for (?:invalid user (?P<invalid>\S+)|(?P<user>\S+)) from {at}", login(1, 2, 2), "Failed "),
        Shape(rf"^Invalid user (?P<invalid>\S+) from {at}", login(1, 2, 3), "Invalid user "),
        Shape(rf"^Disconnected from {left}{at}", login(2, 1, 1), "Disconnected from "),
        Shape(rf"^Connection (?:closed by|reset by) {left}{at}", login(2, 1, 1), "Connection "),
        Shape(rf"^Did not receive identification string from {at}", login(99, 2, 2), "Did not receive "),
        Shape(rf"^banner exchange: Connection from {at}: invalid format", login(99, 2, 2), "banner exchange"),
        Shape(r"^Received disconnect from \S+ port \d+:\d+: ", None, "Received disconnect", DROPPED),
        Shape(r"^error: kex_exchange_identification: ", None, "error: kex", DROPPED),
    ]
    return let(parsers.syslog_parse(line)["msg"], lambda msg: first_shape(msg, shapes, F.lit(None)))


def openssh_journal_noise(line: Column) -> Column:
    """Whether a line is the session module's own, which says again what sshd says."""
    return F.coalesce(parsers.syslog_parse(line)["msg"].rlike(r"^pam_unix\(sshd:[a-z]+\):"), F.lit(False))


def sudo(line: Column) -> Column:
    """A syslog line of sudo (class 3003)."""

    def session(activity: int, status: int, severity: int, message, actor: str = "actor"):
        def make(g):
            privileges = F.array(F.lit("ALL"))
            said = message(g) if callable(message) else F.lit(message)
            return ocsf.record(3003, F.lit(activity), F.lit(severity), "Sudo Project", "sudo", status_id=F.lit(status).cast("long"), user=_named(g("target")), actor=F.struct(_named(g(actor)).alias("user")), privileges=privileges, message=said)

        return make

    s = lambda x: F.coalesce(x, F.lit(""))
    was = lambda why: lambda g: F.concat(F.lit(f"{why}; command was "), s(g("command")))
    run = r"(?:TTY=(?P<tty>\S+) ; )?PWD=(?P<pwd>\S+) ; USER=(?P<target>\S+) ; (?:ENV=(?P<env>[^;]*) ; )?COMMAND=(?P<command>.*)$"
    who = r"^\s*(?P<actor>\S+) : "
    shapes = [
        Shape(rf"{who}(?P<attempts>\d+) incorrect password attempts? ; {run}", session(1, 2, 3, lambda g: F.concat(s(g("attempts")), F.lit(" incorrect password attempts; command was "), s(g("command"))))),
        Shape(rf"{who}user NOT in sudoers ; {run}", session(1, 2, 3, was("user NOT in sudoers"))),
        Shape(rf"{who}command not allowed ; {run}", session(1, 2, 2, was("command not allowed"))),
        Shape(rf"{who}a password is required ; {run}", session(1, 2, 3, was("a password is required"))),
        Shape(rf"{who}{run}", session(1, 1, 1, lambda g: s(g("command")))),
        Shape(r"^pam_unix\(sudo:session\): session opened for user (?P<target>\S+) by (?P<actor>\S*)\(uid=\d+\)$", session(2, 1, 1, "pam:session opened"), "pam_unix(sudo:session)"),
        Shape(r"^pam_unix\(sudo:session\): session closed for user (?P<target>\S+)$", session(2, 1, 1, "pam:session closed"), "pam_unix(sudo:session)"),
        Shape(r"^pam_unix\(sudo:auth\): authentication failure; logname=\S* uid=(?P<uid>\d+) euid=\d+ tty=(?P<tty>\S*) ruser=\S* rhost=\S* +user=(?P<user>\S+)$", session(1, 2, 3, lambda g: F.concat(F.lit("pam:auth authentication failure (uid="), g("uid"), F.lit(", tty="), s(g("tty")), F.lit(")")), "user"), "pam_unix(sudo:auth)"),
        Shape(r"^pam_unix\(sudo:auth\): auth could not identify password for \[(?P<user>[^\]]+)\]$", session(1, 2, 3, "pam:auth could not identify password", "user"), "pam_unix(sudo:auth)"),
        Shape(r"^pam_unix\(sudo:auth\): conversation failed$", session(1, 2, 2, "pam:auth conversation failed"), "pam_unix(sudo:auth)"),
        Shape(r"^\s*\S+ : \(command continued\) ", None, "", DROPPED),
    ]
    return let(parsers.syslog_parse(line)["msg"], lambda msg: first_shape(msg, shapes, F.lit(None)))


#: Severities by a firewall's level. Fixed values.
LEVELS = {"0": 5, "1": 5, "2": 5, "3": 4, "4": 3, "5": 2, "6": 1, "7": 1}
ASA = r"^(?:[^:]*: )?%ASA-(\d)-(\d+): (.*)$"
_FROM = r"(?P<ip>\S+?)/(?P<port>\d+)"
_ADMIN = rf" from {_FROM} to (?P<iface>[^:]+):(?P<to>\S+?)/(?P<service>\S+) for user (?P<user>\S+)$"
_SIDES = r"(?P<if1>[^:]+):(?P<ip>\S+?)/(?P<port>\d+){gap}(?P<if2>[^:]+):(?P<to>\S+?)/(?P<to_port>\d+)"


def asa(line: Column) -> Column:
    """A syslog line of an ASA firewall: logins (class 3002) and connections (4001). One record type holds both classes."""

    def record(class_uid, activity, severity, status=None, user=None, ip=None, port=None, to=None, to_port=None, protocol=None, number=None, message=None):
        long = lambda x: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast("long")
        name = lambda x: _none() if x is None else x
        net = class_uid == 4001
        some = lambda x, ok: F.when(F.lit(ok), x)
        side = lambda a, b: F.struct(name(a).alias("ip"), (_none() if b is None else b).try_cast("long").alias("port"))
        return ocsf.record(class_uid, F.lit(activity), severity, "Cisco Systems", "ASA", status_id=long(status), user=some(_named(name(user)), not net), src_endpoint=side(ip, port), dst_endpoint=some(side(to, to_port), net), connection_info=some(F.struct(name(protocol).alias("protocol_name"), long(number).alias("protocol_num")), net), message=message)

    def shapes(level: Column) -> dict[str, Shape]:
        rank = _by_name(level, LEVELS, 0)

        def login(activity, status, severity, says, *, ip=True):
            return lambda g: record(3002, activity, severity, status, g("user"), g("ip") if ip else None, message=says(g))

        def link(activity, severity, protocol, number, says):
            return lambda g: record(4001, activity, severity, None, None, g("ip"), g("port"), g("to"), g("to_port"), F.lit(protocol) if protocol else g("proto"), number, says(g))

        plain = lambda t: lambda g: F.lit(t)
        of = lambda t, *names: lambda g: F.format_string(t, *[F.coalesce(g(n), F.lit("")) for n in names])
        built = lambda p: rf"^Built (?P<way>\S+) {p} connection (?P<id>\d+) for " + _SIDES.format(gap=" .* to ")
        torn = lambda p: rf"^Teardown {p} connection (?P<id>\d+) for " + _SIDES.format(gap=" to ")
        return {
            "605004": Shape("^Login denied" + _ADMIN, login(1, 2, F.lit(3), of("ASA admin login denied (service=%s)", "service"))),
            "605005": Shape("^Login permitted" + _ADMIN, login(1, 1, rank, of("ASA admin login permitted (service=%s)", "service"))),
            "611101": Shape(r"^User authentication succeeded: IP, (?P<ip>\S+) : Uname: (?P<user>\S+)$", login(1, 1, rank, plain("ASA VPN user auth succeeded"))),
            "611102": Shape(r"^User authentication failed: IP, (?P<ip>\S+) : Uname: (?P<user>\S+)$", login(1, 2, F.lit(3), plain("ASA VPN user auth failed"))),
            "611103": Shape(r"^User logged out: Uname: (?P<user>\S+)$", login(2, 1, rank, plain("ASA VPN user logged out"), ip=False)),
            "109001": Shape(rf"^Auth start for user (?P<user>\S+) from {_FROM} to \S+?/\d+$", login(1, 1, rank, plain("ASA AAA auth start"))),
            "109005": Shape(rf"^Authentication succeeded for user (?P<user>\S+) from {_FROM} to \S+?/\d+ on interface (?P<iface>\S+)\.?$", login(1, 1, rank, of("ASA AAA auth succeeded (iface=%s)", "iface"))),
            "109017": Shape(r"user (?P<user>\S+)", login(1, 99, F.lit(3), of("ASA AAA insufficient resources: %s", "body"), ip=False)),
            "113012": Shape(r"^AAA user authentication Successful : server = (?P<server>\S+) : user = (?P<user>\S+)$", login(1, 1, rank, of("ASA AAA user accept (server=%s)", "server"), ip=False)),
            "302013": Shape(built("TCP"), link(1, rank, "tcp", 6, of("ASA TCP connection built (id=%s, direction=%s)", "id", "way"))),
            "302014": Shape(torn("TCP"), link(2, rank, "tcp", 6, of("ASA TCP connection teardown (id=%s)", "id"))),
            "302015": Shape(built("UDP"), link(1, rank, "udp", 17, of("ASA UDP connection built (id=%s, direction=%s)", "id", "way"))),
            "302016": Shape(torn("UDP"), link(2, rank, "udp", 17, of("ASA UDP connection teardown (id=%s)", "id"))),
            "106023": Shape(r"^Deny (?P<proto>\S+) src " + _SIDES.format(gap=" dst ") + r' by access-group "(?P<acl>[^"]+)"', link(5, F.lit(3), None, None, of("ASA ACL deny (acl=%s)", "acl"))),
        }

    def dispatch(msg: Column) -> Column:
        level, number, body = (F.regexp_extract(msg, ASA, i) for i in (1, 2, 3))
        out = None
        for n, s in shapes(level).items():
            value = let(body, partial(_one, s))
            # A known message in another wording is a record all the same, with nothing found in it.
            bare = F.struct(F.lit("record").alias("kind"), s.make(lambda name, b=body: b if name == "body" else _none()).alias("record"))
            here = F.coalesce(value, bare)
            out = F.when(number == n, here) if out is None else out.when(number == n, here)
        return F.when(msg.rlike(ASA), out)

    return let(parsers.syslog_parse(line)["msg"], dispatch)


#: What an API call does, by how its name starts; of these the first in order of the lists counts, 99 for others. Fixed values.
CALLS = {
    2: "Get Describe List Lookup Search Head Validate Simulate Check Decode BatchGet Scan Decrypt",
    1: "Create Put Add Run Start Allocate Register Provision Assume ConsoleLogin Login SignIn Federation Generate Encrypt Sign Publish Copy Import Restore Deliver",
    3: "Update Modify Set Attach Associate Enable Disable Activate Deactivate Tag Untag Replace Authorize Accept Change Reset Rotate Renew",
    4: "Delete Remove Detach Disassociate Terminate Stop Cancel Reject Revoke Deregister Release",
}
TRAIL = """eventName string, eventVersion string, eventSource string, eventTime string, requestID string, sourceIPAddress string, userAgent string, awsRegion string, recipientAccountId string, errorCode string, errorMessage string,
  eventID string, eventType string, eventCategory string, managementEvent boolean, readOnly boolean, requestParameters string, responseElements string, resources array<struct<ARN:string,accountId:string,type:string>>,
  userIdentity struct<userName:string,type:string,principalId:string,accountId:string,invokedBy:string,sessionContext:struct<sessionIssuer:struct<userName:string>,attributes:struct<creationDate:string,mfaAuthenticated:string>>>"""


def cloudtrail(line: Column) -> Column:
    """A CloudTrail event in JSON (class 6003). Free-form parts (requestParameters, responseElements) are kept as JSON text."""

    def make(c: Column) -> Column:
        name, who = c["eventName"], c["userIdentity"]
        said = F.coalesce(name, F.lit(""))
        activity = None
        for n, starts in CALLS.items():
            here = said.rlike("^(?:" + "|".join(starts.split()) + ")")
            activity = F.when(here, n) if activity is None else activity.when(here, n)
        activity = activity.otherwise(99)
        context = who["sessionContext"]
        user = F.struct(F.coalesce(who["userName"], context["sessionIssuer"]["userName"], who["invokedBy"], who["principalId"]).alias("name"), who["principalId"].alias("uid"), who["type"].alias("type"), F.struct(who["accountId"].alias("uid")).alias("account"))
        session = F.struct(context["attributes"]["creationDate"].alias("created_time"), context["attributes"]["mfaAuthenticated"].alias("is_mfa"))
        api = F.struct(name.alias("operation"), c["eventVersion"].alias("version"), _named(c["eventSource"]).alias("service"), F.struct(c["requestID"].alias("uid")).alias("request"))
        rest = F.struct(*[c[n].alias(n) for n in ("errorCode", "eventID", "eventType", "eventCategory", "managementEvent", "readOnly", "requestParameters", "responseElements")])
        record = ocsf.record(6003, activity, F.lit(1), "Amazon Web Services", "CloudTrail", status_id=F.when(c["errorCode"].isNotNull(), 2).otherwise(1).cast("long"), time=convert.to_int(convert.strptime(c["eventTime"], "%Y-%m-%dT%H:%M:%SZ"), "timestamp"), api=api, actor=F.struct(user.alias("user"), session.alias("session")), src_endpoint=_endpoint(c["sourceIPAddress"]), http_request=F.struct(c["userAgent"].alias("user_agent")), cloud=F.struct(F.lit("AWS").alias("provider"), c["awsRegion"].alias("region"), F.struct(c["recipientAccountId"].alias("uid")).alias("account")), resources=c["resources"], message=c["errorMessage"], unmapped=rest)
        return F.struct(F.lit("record").alias("kind"), record.alias("record"))

    return let(parsers.parse_json(line, TRAIL), lambda c: F.when(c.isNotNull(), make(c)))




#: What a delivery's state says: status, severity. Fixed values.
DELIVERY = {"sent": (1, 1), "deferred": (2, 2), "bounced": (2, 3)}
POSTFIX = r"^postfix/([a-z-]+)\[\d+\]: (.*)$"


def postfix(line: Column) -> Column:
    """A syslog line of Postfix's smtp, smtpd, qmgr or bounce (class 4009)."""

    def mail(activity, status, severity, says, *, sender=False, to=False, uid=False, size=False, src=False, dst=False):
        def make(g):
            rank = lambda x: x(g) if callable(x) else F.lit(x)
            some = lambda name, ok: g(name) if ok else _none()
            # A sender may be empty: it took part all the same.
            origin = F.coalesce(g("from"), F.lit("")) if sender else _none()
            email = F.struct(origin.alias("from"), F.when(F.lit(to), F.array(some("to", to))).alias("to"), some("queue", uid).alias("message_uid"), some("size", size).try_cast("long").alias("size"))
            source = F.when(F.lit(src), F.struct(some("ip", src).alias("ip"), some("host", src).alias("hostname")))
            return ocsf.record(4009, F.lit(activity), rank(severity), "The Postfix Project", "Postfix", status_id=rank(status).cast("long"), email=F.when(F.lit(sender or to or uid), email), src_endpoint=source, dst_endpoint=F.when(F.lit(dst), F.struct(some("ip", dst).alias("ip"))), message=says(g) if callable(says) else F.lit(says))

        return make

    of = lambda t, *names: lambda g: F.format_string(t, *[F.coalesce(g(n), F.lit("")) for n in names])
    by = lambda i, other: lambda g: _by_name(g("status"), {k: v[i] for k, v in DELIVERY.items()}, other)
    queue, peer = r"^(?P<queue>[A-F0-9]+): ", r"(?P<host>\S+?)\[(?P<ip>[^\]]+)\]"
    shapes = {
        "smtp": [Shape(queue + rf"to=<(?P<to>[^>]+)>(?:,\s*relay=(?:none|{peer}(?::\d+)?))?,\s*delay=[0-9.]+,\s*delays=\S+,\s*dsn=(?P<dsn>[0-9.]+),\s*status=(?P<status>\w+)(?:\s*\(.*\))?$", mail(1, by(0, 99), by(1, 1), of("Postfix smtp delivery (status=%s dsn=%s)", "status", "dsn"), to=True, uid=True, dst=True))],
        "smtpd": [
            Shape(rf"^connect from {peer}$", mail(2, 1, 1, "Postfix smtpd inbound connection", src=True), "connect from "),
            Shape(rf"^NOQUEUE: reject: RCPT from {peer}: (?P<reason>[^;]+); from=<(?P<from>[^>]*)> to=<(?P<to>[^>]+)>", mail(2, 2, 3, of("Postfix smtpd reject: %s", "reason"), sender=True, to=True, src=True), "NOQUEUE: "),
        ],
        "qmgr": [Shape(queue + r"from=<(?P<from>[^>]*)>(?:,\s*size=(?P<size>\d+))?(?:,\s*nrcpt=\d+)?\s*\((?P<state>[^)]+)\)$", mail(1, 1, 1, of("Postfix qmgr %s", "state"), sender=True, uid=True, size=True))],
        "bounce": [Shape(queue + r"sender non-delivery notification: (?P<bounce>[A-F0-9]+)$", mail(1, 2, 3, of("Postfix non-delivery notification (bounce_id=%s)", "bounce"), uid=True))],
    }

    def dispatch(msg: Column) -> Column:
        program, body = F.regexp_extract(msg, POSTFIX, 1), F.regexp_extract(msg, POSTFIX, 2)
        out = None
        for name, own in shapes.items():
            value = let(body, partial(_any_of, own))
            out = F.when(program == name, value) if out is None else out.when(program == name, value)
        return out

    return let(parsers.syslog_parse(line)["msg"], dispatch)


def _any_of(shapes: list[Shape], msg: Column) -> Column:
    return first_shape(msg, shapes)


#: Windows events: class, activity, severity, status (of logins), message. Fixed values.
WINDOWS = {
    4624: (3002, 1, 1, 1, "Windows logon success"),
    4625: (3002, 1, 3, 2, "Windows logon failure (status=%s substatus=%s)"),
    4634: (3002, 2, 1, 1, "Windows logoff"),
    4647: (3002, 2, 1, 1, "Windows logoff"),
    4688: (1007, 1, 1, None, "Process created"),
    4689: (1007, 4, 1, None, "Process terminated (status=%s)"),
    4720: (3001, 1, 2, None, "User account created"),
    4722: (3001, 2, 2, None, "User account enabled"),
    4724: (3001, 99, 2, None, "User account password reset by admin"),
    4725: (3001, 3, 2, None, "User account disabled"),
    4726: (3001, 4, 2, None, "User account deleted"),
    4732: (3006, 1, 2, None, "Group member added"),
    4733: (3006, 2, 2, None, "Group member removed"),
    4756: (3006, 1, 2, None, "Group member added"),
    4757: (3006, 2, 2, None, "Group member removed"),
}
WINDOWS_EVENT = "EventID long, EventTime string, Channel string, Hostname string, " + ", ".join(f"{n} string" for n in "TargetUserName TargetDomainName SubjectUserName SubjectDomainName IpAddress IpPort LogonType Status SubStatus NewProcessName CommandLine ParentProcessName ProcessName MemberName".split())


def windows(line: Column) -> Column:
    """A Windows security event in JSON: logins (class 3002), processes (1007), accounts (3001), groups (3006). One record type
    holds the four classes."""

    def account(name: Column, domain: Column) -> Column:
        known = F.when(name != "-", name)
        return F.when(domain.isNull() | (domain == "-"), known).otherwise(F.concat(domain, F.lit("\\"), known))

    def make(e: Column) -> Column:
        some = lambda x: F.when(x != "-", x)
        target, actor = account(e["TargetUserName"], e["TargetDomainName"]), account(e["SubjectUserName"], e["SubjectDomainName"])
        time = convert.to_int(convert.strptime(e["EventTime"], "%Y-%m-%d %H:%M:%S"), "timestamp")
        s = lambda x: F.coalesce(x, F.lit(""))
        out = None
        for number, (class_uid, activity, severity, status, says) in WINDOWS.items():
            login, process, group, logoff = class_uid == 3002, class_uid == 1007, class_uid == 3006, number in (4634, 4647)
            when = lambda ok, x: F.when(F.lit(ok), x)
            name = e["NewProcessName"] if number == 4688 else e["ProcessName"]
            program = F.struct(name.alias("name"), when(number == 4688, e["CommandLine"]).alias("cmd_line"), F.struct(when(number == 4688, e["ParentProcessName"]).alias("name")).alias("parent_process"))
            message = F.format_string(says, *[s(e[n]) for n in ("Status", "SubStatus")][: says.count("%s")]) if "%s" in says else F.lit(says)
            peer = F.struct(when(not logoff, some(e["IpAddress"])).alias("ip"), when(not logoff, some(e["IpPort"])).try_cast("long").alias("port"))
            record = ocsf.record(class_uid, F.lit(activity), F.lit(severity), "Microsoft Corporation", "Windows Event Log", status_id=F.lit(status).cast("long"), time=time, user=when(not process, _named(e["MemberName"] if group else target)), actor=F.struct(_named(when(not logoff, actor)).alias("user")), src_endpoint=when(login, peer), logon_type_id=when(login, e["LogonType"].try_cast("long")), group=when(group, _named(e["TargetUserName"])), process=when(process, program), device=_named(e["Hostname"]), message=message)
            value = F.struct(F.lit("record").alias("kind"), record.alias("record"))
            here = e["EventID"] == number
            out = F.when(here, value) if out is None else out.when(here, value)
        return out

    return let(parsers.parse_json(line, WINDOWS_EVENT), make)
