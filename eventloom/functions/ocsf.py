"""The common event schema: records by class, and their JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .convert import null_omit_json

VERSION = "1.3.0"
#: The fields of each class beside class, category, activity, type, severity, time, message and metadata, in order. Fixed values.
CLASSES = {
    1001: "file actor device user",
    1007: "process actor device",
    1008: "reg_key actor device",
    1009: "reg_value actor device",
    2002: "finding_info vulnerabilities affected_packages resources",
    2003: "finding_info compliance resource remediation",
    2004: "finding_info disposition_id src_endpoint dst_endpoint actor attack malware evidences",
    2005: "status_id finding_info assignee priority impact_id",
    3001: "user actor src_endpoint",
    3002: "status_id user src_endpoint dst_endpoint auth_protocol auth_protocol_id service session logon_type_id",
    3003: "status_id user actor session src_endpoint privileges",
    3005: "user actor privileges resource",
    3006: "group user actor",
    4001: "src_endpoint dst_endpoint connection_info traffic",
    4002: "status_id src_endpoint dst_endpoint actor http_request http_response traffic",
    4003: "rcode_id src_endpoint dst_endpoint query answers",
    4004: "src_endpoint dst_endpoint is_renewal lease_dur",
    4005: "src_endpoint dst_endpoint protocol_ver capabilities device user",
    4006: "src_endpoint dst_endpoint share share_type_id file command",
    4007: "src_endpoint dst_endpoint protocol_ver client_hassh server_hassh auth_type user",
    4008: "src_endpoint dst_endpoint command codes port file",
    4009: "direction_id src_endpoint dst_endpoint email smtp_hello",
    4010: "src_endpoint dst_endpoint file share actor",
    6003: "status_id api actor src_endpoint dst_endpoint http_request cloud resources unmapped",
    6004: "src_endpoint dst_endpoint http_request http_response web_resources actor",
    6005: "actor src_endpoint database databucket table query_info",
    6007: "scan actor devices policy",
}


def record(class_uid: int, activity: Column, severity: Column, vendor: str, product: str, **fields: Column) -> Column:
    """A record as a struct: the envelope, then the class's own fields."""
    head = {"class_uid": F.lit(class_uid).cast("long"), "category_uid": F.lit(class_uid // 1000).cast("long"), "activity_id": activity.cast("long"), "type_uid": (F.lit(class_uid * 100) + activity).cast("long"), "severity_id": severity.cast("long")}
    metadata = F.struct(F.struct(F.lit(vendor).alias("vendor_name"), F.lit(product).alias("name")).alias("product"), F.lit(VERSION).alias("version"))
    return F.struct(*[c.alias(n) for n, c in (head | fields | {"metadata": metadata}).items()])


def compose(event: Column, names: Sequence[str], received_at: Column, classes: Sequence[int] = tuple(CLASSES)) -> Column:
    """The JSON of a record, by its class: the class's fields that the record (with these field names) has and that aren't null;
    `time` is received_at where the record has none. Null where the class isn't known, which a flow sends to the dead letters.
    `classes` narrows down what can come, which makes the plan small."""

    def body(class_uid: int) -> Column:
        time = F.coalesce(event["time"], received_at) if "time" in names else received_at
        head = {"class_uid": F.lit(class_uid), "category_uid": F.lit(class_uid // 1000), "activity_id": event["activity_id"], "type_uid": F.lit(class_uid * 100) + event["activity_id"], "severity_id": event["severity_id"]}
        own = CLASSES[class_uid].split()
        rest = [n for n in ("status_id",) if n in own]
        last = [n for n in own if n not in rest] + ["message", "metadata"]
        parts = [c.alias(n) for n, c in head.items()] + [event[n].alias(n) for n in rest if n in names] + [time.alias("time")] + [event[n].alias(n) for n in last if n in names]
        return null_omit_json(F.struct(*parts))

    out = None
    for class_uid in classes:
        out = F.when(event["class_uid"] == class_uid, body(class_uid)) if out is None else out.when(event["class_uid"] == class_uid, body(class_uid))
    return out


def replayable(received_at: Column, source: Column, ingress: Column) -> Column:
    """An event's JSON that `sources.replay` reads back."""
    return F.to_json(F.struct(received_at.alias("received_at"), source.alias("source"), ingress.alias("ingress")))
