"""Readers and writers of event files; streams take the same options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.parsers import extract_pri

ENVELOPE = "received_at long, source struct<ip:string,port:int>, ingress string, egress string, workspace string"


def lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One event for each line that isn't empty: ingress, egress, source, received_at (nanoseconds)."""
    text = (spark.readStream if stream else spark.read).text(path).where("value <> ''")
    now = (F.unix_micros(F.current_timestamp()) * 1000).alias("received_at")
    return text.select(now, F.struct(F.lit("127.0.0.1").alias("ip"), F.lit(0).alias("port")).alias("source"), F.col("value").alias("ingress"), F.col("value").alias("egress"))


def valid_pri(events: DataFrame, column: str = "ingress") -> DataFrame:
    """Events with a syslog priority from 0 to 191."""
    return events.where(extract_pri(F.col(column)).isNotNull())


def replay(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events written as JSON lines; lines that aren't JSON are left out, egress is ingress where it is missing."""
    text = (spark.readStream if stream else spark.read).text(path)
    event = text.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*").where("ingress is not null")
    plain = lambda c: F.coalesce(F.make_valid_utf8(F.unbase64(F.regexp_extract(c, r'^\{"\$bytes_b64":"([A-Za-z0-9+/=]*)"\}$', 1)).cast("string")), F.lit(""))
    read = lambda c: F.when(F.startswith(F.col(c), F.lit('{"$bytes_b64"')), plain(c)).otherwise(F.col(c))
    event = event.withColumns({"ingress": read("ingress"), "egress": read("egress")})
    return event.withColumn("egress", F.coalesce("egress", "ingress"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table from a CSV with a header, or from one JSON object as key and value (text, or JSON for what isn't text)."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")))


def placed(shipped: DataFrame, before: str, part: Column, after: str) -> DataFrame:
    """shipped with the path that each payload goes to: a template with one value in it. Slashes in the value become _; null for
    a value that is empty or holds .., which a flow treats as failed."""
    clean = F.regexp_replace(part, r"[/\\]", "_")
    return shipped.withColumn("path", F.when((clean != "") & ~F.contains(part, F.lit("..")), F.concat(F.lit(before), clean, F.lit(after))))


def write_placed(placed_: DataFrame, path: str) -> None:
    """Payloads as text files, a folder for each path (its slashes as %2F, as Spark escapes them)."""
    placed_.select("path", "payload").write.partitionBy("path").mode("append").text(path)


def write_lines(shipped: DataFrame, path: str) -> None:
    """Payloads as text files, a folder for each output."""
    shipped.select("output", "payload").write.partitionBy("output").mode("append").text(path)


def write_dead_letters(dead: DataFrame, path: str) -> None:
    dead.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX")).write.mode("append").json(path)
