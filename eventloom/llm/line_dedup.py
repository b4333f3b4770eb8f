"""Line dedup by site-relative frequency, DataFrame functions only.

For each host, a line's pages are counted (each page once) and divided by the host's pages; lines above `percent` of them, on at
least `min_pages` pages, are boilerplate and dropped. Only digests of lines are dealt out by host and line, combined before the
shuffle; a hot host's lines lie apart, and what meets in one task for a line is one partial count from each task. The digests of
boilerplate meet the lines' digests again by host and line (Spark broadcasts them below its size threshold and splits hot lines),
and each page gets the numbers of its lines that go. Pages meet these numbers by page, so no task holds the pages of a host.

Results for special cases: a null host is a host of its own; a null or empty text has no lines and stays as an empty text; lines
are compared trimmed of spaces, tabs and carriage returns, blank ones don't count and stay; very long texts are whole; repeated
rows count as pages of their own and get the same result; ties don't arise, as counts decide; an empty table gives an empty
result; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import same

BLANK = " \t\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def boilerplate(lines: DataFrame, rows: DataFrame, percent: int, min_pages: int) -> DataFrame:
    """bad_host, bad_line (digest); lines: host, line (digest) of each page once; rows: host of each page."""
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = rows.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    often = often.join(totals, same(F.col("host"), F.col("h")))
    return often.where(F.col("n") * 100 > F.col("pages") * percent).select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line"))


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, text: Column, percent: int = 30, min_pages: int = 3) -> DataFrame:
    """One row for each row of pages: page_id, host, n_lines, n_dropped, clean_text."""
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    split = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    rows = rows.select("page_id", "host", split.alias("lines"), F.xxhash64("text").alias("own"))
    # Places of the lines that aren't blank, by digest: a line that stands on a page several times is one entry.
    places = rows.select("page_id", "host", "own", F.posexplode(F.transform("lines", trimmed)).alias("place", "line")).where("line <> ''")
    places = places.withColumn("line", F.unhex(F.md5("line")))
    once = rows.select("host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: trimmed(x) != ""), lambda x: F.unhex(F.md5(trimmed(x)))))).alias("line"))
    bad = boilerplate(once, rows, percent, min_pages)
    gone = places.join(bad, same(F.col("host"), F.col("bad_host")) & (F.col("line") == F.col("bad_line")))
    # Rows that agree in identifier, host and text lose the same lines, so these may be told by their hash.
    gone = gone.groupBy(F.col("page_id").alias("g_id"), F.col("host").alias("g_host"), F.col("own").alias("g_own")).agg(F.collect_set("place").alias("gone"))
    found = rows.join(gone, same(F.col("page_id"), F.col("g_id")) & same(F.col("host"), F.col("g_host")) & (F.col("own") == F.col("g_own")), "left")
    kept = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), F.array_contains("gone", i).alias("out"))), lambda s: ~s["out"]), lambda s: s["x"])
    found = found.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    return found.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("clean_text"))
