"""Exact dedup: a tree of merges of sorted digest runs, DataFrame functions only.

Every input partition is a run of entries (digest, length, second digest), which keep the run's largest identifier and its number
of rows. Runs merge in binomial rounds: in each, `fan_in` partner runs (two rounds of pairs at once, by default) exchange their
entries by ranges of the digest. A merged run has as many ranges as it has runs in it, so the number of tasks stays and each task
takes a range from each partner, sorts it and merges equal digests; a merge keeps the verified largest identifier. After the last
round one run is left, in ranges. However many copies a text has, a merge sees one entry of it from each run, so no task gets a
hot text's rows; on the way back, too, a text's verdict goes to its runs first and there to the rows.

Results for special cases: a null text counts as empty; a null doc_id is smaller than any other, so it is kept only where all
of a group are null; rows that repeat both doc_id and text are one document and get the same verdict (`dedup` leaves one); ties
don't arise otherwise; very long texts count by digest like others; an empty table gives an empty result; other columns are passed
over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import same, saved

#: Entries are one text if both digests and the length agree: SHA-256 finds, the others verify.
KEY = ["_digest", "_length", "_second"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """KEY, _id and _run of each row; texts are read here only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_length"), F.xxhash64(text).alias("_second"))
    return saved(rows.withColumn("_run", F.spark_partition_id()), "digests")


def entries(rows: DataFrame) -> DataFrame:
    """The runs: an entry for each text of each run."""
    return rows.groupBy("_run", *KEY).agg(F.max(F.struct("_id")).alias("_top"), F.count("*").alias("_n"))


def merged(runs: DataFrame, number: int, fan_in: int = 4) -> DataFrame:
    """KEY, keep_id and group_size of each distinct text of `number` runs."""
    at, left, ranges = F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long"), number, 1
    while left > 1:
        left, ranges = -(-left // fan_in), min(number, ranges * fan_in)
        place = F.floor(F.col("_run") / fan_in) * ranges + F.shiftright(at * ranges, 32)
        met = runs.withColumn("_place", place.cast("int")).repartitionById(left * ranges, "_place").sortWithinPartitions("_place", *KEY)
        runs = met.groupBy("_place", *KEY).agg(F.max("_top").alias("_top"), F.sum("_n").alias("_n")).withColumn("_run", F.floor(F.col("_place") / ranges).cast("int"))
    return runs.select(*KEY, F.col("_top._id").alias("keep_id"), F.col("_n").alias("group_size"))


def _verdicts(rows: DataFrame, fan_in: int) -> DataFrame:
    """rows with keep_id and group_size."""
    number = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    runs = entries(rows)
    # Single texts, the most, needn't meet their documents again: only groups go back.
    groups = merged(runs, number, fan_in).where("group_size > 1")
    back = runs.select("_run", *KEY).join(groups, KEY)
    return rows.join(back, ["_run", *KEY], "left").select("_id", "_digest", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _verdicts(keyed(docs, id_col, text_col), fan_in)
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", same(F.col("_id"), F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; all columns are kept as they are. Only the rows that
    go meet the documents."""
    out = saved(_verdicts(keyed(docs, id_col, text_col), fan_in).where("group_size > 1"), "verdicts")
    kept = same(F.col("_id"), F.col("keep_id"))
    sha = "__text_sha256__"
    gone = out.where(~kept).select(F.col("_id").alias("__gone_id__"), F.col("_digest").alias("__gone_sha__")).distinct()
    rows = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["__gone_id__"]) & (rows[sha] == gone["__gone_sha__"]), "left_anti")
    if not out.where(kept).groupBy("_id", "_digest").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, sha])
    return rows.drop(sha)
