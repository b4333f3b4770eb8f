"""Mixing sources to target weights, DataFrame functions only.

Every row gets a hash-random key. Within a source rows are laid out by ranges of the key, as many as its rows ask for; sums of
sizes by range, then within a range, give the running total of words before each row (a distributed prefix sum: no task holds more
of a source than a range). Texts are read once, to count words; what is laid out is a small table of keys and sizes.
A source whose target is below its size is cut where the running total meets the target, in the middle of a row if need be; a
larger target takes whole passes (epochs) first and cuts the last one. So the words taken meet the target up to less than one.

Targets: source i of the ordered sources weighs w_i; targets are w_i times one level, but at most `max_epochs` times the
source's size; the level is such that they sum to the total (closed form of resharing the excess until none is above).

Results for special cases: a null text has size 0; null sources form one source, last in order; sources without words get
target 0; repeated rows count each time, ties of the key are broken by identifier and text hash; rows that share an identifier are
rows of their own (`mixed_docs` tells them apart by their texts); very long texts are whole, but may be cut by `mixed_docs` where
the budget ends; an empty table gives an empty result; other columns are passed over by `mix` and kept by `mixed_docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, same, saved, word_count

WEIGHTS = (5, 2, 1)
#: Rows that a range of keys holds on average.
RANGE_ROWS = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target; sizes: source, source_size. There are as few rows as sources."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    by = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), F.encode("source", "utf-8"))
    everything = Window.partitionBy()
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("open", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The level if all sources before this one are at their caps; the first source that is not above its cap fixes it.
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("before"), "level"))).over(everything)["level"]
    w = w.withColumn("level", level)
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, range_rows: int) -> DataFrame:
    """doc_id, size, tie (hash of the text), source, source_size, target, before (words of the source's rows with smaller keys)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"), F.xxhash64(text).alias("tie"))
    rows = saved(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(per_source.select("source", "source_size")).join(per_source.select(F.col("source").alias("s"), "n"), same(F.col("source"), F.col("s")))
    plan = plan.select("s", "source_size", "target", F.ceil(F.col("n") / range_rows).alias("ranges"))
    # The first 32 bits of the key place a row.
    at = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32)
    rows = rows.join(plan, same(F.col("source"), F.col("s"))).withColumn("range", at).drop("s", "ranges")
    sums = rows.groupBy(F.col("source").alias("s"), F.col("range").alias("range2")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("range2").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "range2", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    return rows.join(sums, same(F.col("source"), F.col("s")) & (F.col("range") == F.col("range2"))).withColumn("before", F.col("start") + F.col("upto") - F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, range_rows: int = RANGE_ROWS, ties: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = laid_out(docs, id_col, text_col, source_col, seed, range_rows)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["tie"] if ties else []))


def mixed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with all columns of docs: a document that k passes take whole stands there k times, one that the cut
    goes through is there with as many of its first words as are taken (cut in the text after that word). Rows are told by
    identifier, source and text; of rows that agree in all three one stands for all, with the words that they take together. A
    document of which nothing is taken goes."""
    m = mix(docs, id_col, text_col, source_col, ties=True, **how).groupBy("doc_id", "source", "tie", "size").agg(F.sum("taken").alias("__taken__"), F.count("*").alias("__rows__"))
    m = m.select(F.col("doc_id").alias("__id__"), F.col("source").alias("__source__"), F.col("tie").alias("__tie__"), F.col("size").alias("__size__"), "__taken__", "__rows__")
    m = saved(m.where("__taken__ > 0"), "mix")
    here = docs.withColumn("__own_tie__", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    if not m.where("__rows__ > 1").isEmpty():
        here = here.dropDuplicates([id_col, source_col, "__own_tie__"])
    told = here[id_col].eqNullSafe(m["__id__"]) & here[source_col].eqNullSafe(m["__source__"]) & (F.col("__own_tie__") == F.col("__tie__"))
    whole = F.floor(F.col("__taken__") / F.col("__size__")).cast("int")
    part = (F.col("__taken__") % F.col("__size__")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    first = lambda n: F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, n), "")
    out = here.join(m, told).withColumn("__cut__", F.explode(copies))
    return out.withColumn(text_col, F.when(F.col("__cut__") > 0, first(F.col("__cut__"))).otherwise(F.col(text_col))).select(*docs.columns)
