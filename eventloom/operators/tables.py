"""Keyed tables: lookups, membership, dedup and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(events: DataFrame, table: DataFrame, on: str, key: str, value: str, name: str) -> DataFrame:
    """events with the table's value by key, null where it has none. Spark broadcasts the table only below its size threshold."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias(name)).dropDuplicates(["_k"])
    return events.join(t, events[on] == t["_k"], "left").drop("_k")


def known(events: DataFrame, table: DataFrame, on: str, key: str) -> DataFrame:
    t = table.select(F.col(key).alias("_k"))
    return events.join(t, events[on] == t["_k"], "left_semi")


def unknown(events: DataFrame, table: DataFrame, on: str, key: str) -> DataFrame:
    t = table.select(F.col(key).alias("_k"))
    return events.join(t, events[on] == t["_k"], "left_anti")


def dedup_refreshed(events: DataFrame, keys: list[str], ts: str, ttl_seconds: float, tie: str) -> DataFrame:
    """Events whose key wasn't seen within the time to live before; each event refreshes its key."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= int(ttl_seconds * 1_000_000))).drop("_gap")


def dedup_ttl(events: DataFrame, keys: list[str], ts: str, ttl_seconds: float, tie: str) -> DataFrame:
    """Events whose key let none pass within the time to live before. Null keys are one key; events without a time pass, and
    others don't look at them.

    Spark sorts by key and time and marks where a run of events less than the time to live apart starts; its first event passes.
    Inside a run the next one to pass is looked up by time, so a task's work grows with the events that pass, and it keeps one
    number however many rows a key has."""
    ttl = int(ttl_seconds * 1_000_000)
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = events.withColumn("_at", at).withColumn("_new", F.coalesce(F.col("_at") - F.lag("_at").over(w) >= ttl, F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for b in batches:
            t, new = b.column(b.num_columns - 2).fill_null(0).to_numpy(), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            keep, ends = new.copy(), np.append(np.flatnonzero(new), len(new))
            runs = list(zip(ends[:-1], ends[1:], strict=True))
            if len(new) and ends[0] > 0:  # the run that the last batch began
                runs.insert(0, (0, ends[0]))
            for a, e in runs:
                if new[a]:
                    last, a = t[a], a + 1
                while a < e:
                    a += np.searchsorted(t[a:e], last + ttl)
                    if a < e:
                        keep[a], last, a = True, t[a], a + 1
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]).filter(pa.array(keep))

    return marked.mapInArrow(run, events.schema)


def rate_limit(events: DataFrame, keys: list[str], ts: str, limit: int, seconds: int, tie: str) -> DataFrame:
    """At most `limit` events of a key in each interval of the clock, the earliest ones."""
    cell = F.floor(F.unix_timestamp(ts) / seconds)
    w = Window.partitionBy(*keys, cell).orderBy(ts, tie)
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def merged(events: DataFrame, by: list[str], item: Column, batch: int, order: str) -> DataFrame:
    """Events merged into batches of at most `batch` by shared attributes: by, part, items (JSON array text), n."""
    w = Window.partitionBy(*by).orderBy(order)
    part = events.withColumn("_part", F.floor((F.row_number().over(w) - 1) / batch))
    return part.groupBy(*by, F.col("_part").alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("_item")))), lambda x: x["_item"])).alias("items"), F.count("*").alias("n"))


def fan_in(*events: DataFrame) -> DataFrame:
    """Events of several inputs as one; columns that an input lacks are null."""
    first, *rest = events
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first


def _ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, null where it is none."""
    part = F.split(ip, r"\.", -1)
    ok = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    n = F.aggregate(F.transform(part, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    return F.when(ok & F.forall(part, lambda p: p.try_cast("long") <= 255), n)


def in_range(events: DataFrame, ranges: DataFrame, on: str, first: str, last: str, values: list[str]) -> DataFrame:
    """events with the values of the range of IPv4 addresses that theirs is in; null where there is none. Ranges don't overlap.

    An equality join by blocks of 65,536 addresses: a range has a row for each block that it touches, so every event meets only
    the few ranges of its block, whatever the size of either side; Spark broadcasts the ranges only below its threshold."""
    lo, hi = _ip_number(F.col(first)), _ip_number(F.col(last))
    r = ranges.select(lo.alias("_lo"), hi.alias("_hi"), *[F.col(v).alias(f"_v_{v}") for v in values]).where("_lo <= _hi")
    r = r.withColumn("_block", F.explode(F.sequence(F.shiftright("_lo", 16), F.shiftright("_hi", 16))))
    e = events.withColumn("_ip", _ip_number(F.col(on))).withColumn("_b", F.shiftright("_ip", 16))
    met = e.join(r, (F.col("_b") == F.col("_block")) & F.col("_ip").between(F.col("_lo"), F.col("_hi")), "left")
    return met.select(*events.columns, *[F.col(f"_v_{v}").alias(v) for v in values])


def lookup_as_of(lookups: DataFrame, changes: DataFrame, key: str, order: list[str], name: str, ttl_seconds: float | None = None) -> DataFrame:
    """lookups with the value that a changing table has for their key at their place in the order, as `name`.

    changes: key, value, gone (a delete), the `order` columns, of which the first is a time; an upsert ends with its time to live.
    One sort by key and order: each lookup sees the last change before it, so no task pairs lookups with changes, and a hot key
    streams through with one change kept. A change and a lookup at one place: the change comes first."""
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    c = changes.select(F.col(key).alias("_key"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.lit(0).alias("_kind"), F.struct("value", "gone", at.alias("at")).alias("_change"), at.alias("_at"))
    columns = lookups.columns
    e = lookups.select(F.col(key).alias("_key"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.lit(1).alias("_kind"), at.alias("_at"), F.struct(*columns).alias("_event"))
    w = Window.partitionBy("_key").orderBy(*[f"_o{i}" for i in range(len(order))], "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.unionByName(c, allowMissingColumns=True).withColumn("_last", F.last("_change", ignorenulls=True).over(w)).where("_kind = 1")
    alive = ~F.col("_last.gone")
    if ttl_seconds is not None:
        alive = alive & (F.col("_at") - F.col("_last.at") < int(ttl_seconds * 1_000_000))
    return seen.select(*[F.col("_event")[n].alias(n) for n in columns], F.when(alive & F.col("_key").isNotNull(), F.col("_last.value")).alias(name))


def current(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key and value of a table after all changes: a key's last one, unless it is a delete; combined before the shuffle."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("value", "gone"), F.struct(*order)).alias("_c"))
    return last.where("not _c.gone").select(key, F.col("_c.value").alias("value"))
