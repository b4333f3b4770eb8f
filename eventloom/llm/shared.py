"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary one in local mode
    only (tests), as other machines wouldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as a table in the shared folder (in folders by a column's values, if named) and read again: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `saved` wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: what numbers of parts are derived from, so that they follow the data."""
    return rows.agg(F.sum(F.octet_length(column))).first()[0] or 0


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df by key over twice as many tasks as there are parts, so that a task's share doesn't grow with the data."""
    return df.repartition(2 * parts, key)


def same(left, right):
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def let(value: F.Column, use) -> F.Column:
    """use(value), with the value worked out once however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHash(dict):
    """64-bit hash of each word, kept for words seen lately; bounded in number and length, so that a task's memory is."""

    LIMIT, LONGEST = 150_000, 64

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.LONGEST:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Spark's own number of rows in a batch for Python, and what texts get instead.
ROWS, TEXT_ROWS = "10000", "1000"


def text_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to send texts to Python in batches of TEXT_ROWS, unless it has a setting of its own: a batch of long
    texts is held by the JVM, Arrow and Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == ROWS:
        df.sparkSession.conf.set(key, TEXT_ROWS)
    return df


def given_back(*caches: dict) -> None:
    """At a task's end: what its worker remembers goes, and memory that Arrow keeps for later goes back to the system, so that idle
    workers of a reused pool are small."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; one of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = mixed(words[:n] + np.uint64(min(k, len(words))))
    for j in range(1, min(k, len(words))):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return np.unique(h)
