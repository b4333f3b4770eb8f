"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are the sum of committed batches of signed deltas: an insert adds a document's
tokens, a delete takes them away, a revised count takes the old away and adds the new. Each batch is aggregated before it is
written (one small table for each batch). A batch is written beside the store and committed by one rename to its identifier, so
of several senders of one batch one wins and the others change nothing; what failed attempts left is never read. `compact` folds
committed batches into a snapshot that remembers their identifiers, so they stay committed; batches that the snapshot before had
folded already are removed then, as no reader looks at them any more.

Results for special cases: null source, language or version is a group of its own; a null text has 0 tokens and counts as a
document; repeated rows count each time; a group whose documents are all deleted leaves the totals; an empty batch commits and
changes nothing; other columns are passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TABLE = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(docs: DataFrame, tokens: Column, version: str, sign: int = 1) -> DataFrame:
    """A signed delta for each row of docs: KEYS, docs, tokens."""
    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))


def deletes(docs: DataFrame, tokens: Column, version: str) -> DataFrame:
    return inserts(docs, tokens, version, -1)


def revisions(docs: DataFrame, old: Column, old_version: str, new: Column, new_version: str) -> DataFrame:
    """Old counts go, new ones come; one pass over docs."""
    side = lambda tokens, version, sign: F.struct(F.lit(version).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))
    both = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.explode(F.array(side(old, old_version, -1), side(new, new_version, 1))).alias("d"))
    return both.select("source", "lang", "d.*")


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """The store, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self) -> dict[str, str]:
        """Complete tables (paths) by name."""
        top = self._path(self.folder)
        found = [x.getPath() for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return {p.getName(): p.toString() for p in found if self._fs.exists(self._path(p, "_SUCCESS"))}

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The latest snapshot and the batches in it."""
        names = sorted(n for n in self._complete() if n.startswith("snapshot="))
        if not names:
            return None, set()
        stream = self._fs.open(self._path(f"{self.folder}/{names[-1]}/_batches"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return names[-1], set(json.loads(text))

    def committed(self) -> set[str]:
        return self._snapshot()[1] | {n[6:] for n in self._complete() if n.startswith("batch=")}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Whether the batch was new."""
        if batch in self.committed():
            return False
        work = f"{self.folder}/.work-{uuid.uuid4().hex}"
        summed(deltas).write.parquet(work)
        return self._renamed(work, f"{self.folder}/batch={batch}")

    def _renamed(self, work: str, to: str) -> bool:
        """Whether `work` became `to`. If another has that name, a file system refuses, or puts `work` inside, where its hidden
        name keeps it from being read."""
        at = self._path(to)
        if self._fs.exists(at) and not self._fs.exists(self._path(at, "_SUCCESS")):
            self._fs.delete(at, True)  # what an attempt without a rename left
        done = not self._fs.exists(at) and self._fs.rename(self._path(work), at)
        inside = self._path(at, self._path(work).getName())
        if done and not self._fs.exists(inside):
            return True
        for p in (inside, self._path(work)):
            self._fs.delete(p, True)
        return False

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens of the groups that have documents or tokens."""
        name, folded = self._snapshot()
        paths = [p for n, p in self._complete().items() if n == name or n.startswith("batch=") and n[6:] not in folded]
        if not paths:
            return self.spark.createDataFrame([], TABLE)
        tables = self.spark.read.schema(TABLE).parquet(*paths)
        return summed(tables).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into a new snapshot. Batches committed meanwhile are not in it and stay as they are; of two
        compactions at once both snapshots are right, and the one of the later name counts."""
        done = self._complete()
        old, folded = self._snapshot()
        batches = {n[6:] for n in done if n.startswith("batch=")}
        number = 1 + max((int(n[9:18]) for n in done if n.startswith("snapshot=")), default=0)
        work = f"{self.folder}/.work-{uuid.uuid4().hex}"
        paths = [done[n] for n in done if n == old or n.startswith("batch=") and n[6:] not in folded]
        tables = self.spark.read.schema(TABLE).parquet(*paths) if paths else self.spark.createDataFrame([], TABLE)
        summed(tables).coalesce(1).write.parquet(work)
        out = self._fs.create(self._path(f"{work}/_batches"))
        out.write(bytearray(json.dumps(sorted(folded | batches)).encode()))
        out.close()
        if not self._renamed(work, f"{self.folder}/snapshot={number:09d}-{uuid.uuid4().hex}"):
            raise OSError(f"the snapshot of {self.folder} could not be renamed")
        gone = [n for n in done if n.startswith("batch=") and n[6:] in folded or n.startswith("snapshot=") and old and n < old]
        for n in gone:
            self._fs.delete(self._path(done[n]), True)
