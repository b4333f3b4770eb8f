"""Event flows: a pipeline of steps over events as one lazily built DataFrame.

A step acts on events that are still running; a drop, a finish or an error ends an event's run. Payloads taken for an output
before that still ship. Everything is columns, so Catalyst sees one projection; each output reads only what it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME, REASON, STEP, OUTPUTS = "_outcome", "_reason", "_step", "_outputs"
SHIPMENT = "array<struct<output:string,payload:string>>"
#: Texts of the dead letters' contract. Fixed values.
ERROR, PIPELINE, FAILED = "explicit error routing", "(pipeline)", "process failed: "


class Flow:
    def __init__(self, events: DataFrame, name: str = "flow"):
        self.name, self.inputs, self.only = name, events.columns, None
        none = F.lit(None).cast("string")
        self.df = events.withColumns({OUTCOME: none, REASON: none, STEP: none, OUTPUTS: F.array().cast(SHIPMENT)})

    def _with(self, df: DataFrame) -> Flow:
        new = object.__new__(Flow)
        new.name, new.inputs, new.df, new.only = self.name, self.inputs, df, self.only
        return new

    @property
    def running(self) -> Column:
        return F.col(OUTCOME).isNull() if self.only is None else F.col(OUTCOME).isNull() & self.only

    def set(self, **columns: Column) -> Flow:
        """Columns for events that run; other events keep what they have."""
        return self._with(self.df.withColumns({k: F.when(self.running, v).otherwise(F.col(k)) if k in self.df.columns else F.when(self.running, v) for k, v in columns.items()}))

    def _end(self, outcome: str, when: Column, reason: Column, step: str) -> Flow:
        ends = self.running & F.coalesce(when, F.lit(False))
        put = lambda c, v: F.when(ends, v).otherwise(F.col(c))
        return self._with(self.df.withColumns({OUTCOME: put(OUTCOME, F.lit(outcome)), REASON: put(REASON, reason), STEP: put(STEP, F.lit(step))}))

    def drop_if(self, when: Column) -> Flow:
        return self._end("dropped", when, F.lit(None).cast("string"), "drop")

    def finish_if(self, when: Column) -> Flow:
        return self._end("finished", when, F.lit(None).cast("string"), "finish")

    def error_if(self, when: Column, reason: str | Column = ERROR, step: str = PIPELINE) -> Flow:
        return self._end("errored", when, reason if isinstance(reason, Column) else F.lit(reason), step)

    def parse(self, step: str, name: str, value: Column, reason: str) -> Flow:
        """A parsed column; events that it is null for go to the dead letters."""
        return self.set(**{name: value}).error_if(F.col(name).isNull(), FAILED + reason, step)

    def recover(self, step: str, **columns: Column) -> Flow:
        """Events that failed in a step run on with these columns."""
        failed = (F.col(OUTCOME) == "errored") & (F.col(STEP) == step)
        df = self.df.withColumn("_was", F.coalesce(failed, F.lit(False)))
        put = lambda c, v: F.when(F.col("_was"), v).otherwise(F.col(c)) if c in df.columns else F.when(F.col("_was"), v)
        none = F.lit(None).cast("string")
        return self._with(df.withColumns({k: put(k, v) for k, v in columns.items()} | {c: put(c, none) for c in (REASON, OUTCOME, STEP)}).drop("_was"))

    def attempt(self, body, catch=None) -> Flow:
        """body (a flow to a flow) for events that run; those that fail in it get back the columns that they had before, and the
        reason as _error while `catch` runs for them. Drops and finishes in either stay; payloads taken by body before it failed
        don't ship."""
        before = [c for c in self.df.columns if not c.startswith("_try_")]
        level = sum(c.startswith("_try_") for c in self.df.columns)
        kept = f"_try_{level}"
        tried = body(self._with(self.df.withColumn(kept, F.struct(self.running.alias("_ran"), *before)))).df
        failed = F.col(kept)["_ran"] & F.coalesce(F.col(OUTCOME) == "errored", F.lit(False))
        tried = tried.withColumn("_failed", failed).withColumn("_error", F.when(F.col("_failed"), F.col(REASON)))
        names = [c for c in tried.columns if c not in ("_failed", "_error") and not c.startswith("_try_")]
        back = tried.withColumns({c: F.when(F.col("_failed"), F.col(kept)[c] if c in before else F.lit(None)).otherwise(F.col(c)) for c in names})
        caught = self._with(back)
        if catch is not None:
            caught.only = F.col("_failed") if self.only is None else self.only & F.col("_failed")
            caught = catch(caught)
        out = self._with(caught.df.drop("_failed", "_error", kept))
        out.only = self.only
        return out

    def merge(self, record: Column, names: list[str]) -> Flow:
        """A struct's fields as columns; a null one changes nothing."""
        there = lambda n: F.when(record.isNotNull(), record[n])
        return self.set(**{n: there(n).otherwise(F.col(n)) if n in self.df.columns else there(n) for n in names})

    def each(self, array: Column, start: Column, step, **columns) -> Flow:
        """A loop over an array: step(state, item) from `start` on; columns take what their functions make of the last state.
        Where there is no array, nothing changes."""
        last = F.aggregate(array, start, step)
        put = lambda n, v: F.when(array.isNotNull(), v).otherwise(F.col(n)) if n in self.df.columns else F.when(array.isNotNull(), v)
        return self.set(**{n: put(n, make(last)) for n, make in columns.items()})

    def output(self, name: str, payload: Column, when: Column | None = None) -> Flow:
        """Takes a payload for an output; the event runs on."""
        takes = self.running & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
        item = F.array(F.struct(F.lit(name).alias("output"), payload.cast("string").alias("payload")))
        return self._with(self.df.withColumn(OUTPUTS, F.when(takes, F.concat(F.col(OUTPUTS), item)).otherwise(F.col(OUTPUTS))))

    def switch(self, value: Column, cases: dict, default=None) -> Flow:
        """cases: value to a payload's output name; the first that is equal takes the event to that output."""
        flow = self
        for case, (output, payload) in cases.items():
            flow = flow.output(output, payload, value == F.lit(case))
        return flow.output(*default, ~F.coalesce(value.isin(list(cases)), F.lit(False))) if default else flow

    def result(self) -> DataFrame:
        """All events with their outcome: finished, discarded (no output took it), dropped or errored."""
        done = F.when(F.size(OUTPUTS) > 0, "finished").otherwise("discarded")
        return self.df.withColumn(OUTCOME, F.when(self.running | (F.col(OUTCOME) == "finished"), done).otherwise(F.col(OUTCOME)))

    def shipped(self, *keep: str) -> DataFrame:
        """A row for each payload taken."""
        return self.df.select(*keep, F.explode(OUTPUTS).alias("_x")).select(*keep, "_x.output", "_x.payload")

    def dead_letters(self) -> DataFrame:
        """reason, process, pipeline and the event as it came: received_at, source and ingress, where the events have these."""
        envelope = [c for c in ("received_at", "source", "ingress") if c in self.inputs]
        event = F.to_json(F.struct(*(envelope if "ingress" in envelope else self.inputs)))
        return self.df.where(F.col(OUTCOME) == "errored").select(F.col(REASON).alias("reason"), F.col(STEP).alias("process"), F.lit(self.name).alias("pipeline"), event.alias("event"))

    def counters(self) -> DataFrame:
        return self.result().groupBy(F.col(OUTCOME).alias("outcome")).agg(F.count("*").alias("events"))
