"""Payloads sent to an HTTP server, in batches, by the tasks that have them."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def post(shipped: DataFrame, url: str, batch: int = 1, method: str = "POST", content_type: str = "application/json", headers: dict[str, str] | None = None, compress: bool = False, attempts: int = 5, wait: float = 1.0, longest: float = 60.0, column: str = "payload") -> DataFrame:
    """A row for each batch sent: rows, status (null if no answer came), error (null if all went well; else 200 characters of the
    answer), attempts. Payloads of a batch are joined by line feeds; null ones are left out. A batch that fails is sent again, each
    time after twice the wait, up to `attempts` times. Sending happens when the result is read, and again if a task is run again,
    so a batch arrives at least once."""

    def send(lines: list[str]) -> dict:
        body = "\n".join(lines).encode()
        more = {"Content-Type": content_type} | (headers or {}) | ({"Content-Encoding": "gzip"} if compress else {})
        status, error, tries = None, None, 0
        while tries < attempts:
            tries += 1
            try:
                with urllib.request.urlopen(urllib.request.Request(url, gzip.compress(body) if compress else body, more, method=method), timeout=30) as answer:
                    status, error = answer.status, None
                    break
            except urllib.error.HTTPError as e:
                status, error = e.code, e.read().decode("utf-8", "replace")[:200]
            except OSError as e:
                status, error = None, str(e)[:200]
            if tries < attempts:
                time.sleep(min(longest, wait * 2 ** (tries - 1)))
        return {"rows": len(lines), "status": status, "error": error, "attempts": tries}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rest = pa.schema([("rows", pa.int64()), ("status", pa.int32()), ("error", pa.string()), ("attempts", pa.int32())]), []
        for b in batches:
            rest += [x for x in b.column(0).to_pylist() if x is not None]
            while len(rest) >= batch:
                yield pa.RecordBatch.from_pylist([send(rest[:batch])], schema)
                rest = rest[batch:]
        if rest:
            yield pa.RecordBatch.from_pylist([send(rest)], schema)

    return shipped.select(column).mapInArrow(run, "rows long, status int, error string, attempts int")
