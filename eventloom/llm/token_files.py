"""Token ids as Arrow files of fixed-size-list batches.

Documents are dealt out by ranges of their identifier and sorted, so that the files, in order, hold all ids in ascending order
of identifier. Each task writes its file: sequences of `length` ids (the stream of ids runs on from one sequence to the next;
the last is padded) and masks (false on padding) as FixedSizeList columns, so sequence i is found by its number alone and is
read without a copy from a memory map. Beside it stands an index: identifier, first place and number of ids of each document.
A file's name has the task's attempt; the manifest, which Spark writes once a task succeeded, names the files that count. So
lost or repeated attempts leave no trace in the result. The manifest has a row for each file and gives the files' offsets.

Ids are kept in the smallest unsigned type that the vocabulary needs (16 bits here).

Results for special cases: a null or empty text has the end id alone; a null identifier comes before all others; rows that
repeat an identifier follow each other, ordered by their texts' hash; very long texts run over as many sequences as they need;
an empty table gives no files and an empty result; other columns are passed over.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import n_shuffle, saved, shared_dir, text_batches

MANIFEST = "part int, path string, n_docs long, n_tokens long"
FLUSH = 512  # sequences in a batch


class WordIds(dict):
    """Ids, as bytes, of white-space-separated words, as the tokenizers library gives them; kept for words seen lately.

    The tokenizer drops white space and no rule of it reaches over it, so a text's ids are its words' ids one after another."""

    #: Words in each of two generations: the older one goes when the younger is full, so that frequent words stay.
    #: What is kept: so many words; those of more bytes than LONGEST only while their texts are encoded.
    LIMIT, LONGEST = 250_000, 64
    #: Marks that end a word and are cut off behind a letter or digit.
    MARKS = b".,;:!?$#*%&()\""

    def __init__(self, path: str):
        # Spark's tasks are the parallel units; a pool of threads in each would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding(), self.model.no_truncation()
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")

    def pieces(self, text: str) -> list[bytes]:
        """Parts that are encoded apart. The tokenizer makes letters small, so A-Z may be made small before, if no special token
        can come of it; and it always cuts between a letter (of Latin-1) or digit and a mark of MARKS."""
        data = text.encode()
        out, marks = [], self.MARKS
        for w in data.split() if b"<|" in data else data.lower().split():
            stem = w.rstrip(marks)
            if len(stem) < len(w) and (stem[-1:].isalnum() or (stem[-2:-1] == b"\xc3" and stem[-1] not in b"\x97\xb7")):
                out += (stem, w[len(stem) :])
            else:
                out.append(w)
        return out

    def learn(self, words: set[bytes]) -> None:
        """Encodes words that aren't known, many in one call; afterwards self has all of them."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.LIMIT:
            self.old = dict(self)
            self.clear()
            new = list(words)
        old, unknown = self.old, []
        for w in new:
            ids = old.get(w)
            if ids is None:
                unknown.append(w)
            else:
                self[w] = ids
        size = self.dtype.itemsize
        self.long += [w for w in unknown if len(w) > self.LONGEST]
        for i in range(0, len(unknown), 2000):
            part = unknown[i : i + 2000]
            e = self.model.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            owner, data = np.array(e.word_ids, np.int64), np.array(e.ids, self.dtype).tobytes()
            cut = (np.searchsorted(owner, np.arange(len(part) + 1)) * size).tolist()
            for k, w in enumerate(part):
                self[w] = data[cut[k] : cut[k + 1]]

    def of_batch(self, texts: pa.Array) -> Iterator[bytes]:
        for i in range(0, len(texts), 500):
            split = [self.pieces(t.as_py() or "") for t in texts.slice(i, 500)]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.__getitem__, words))
            for w in self.long:
                self.pop(w, None)
            self.long = []


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class SequenceFile:
    """Writes a stream of ids as fixed-size sequences and masks."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        self.length, self.dtype, self.rest, self.count = length, dtype, [], 0
        where, name = _open(path)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length)})
        self.sink = where.open_output_stream(name)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.count += len(ids)
        if self.count >= FLUSH * self.length * self.dtype.itemsize:
            self.flush()

    def flush(self, end: bool = False) -> None:
        """Writes batches of FLUSH sequences each, so that a place's batch is found by division; at the end also what is left."""
        ids, size = np.frombuffer(b"".join(self.rest), self.dtype), FLUSH * self.length
        whole = len(ids) // size * size
        for at in range(0, len(ids) if end else whole, size):
            part = ids[at : at + size]
            n = len(part)
            part = np.pad(part, (0, -n % self.length))
            values, mask = pa.array(part), pa.array(np.arange(len(part)) < n)
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)], schema=self.schema))
        self.rest = [] if end else [ids[whole:].tobytes()]
        self.count = sum(map(len, self.rest))

    def close(self) -> None:
        self.flush(end=True)
        self.file.close()
        self.sink.close()


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; their manifest: MANIFEST."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    n = n_shuffle(docs.sparkSession)
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        ids, out, index, at, docs = word_ids(tokenizer), None, None, 0, 0
        end = b"" if end_id is None else np.array([end_id], ids.dtype).tobytes()
        for batch in batches:
            if out is None:
                where, name = _open(folder)
                where.create_dir(name, recursive=True)
                out = SequenceFile(f"{path}.arrow", ids.dtype, length)
                where, name = _open(f"{path}.index.arrow")
                sink = where.open_output_stream(name)
                schema = pa.schema([("doc_id", batch.schema.field(0).type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sink, schema)
            sizes = []
            for got in ids.of_batch(batch.column(1)):
                got += end
                out.add(got)
                sizes.append(len(got) // ids.dtype.itemsize)
            offsets = list(itertools.accumulate(sizes, initial=at))
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            at, docs = offsets[-1], docs + len(sizes)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": path, "n_docs": docs, "n_tokens": at}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return saved(text_batches(rows).mapInArrow(run, MANIFEST), "manifest")


class Sequences:
    """Random access to a file of sequences: a memory map where the file is local."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.source = pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._last: tuple[int, np.ndarray | None] = (-1, None)

    def flat(self, i: int) -> np.ndarray:
        """All ids of batch i, a view of the file where it is mapped."""
        if self._last[0] != i:
            self._last = (i, self.file.get_batch(i).column(0).values.to_numpy())
        return self._last[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence i."""
        b, row = divmod(i, self.per_batch)
        mask = self.file.get_batch(b).column(1).values.slice(row * self.length, self.length)
        return self.flat(b)[row * self.length : (row + 1) * self.length], mask.to_numpy(zero_copy_only=False)

    def ids(self, offset: int, n: int) -> np.ndarray:
        """n ids from a place of the file's stream on."""
        size, got = self.per_batch * self.length, []
        while n > 0:
            part = self.flat(offset // size)[offset % size : offset % size + n]
            if not len(part):
                raise EOFError(f"the file ends {n} ids early")
            got.append(part)
            offset, n = offset + len(part), n - len(part)
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.empty(0, np.uint16)


def offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids in all files before: a row for each file, as many as the writing job had tasks."""
    spark, base, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").toLocalIterator():
        rows.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(rows, MANIFEST + ", base long").repartition(max(1, len(rows)), "part")


def read(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of 32-bit ids) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = Sequences(f"{row['path']}.arrow")
                where, name = _open(f"{row['path']}.index.arrow")
                with where.open_input_file(name) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        at, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [zlib.crc32(data.ids(a, k).astype("<u4")) for a, k in zip(at, n, strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + row["base"]), docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return offsets(manifest).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs under a new folder of the shared one and reads the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, tokenizer, folder, end_id, length, id_col, text_col), dict(docs.dtypes)[id_col])
