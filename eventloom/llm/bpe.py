"""BPE encoding and decoding by dynamic programming over prefixes.

A text's encoding is unique, and so is the encoding of each of its prefixes. For every prefix of a piece, the vocabulary
entries that end there (all suffix matches, from an automaton over the vocabulary) are tried: the last token of the prefix is
the one that is compatible with the last token of what stands before it. Two tokens are compatible if merging in order of rank
never joins across their border. Back-pointers from the last prefix give the ids. No merge is ever carried out.

Results for special cases: a null text counts as empty (no ids, digests of the empty string); texts are whole however long;
repeated rows and null identifiers are encoded row by row; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import given_back, text_batches

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space as the tokenizer has it (without the separators 1C to 1F), and its rule for pieces. Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE file. Tokens are numbered inside by rank: bytes 0 to 255, then merges."""

    #: What is kept: pieces of so many characters at most, so that the memory is bounded too.
    PIECES, PAIRS, LONGEST = 100_000, 300_000, 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = lambda t: bytes(map(alphabet.__getitem__, t))
        self.text = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.text)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.join: dict[tuple[int, int], int] = {}
        self.ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = number[as_bytes(a)], number[as_bytes(b)]
            whole = self.text[x] + self.text[y]
            if whole in number:  # another way to a known token
                self.join.setdefault((x, y), number[whole])
                continue
            number[whole] = self.join[x, y] = n = len(self.text)
            self.text.append(whole)
            self.parts.append((x, y))
            self.ids.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.by_id = {i: t for i, t in zip(self.ids, self.text, strict=True)} | {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.piece = regex.compile(PIECE)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[bytes, int, bytes]] = {}
        self.ends = ahocorasick.Automaton()
        for n, t in enumerate(self.text):
            if n < 256 or self.compatible(*self.parts[n], below=n):  # else no text has it
                self.ends.add_word(t.decode("latin-1"), (n, len(t)))
        self.ends.make_automaton()

    def compatible(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether merging leaves a and b side by side (up to merges of rank `below`): the merges that made them are undone from
        the last on; at none of these times may the two tokens at the border have a merge that comes before the next one."""
        while True:
            if self.join.get((a, b), below) < below:
                return False
            at, bt = self.parts[a], self.parts[b]
            if a > b or b < 256:
                if a < 256:
                    return True
                below, a = a, at[1]
            else:  # of equal merges the left one is first
                below, b = b + 1, bt[0]

    def tokens(self, text: bytes) -> list[int]:
        """Inner numbers of the tokens of a piece."""
        last: list = [None] * len(text)
        pairs = self.pairs
        for end, (t, size) in self.ends.iter(text.decode("latin-1")):
            if last[end] is not None:
                continue
            if size > end:
                last[end] = t, size
                continue
            before = last[end - size]
            if before is None:
                continue
            key = before[0] << 32 | t
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) >= self.PAIRS:
                    pairs.clear()
                fits = pairs[key] = self.compatible(before[0], t)
            if fits:
                last[end] = t, size
        out, at = [], len(text) - 1
        while at >= 0:
            t, size = last[at]
            out.append(t)
            at -= size
        return out[::-1]

    def _piece(self, piece: str) -> tuple[bytes, int, bytes]:
        if len(self.pieces) >= self.PIECES:
            self.pieces.clear()
        ids = [self.ids[t] for t in self.tokens(piece.encode())]
        out = (",".join(map(str, ids)).encode(), len(ids), b"".join(map(self.by_id.__getitem__, ids)))
        if len(piece) <= self.LONGEST:
            self.pieces[piece] = out
        return out

    def encoded(self, text: str) -> list[tuple[bytes, int, bytes]]:
        """For each piece: its ids in decimal, comma-joined; their number; the bytes that they decode to."""
        known, out = self.pieces, []
        for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if k % 2:
                out.append((str(self.special[part]).encode(), 1, self.by_id[self.special[part]]))
            else:
                out += [known.get(p) or self._piece(p) for p in self.piece.findall(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.encoded(text) for i in p[0].split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each file and worker: reused workers keep its tables."""
    return Codec(path)


def digests(c: Codec, text: str | None) -> tuple[int, str, str]:
    parts = c.encoded(text or "")
    decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()
    return sum([p[1] for p in parts]), hashlib.sha256(b",".join([p[0] for p in parts])).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id and FIELDS; with `ids`, also the ids and the decoded text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    more = ", ids array<int>, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            found = [digests(c, t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]
            if ids:
                all_ids = [c.encode(t.as_py() or "") for t in batch.column(1)]
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(map(c.decode, all_ids), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(x.split()[0] for x in (FIELDS + more).split(", "))])
        given_back()

    return text_batches(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {FIELDS}{more}")
