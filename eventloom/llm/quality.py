"""Quality rules with suffix-array repetition.

Rules on counts (words, repeated 5-word windows) come first; then, for each text, a suffix array of its words and the longest
common prefixes of neighbouring suffixes. A suffix's longest prefix that occurs twice is the larger of its two LCPs; those not
contained in the one before are the maximal repeated substrings. Their union gives the covered words, the longest the longest
repeat. Both are limited. The array is built for a block of texts at once by prefix doubling in numpy; a text's suffixes never
meet another's, as its number is part of its first rank.

Results for special cases: a null or empty text has no words, counts of 0 and fails the base rules; very long texts are whole
(memory in proportion to the text: ranks of 32 bits for each doubling up to its longest repeat); ties don't arise; repeated rows are judged alike, row by row; an empty table gives an empty result; null
identifiers are passed on; other columns are passed over by `quality` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import given_back, text_batches

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The method's own limits, which bind below the base's: repeats of at least LONG_WORDS words may cover LONG_PERCENT of a text, and none may be
#: longer than MAX_LONGEST words or, in a long text, than LONGEST_PERCENT of it.
LONG_WORDS = 20
LONG_PERCENT = 8
MAX_LONGEST = 50
LONGEST_PERCENT = 1
SYMBOLS = b"#*$%&|<>"
BLOCK_WORDS = 300_000


def longest_repeats(codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on occur at another place of the same text too.

    codes: a number for each word; text_of: the text that each belongs to, ascending."""
    n = len(codes)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    end = np.append(np.flatnonzero(np.diff(text_of)) + 1, n)
    room = np.repeat(end, np.diff(end, prepend=0)) - np.arange(n)  # words from here to the text's end
    _, rank, count = np.unique(text_of * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[rank].astype(np.int32)  # a rank is the place in the array where its group of equal prefixes starts
    ranks, h, active = [rank], 1, np.arange(n)
    while True:
        # A suffix whose rank no other has is in its place; only the others are refined.
        active = active[np.bincount(rank, minlength=n)[rank[active]] > 1]
        if not len(active):
            break
        after = np.where(room[active] > h, rank[np.minimum(active + h, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active] * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        key, old, place = key[order], rank[active][order], np.arange(len(active))
        head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        rank = rank.copy()
        rank[active[order]] = (old + head - group).astype(np.int32)
        ranks.append(rank)
        h *= 2
    suffix = np.argsort(rank)
    a, b = suffix[:-1], suffix[1:]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        at, to, step = a + lcp, b + lcp, 1 << level
        fits = (room[a] - lcp >= step) & (room[b] - lcp >= step)
        equal = fits & (ranks[level][np.minimum(at, n - 1)] == ranks[level][np.minimum(to, n - 1)])
        lcp += equal * step
    lcp[text_of[a] != text_of[b]] = 0
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def covered(reach: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in the union of the repeats of at least `least` words."""
    at = np.flatnonzero(reach >= least)
    edge = np.bincount(at, minlength=len(reach) + 1) - np.bincount(at + reach[at], minlength=len(reach) + 1)
    return np.cumsum(edge[:-1]) > 0


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measured(texts: list[bytes]) -> list[np.ndarray]:
    """FIELDS, column by column, of a block of texts."""
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    codes = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    reach = longest_repeats(codes, owner)
    total = lambda mask: np.bincount(owner[mask], minlength=len(texts))
    repeat, long = total(covered(reach, WINDOW)), total(covered(reach, LONG_WORDS))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, reach)
    chars = np.array([sum(len(w.decode("utf-8", "replace")) for w in ws) if not t.isascii() else sum(map(len, ws)) for t, ws in zip(texts, split, strict=True)], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = np.array([dup_lines(t) for t in texts], np.int64)
    failed = (sizes < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * sizes)
    kept = ~failed & (100 * long <= LONG_PERCENT * sizes) & (100 * longest <= np.maximum(100 * MAX_LONGEST, LONGEST_PERCENT * sizes))
    return [sizes, chars, symbols, lines, repeat, longest, failed, kept]


def blocks(texts: pa.Array, limit: int = BLOCK_WORDS * 6) -> Iterator[list[bytes]]:
    """Runs of texts of so many bytes at least; a longer text is in one whole."""
    block, size = [], 0
    for t in texts:
        block.append(t.as_py() or b"")
        size += len(block[-1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in blocks(batch.column(batch.num_columns - 1).cast(pa.binary())):
            kept = [batch.column(i).slice(at, len(block)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, measured(block))], [*batch.schema.names[:-1], *(x.split()[0] for x in FIELDS.split(", "))])
            at += len(block)
    given_back()


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and FIELDS."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return text_batches(rows).mapInArrow(_judge, f"doc_id {dict(rows.dtypes)['doc_id']}, {FIELDS}")


def _select(text_at: int):
    def run(batches):
        for batch in batches:
            at = 0
            for block in blocks(batch.column(text_at).cast(pa.binary())):
                yield batch.slice(at, len(block)).filter(pa.array(measured(block)[-1]))
                at += len(block)
        given_back()

    return run


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; nothing is shuffled."""
    return text_batches(docs).mapInArrow(_select(docs.columns.index(text_col)), docs.schema)
