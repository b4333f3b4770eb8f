"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; each pair is verified once.

1. Shingles are ordered from rare to frequent by the number of documents that have them, counted over all documents. Texts are
   cut into blocks; a block's shingles are dealt out by ranges of their hash, so a shingle's count meets in one task. The number
   of ranges follows the bytes of text. What many sets of a block share goes once, with its count; equal sets of a block go once.
   Inside a range shingles are told by 32 bits; of the two that may coincide the counts are added, which keeps the order an order.
2. Shingles that no other document has come first and need no answer. Only the others come back to the block, where each set's
   first n - ceil(t n) + 1 shingles are its prefix. Linked sets share one of them; most sets have a prefix that nobody shares.
3. Documents with equal sets form a class, told by a 128-bit digest; only one of each goes on. Sets meet by prefix shingle.
4. In each meeting the most central set (the one where the shingle stands first) is the leader; every other set is paired with
   its most promising leader. Pairs pass the length, positional and suffix filters, are verified on whole sets and joined to
   components. So a group of near copies takes pairs in proportion to its size.
5. What is left: sets that meet, but are in different components still. Those outside a meeting's largest component are paired
   with the others of it; all filters are part of the join, so that no other pair is made. Nothing is capped: together with 4 this
   covers every pair that could link two components, so the components are exact.

The suffix filter bounds the overlap by sums over 32 classes of shingles of the smaller count, which is the partition bound of
the recursive filter, with all partitions looked at together.

Results for special cases: texts without words and null texts have no shingles and no links; rows with a null identifier get a
null component; rows that share an identifier are one document, linked if any of their texts is; very long texts are whole, each
in one block; repeated rows stay rows; ties of the order are broken by hash; an empty table gives an empty result; other columns
are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packing import pack, unpack
from .shared import WordHash, dealt, forget, given_back, saved, shingles, text_batches, text_bytes

PARTS = 32
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 50_000
#: Bytes of text for each range of shingles.
RANGE_BYTES = 8 << 20
#: A shingle that so many sets of a block have is common there.
COMMON = 16
#: Bits of the map of identifiers: eight for each, up to 32 MB as broadcast (beyond, it keeps fewer sets out of a shuffle).
ID_BITS = 15, 27

_hash = WordHash()


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for text in column.cast(pa.binary()):
        yield shingles(_hash.of((text.as_py() or b"").lower().split()), k)


def prefix_length(n, num: int, den: int):
    return n - -(-n * num // den) + 1


def _packed(block: int, ids: list, sets: list[np.ndarray], ranges: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A block's requests (a row for each range: cells and owners, common cells and their counts) and what waits for the answers."""
    n = np.array([len(h) for h in sets], np.int64)
    sig = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else b"" for h in sets]
    first: dict[bytes, int] = {}
    for i, s in enumerate(sig):
        j = first.setdefault(s, i)
        if ids[i] is not None and (ids[j] is None or ids[i] < ids[j]):
            first[s] = i
    own = np.sort(np.fromiter((i for s, i in first.items() if s), np.int64))
    sets = [sets[i] for i in own]
    h, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(own, n[own])
    every, at, count = np.unique(h, return_inverse=True, return_counts=True)
    place = ((every >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cell = (every & np.uint64(0xFFFFFFFF)).astype("<u4")
    rare = count[at] < COMMON
    order = np.argsort(place[at[rare]], kind="stable")
    r_at, r_owner = at[rare][order], owner[rare][order].astype("<u2")
    cut = np.searchsorted(place[r_at], np.arange(ranges + 1))
    common = np.flatnonzero(count >= COMMON)
    c_cut = np.searchsorted(place[common], np.arange(ranges + 1))
    c_owner = owner[~rare][np.argsort(at[~rare], kind="stable")].astype("<u2")
    some = np.flatnonzero(np.diff(cut) + np.diff(c_cut))
    part = np.bincount(owner * PARTS + (h & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS * len(n)).astype("<u4")
    void = [None] * len(some)
    return pa.RecordBatch.from_arrays([
        pa.array([*map(int, some), -1 - block], pa.int64()), pa.array([block] * (len(some) + 1), pa.int64()),
        pa.array([*(cell[r_at[cut[i] : cut[i + 1]]].tobytes() for i in some), pack(place[common] << 32 | cell[common])], pa.binary()), pa.array([*(pack(r_owner[cut[i] : cut[i + 1]]) for i in some), pack(c_owner)], pa.binary()),
        pa.array([*(cell[common[c_cut[i] : c_cut[i + 1]]].tobytes() for i in some), None], pa.binary()), pa.array([*(pack(count[common[c_cut[i] : c_cut[i + 1]]].astype("<u4")) for i in some), pack(count[common].astype("<u4"))], pa.binary()),
        pa.array([*void, ids], pa.list_(id_type)), pa.array([*void, pack(n)], pa.binary()), pa.array([*void, sig], pa.list_(pa.binary())), pa.array([*void, pack(part)], pa.binary()),
    ], ["key", "block", "cells", "owners", "common", "counts", "ids", "n", "sig", "parts"])


def _counted(table: pa.Table) -> pa.Table:
    """Answers of a range to each block: the cells that several sets have, with owners and counts; the counts of common cells."""
    rows = table.select(["key", "block", "cells", "owners", "common", "counts"]).to_pylist()
    if rows[0]["key"] < 0:
        return table
    cells = [np.frombuffer(r["cells"], "<u4") for r in rows]
    common = [np.frombuffer(r["common"], "<u4") for r in rows]
    weight = np.concatenate([*(np.ones(len(c)) for c in cells), *(unpack(r["counts"], "<u4") for r in rows)])
    _, at = np.unique(np.concatenate([*cells, *common]), return_inverse=True)
    count = np.bincount(at, weights=weight).clip(max=2**32 - 1).astype("<u4")[at]
    ends = np.cumsum([len(x) for x in (*cells, *common)])[:-1]
    count = np.split(count, ends)
    out = {"cells": [], "owners": [], "common": [], "counts": []}
    for r, c, n, m in zip(rows, cells, count, count[len(rows) :], strict=False):
        some = n > 1
        out["cells"].append(c[some].tobytes())
        out["owners"].append(pack(unpack(r["owners"], "<u2")[some]))
        out["counts"].append(pack(n[some]))
        out["common"].append(pack(m))
    for k, v in out.items():
        table = table.set_column(table.schema.get_field_index(k), k, pa.array(v, pa.binary()))
    return table


def _chosen(num: int, den: int):
    """id, n, sig of a block's documents, and the prefix (cells, rare first), places and class counts of those that share it."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_pylist()
        wait = key.index(min(key))
        w = {k: table.column(k)[wait].as_py() for k in ("cells", "owners", "counts", "n", "sig", "parts")}
        rows = sorted(table.select(["key", "cells", "owners", "common", "counts"]).filter(pa.array(np.array(key) >= 0)).to_pylist(), key=lambda r: r["key"])
        common, times = unpack(w["cells"], "<i8"), unpack(w["counts"], "<u4")
        c_count = np.concatenate([np.zeros(0, "<u4"), *(unpack(r["common"], "<u4") for r in rows)])
        cell = np.concatenate([*(np.frombuffer(r["cells"], "<u4").astype(np.int64) | r["key"] << 32 for r in rows), np.repeat(common, times)])
        owner = np.concatenate([*(unpack(r["owners"], "<u2") for r in rows), unpack(w["owners"], "<u2")]).astype(np.int64)
        count = np.concatenate([*(unpack(r["counts"], "<u4") for r in rows), np.repeat(c_count, times)])
        n = unpack(w["n"], "<i8")
        order = np.lexsort((cell, count, owner))
        cell, owner, count = cell[order], owner[order], count[order]
        shared = np.bincount(owner, minlength=len(n))
        rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
        new = np.append(True, (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1]))[: len(cell)]
        rank = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0)) - (np.arange(len(owner)) - rank) if len(owner) else rank
        pos = (n - shared)[owner] + rank
        some = pos < np.where(n > 0, prefix_length(n, num, den), 0)[owner]
        cell, pos, size = cell[some].astype("<i8"), pos[some].astype("<u4"), np.bincount(owner[some], minlength=len(n))
        ends = np.cumsum(size)
        piece = lambda x: pa.array([x[e - s : e].tobytes() if s else None for e, s in zip(ends, size, strict=True)], pa.binary())
        part = unpack(w["parts"], "<u4").astype(np.int32)[np.repeat(size > 0, PARTS)]
        offsets = pa.array([*np.where(size > 0, np.cumsum(size > 0) * PARTS - PARTS, 0), len(part)], pa.int32(), mask=np.append(size == 0, False))
        return pa.table({"id": table.column("ids")[wait].values, "n": n, "sig": pa.array([s or None for s in w["sig"]], pa.binary()), "prefix": piece(cell), "pos": piece(pos), "parts": pa.ListArray.from_arrays(offsets, pa.array(part))})

    return run


def prefixes(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, n, sig of each row; prefix, pos (of the shingles that others have) and parts (counts by class), of one row for each
    set and block, null where nobody shares the prefix."""
    kind = dict(rows.dtypes)["id"]
    ranges = 1 + text_bytes(rows) // RANGE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, size, id_type = TaskContext.get().partitionId() << 32, [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, h in zip(batch.column(0), _sets(batch.column(1), k), strict=True):
                ids.append(i.as_py())
                sets.append(h)
                size += len(h)
                if size >= BLOCK_SHINGLES or len(ids) >= BLOCK_DOCS:
                    yield _packed(block, ids, sets, ranges, id_type)
                    block, ids, sets, size = block + 1, [], [], 0
        if ids:
            yield _packed(block, ids, sets, ranges, id_type)
        given_back(_hash)

    schema = f"key long, block long, cells binary, owners binary, common binary, counts binary, ids array<{kind}>, n binary, sig array<binary>, parts binary"
    asked = text_batches(rows.select("id", "text")).mapInArrow(run, schema)
    answered = dealt(asked, ranges, "key").groupBy("key").applyInArrow(_counted, schema)
    return dealt(answered, ranges, "block").groupBy("block").applyInArrow(_chosen(num, den), f"id {kind}, n long, sig binary, prefix binary, pos binary, parts array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """h, rep, n, pos: a row for each shared prefix shingle of each class."""

    def run(batches):
        for batch in batches:
            got = [np.frombuffer(p.as_py(), "<i8") for p in batch.column(2)]
            who = np.repeat(np.arange(len(got)), [len(g) for g in got])
            if len(who):
                pos = np.concatenate([np.frombuffer(p.as_py(), "<u4") for p in batch.column(3)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(pos)], ["h", "rep", "n", "pos"])

    return classes.where("prefix is not null").select("rep", "n", "prefix", "pos").mapInArrow(run, f"h long, rep {dict(classes.dtypes)['rep']}, n long, pos long")


def may_link(n, pos, n2, pos2, num: int, den: int):
    """Length and positional filters."""
    need = F.ceil((n + n2) * num / F.lit(num + den) - 1e-9)
    return (F.least(n, n2) * den >= F.greatest(n, n2) * num) & (1 + F.least(n - pos - 1, n2 - pos2 - 1) >= need)


def overlap_bound(parts, parts2):
    """Suffix filter: sets share at most the smaller count of each class."""
    return F.aggregate(F.zip_with(parts, parts2, lambda p, q: F.least(p, q)), F.lit(0), lambda s, p: s + p)


def enough(shared, n, n2, num: int, den: int):
    """Whether sets that share so many link; the sum of both sides is what it is, so `shared` is looked at once."""
    return shared.cast("long") * (den + num) >= (n + n2) * num


def promising(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) that pass the suffix filter, with the bound."""
    x = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("parts").alias("parts_a"))
    y = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("parts").alias("parts_b"))
    both = pairs.join(x, "a").join(y, "b")
    return both.withColumn("bound", overlap_bound("parts_a", "parts_b")).where(enough(F.col("bound"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b", "bound")


def verified(pairs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Sets are made again from the texts that pairs name; a bit map, of a size that
    follows their number up to a bound, keeps others out of the shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    id_bits = max(ID_BITS[0], min(ID_BITS[1], (8 * ids.count()).bit_length()))
    cell = lambda c: F.shiftright(F.xxhash64(c), 64 - id_bits) + (1 << (id_bits - 1))
    ids = ids.select(cell("id").alias("cell"))
    words = ids.groupBy((F.shiftright("cell", 5)).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 31 as int)))").alias("bits")).toPandas()
    bits = np.zeros(1 << (id_bits - 5), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def sets(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            some = np.flatnonzero(known.value[at >> 5] >> (at & 31) & 1)
            batch = batch.take(pa.array(some))
            if len(some):
                found = list(_sets(batch.column(1), k))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate(found).view(np.int64))], ["id", "set"])
        given_back(_hash)

    all_sets = rows.where("id is not null").select("id", "text", cell("id").alias("cell")).mapInArrow(sets, f"id {dict(rows.dtypes)['id']}, set array<long>")
    one = all_sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = all_sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    sure = enough(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a").cast("long"), F.size("set_b"), num, den)
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(sure).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id. Two documents link when den * intersection >= num * union."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_sets = saved(prefixes(rows, k, num, den), "sets")
    classes = all_sets.where("n > 0 and id is not null").groupBy("sig").agg(F.min(F.struct("id", F.col("prefix").isNull().alias("void"), "n", "prefix", "pos", "parts")).alias("c"), F.count("*").alias("members"))
    classes = saved(classes.select("sig", F.col("c.id").alias("rep"), "c.n", "c.prefix", "c.pos", "c.parts", "members"), "classes")
    posts = postings(classes)
    # Only meetings of two sets at least.
    lead = posts.groupBy("h").agg(F.min(F.struct("pos", "n", "rep")).alias("l"), F.count("*").alias("sets")).where("sets > 1").select(F.col("h").alias("lh"), F.col("l.pos").alias("l_pos"), F.col("l.n").alias("l_n"), F.col("l.rep").alias("leader"), "sets")
    met = saved(posts.join(lead, F.col("h") == F.col("lh")).drop("lh"), "meetings")

    ordered = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = met.where(F.col("rep") != F.col("leader")).where(may_link(F.col("n"), F.col("pos"), F.col("l_n"), F.col("l_pos"), num, den))
    near = near.select(F.col("rep").alias("x"), F.col("leader").alias("y")).distinct()
    first = promising(near.select(F.col("x").alias("a"), F.col("y").alias("b")), classes, num, den)
    first = first.groupBy(F.col("a").alias("x")).agg(F.max_by("b", "bound").alias("y")).select(*ordered).distinct()
    first = saved(first, "pairs")
    links = saved(verified(first, rows, k, num, den), "links")
    part = components(links)

    labelled = met.select("h", "rep", "n", "pos").join(part, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    sizes = labelled.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"))
    mixed_ = sizes.where("labels > 1").select(F.col("h").alias("mh"), F.col("m.label").alias("main"))
    left = labelled.join(mixed_, F.col("h") == F.col("mh")).drop("mh")
    left = saved(left.join(classes.select(F.col("rep").alias("r"), "parts"), F.col("rep") == F.col("r")).drop("r"), "left")
    s = left.where("label <> main").select("h", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("label").alias("x_label"), F.col("parts").alias("x_parts"))
    o = left.withColumnRenamed("h", "oh")
    filters = may_link(F.col("n"), F.col("pos"), F.col("x_n"), F.col("x_pos"), num, den) & enough(overlap_bound("parts", "x_parts"), F.col("n"), F.col("x_n"), num, den)
    rest = s.join(o, (F.col("h") == F.col("oh")) & (F.col("x_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x") < F.col("rep"))) & filters)
    rest = saved(rest.select("x", F.col("rep").alias("y")).select(*ordered).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = saved(verified(rest, rows, k, num, den), "links")
    if not more.isEmpty():
        forget(part)
        part = components(links.unionByName(more))
    forget(met, first, links, left, rest, more)

    # Only classes that have more than one document or a link need to be looked up.
    found = classes.select("sig", "rep", "members").join(part, F.col("rep") == F.col("node"), "left").where("members > 1 or component <> rep")
    found = found.select("sig", F.coalesce("component", "rep").alias("component_id"))
    out = all_sets.select("id", "n", "sig").join(found, "sig", "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0) | F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, and who is in which class. Identifiers are taken to be unique here.

    links: a, b, n_links, a row for each pair of classes that link (a < b, their representatives; n_links = the documents' pairs
    between them) and for each class of several documents (a = b; its own pairs). The number of links is the sum of n_links.
    members: doc_id, rep of each document with shingles. Every pair that passes the filters is verified, once; large groups give
    as many rows as they have links between different sets."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_sets = saved(prefixes(rows, k, num, den).where("n > 0 and id is not null"), "sets")
    classes = all_sets.groupBy("sig").agg(F.min(F.struct("id", F.col("prefix").isNull().alias("void"), "n", "prefix", "pos", "parts")).alias("c"), F.count("*").alias("members"))
    classes = saved(classes.select("sig", F.col("c.id").alias("rep"), "c.n", "c.prefix", "c.pos", "c.parts", "members"), "classes")
    posts = postings(classes)
    x = posts.select("h", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    y = posts.select("h", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & may_link(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), num, den))
    pairs = saved(promising(pairs.select("a", "b").distinct(), classes, num, den).select("a", "b"), "pairs")
    weight = lambda rep: classes.select(F.col("rep").alias(rep), F.col("members").alias(f"members_{rep}"))
    between = verified(pairs, rows, k, num, den).join(weight("a"), "a").join(weight("b"), "b").select("a", "b", (F.col("members_a") * F.col("members_b")).alias("n_links"))
    within = classes.where("members > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.expr("members * (members - 1) div 2").alias("n_links"))
    members = all_sets.select(F.col("id").alias("doc_id"), "sig").join(classes.select("sig", "rep"), "sig").drop("sig")
    return between.unionByName(within), members


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest identifier; all columns are kept as they are."""
    gone = near_duplicates(docs, k, num, den, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone__")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone__"], "left_anti")
