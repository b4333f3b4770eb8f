"""LM scoring: a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants: one for each word that stands before (or the text's start), sharing one parent restaurant of single words, whose
base is uniform over the training vocabulary and one unseen word. Each table of a word's restaurant sends one customer to the
parent. A Gibbs step unseats all customers of a dish in a restaurant and draws their number of tables from its conditional given
all other seats: generalized Stirling numbers (they sum over the seatings) times (theta + d T)(theta + d (T + 1)).. p(parent)^t.
A dish that stands once takes one table and needs no drawing. Dishes of all restaurants are drawn in a few random groups, and the
restaurants' totals follow after each. Dishes of more than EXACT customers are seated one after another instead, in runs of
n / 32 under one probability. Predictive probabilities are averaged over the samples kept.

Distribution: texts are cut into blocks; a block's distinct (word before, word) entries with their training counts are dealt out by
ranges of the word before, so a restaurant's seats and totals are in one task, whatever the number of blocks: a frequent word
comes as counts of distinct followers, never as its tokens. The number of parts follows the bytes of text. Only the parent needs
an exchange: after each round, customers are summed by ranges of words, the parent is seated, and its customers and tables go back
to the parts that have the word. The last samples are drawn under one parent, so probabilities sum to one. Answers go back by
block, where the tokens wait as positions in the block's entries. All counts come from all training documents; texts are read
once. Words are told by 64 bits of hash, so counts are exact but for collisions.

Results for special cases: a null or empty text has one token, the end; a null identifier counts as the empty text for the
held-out rule; repeated rows are scored (and, in training, counted) each; ties don't arise; a very long text is whole in one block;
without training tokens every score is that of the uniform base; an empty table gives an empty result; other columns are passed
over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, pack_up, unpack, unpack_up
from .shared import WordHash, dealt, forget, given_back, saved, text_batches, text_bytes

BLOCK_TOKENS = 2_000_000
#: Bytes of text for each part of the restaurants and each range of words.
PART_BYTES = 16 << 20
END = b" "
THETA = 1.0
BURN_IN, SAMPLES, ROUNDS = 2, 4, 2
#: Customers of a dish up to which the number of tables is drawn exactly; groups that dishes are drawn in.
EXACT, GROUPS = 64, 4

_words = WordHash()


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def place(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of hashes each is in."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def discount(one: float, two: float) -> float:
    """From how many dishes have one customer and two."""
    return float(min(0.95, max(0.05, one / max(1, one + 2 * two))))


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each part that a block has entries in (words, ctxs, codes, n) and one for its tokens (key < 0: ids, sizes, held,
    entries), in one pass."""
    kind = dict(rows.dtypes)["id"]

    def packed(block: int, ids: list, tokens: list, id_type) -> pa.RecordBatch:
        held, sizes = np.array([held_out(i) for i in ids]), np.array([len(t) for t in tokens], np.int64)
        every, word = np.unique(np.concatenate(tokens), return_inverse=True)
        before = np.append(0, word[:-1])
        before[np.cumsum(sizes) - sizes] = word[-1]  # the end stands before the start
        code, entry = np.unique(before * len(every) + word, return_inverse=True)
        n = np.bincount(entry, weights=np.repeat(~held, sizes), minlength=len(code)).astype("<u4")
        ctx, word = np.divmod(code, len(every))
        cut = np.searchsorted(place(every, parts)[ctx], np.arange(parts + 1))
        some, out = np.flatnonzero(np.diff(cut)), []
        for a, b in zip(cut[some], cut[some + 1], strict=True):
            c, c_at = np.unique(ctx[a:b], return_inverse=True)
            w, w_at = np.unique(word[a:b], return_inverse=True)
            out.append((pack_up(every[w]), pack_up(every[c]), pack_up(c_at * len(w) + w_at), pack(n[a:b])))
        # Only a text's sum counts, so its tokens' entries may ascend.
        entry = np.sort(np.repeat(np.arange(len(sizes)), sizes) * len(code) + entry)
        void = [None] * len(some)
        return pa.RecordBatch.from_arrays([
            pa.array([*map(int, some), -1 - block], pa.int64()), pa.array([block] * (len(some) + 1), pa.int64()), *(pa.array([*(x[i] for x in out), None], pa.binary()) for i in range(4)),
            pa.array([*void, ids], pa.list_(id_type)), pa.array([*void, pack(sizes)], pa.binary()), pa.array([*void, pack(held.astype("u1"))], pa.binary()), pa.array([*void, pack_up(entry)], pa.binary()),
        ], ["key", "block", "words", "ctxs", "codes", "n", "ids", "sizes", "held", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, tokens, size, id_type = TaskContext.get().partitionId() << 32, [], [], 0, None
        end = np.array([_words[END]], np.uint64)
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                tokens.append(np.concatenate((_words.of((text.as_py() or b"").lower().split()), end)))
                size += len(tokens[-1])
                if size >= BLOCK_TOKENS:
                    yield packed(block, ids, tokens, id_type)
                    block, ids, tokens, size = block + 1, [], [], 0
        if ids:
            yield packed(block, ids, tokens, id_type)
        given_back(_words)

    return text_batches(rows.select("id", "text")).mapInArrow(run, f"key long, block long, words binary, ctxs binary, codes binary, n binary, ids array<{kind}>, sizes binary, held binary, entries binary")


def stirling(size: int, d: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers of n customers (rows) at t tables (columns), n and t up to size."""
    s = np.full((size + 1, size + 1), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(size):
            t = np.arange(1, n + 2)
            s[n + 1, 1 : n + 2] = np.logaddexp(s[n, t - 1], s[n, t] + np.log(np.maximum(n - d * t, 0)))
    return s


def seated(n: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of n customers of a dish who enter one after another; others: the restaurant's tables of other dishes."""
    t = (n > 0).astype(np.int64)
    at, left = t.copy(), np.flatnonzero(n > 1)
    while len(left):
        now, tables, run = at[left], t[left], np.minimum(n[left] - at[left], np.maximum(1, at[left] // 32))
        a = (THETA + d * (others[left] + tables)) * p[left]
        t[left] += rng.binomial(run, np.minimum(1.0, a / (a + now - d * tables)))
        at[left] += run
        left = left[at[left] < n[left]]
    return t


def drawn(n: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of n customers of a dish, drawn from the conditional given all other seats; p: the parent's probability of the dish."""
    t, table = np.zeros(len(n), np.int64), stirling(EXACT, d)
    size = np.minimum(n, EXACT + 1)
    order = np.argsort(size, kind="stable")
    cut = np.searchsorted(size[order], np.arange(EXACT + 2))
    for k in range(1, EXACT + 1):
        for at in np.array_split(order[cut[k] : cut[k + 1]], 1 + (cut[k + 1] - cut[k]) * k // 1_000_000):
            more = np.log((THETA + d * (others[at, None] + np.arange(1, k))) * p[at, None])
            weight = table[k, 1 : k + 1] + np.pad(np.cumsum(more, axis=1), ((0, 0), (1, 0)))
            t[at] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1) if len(at) else 0
    at = order[cut[EXACT + 1] :]
    t[at] = seated(n[at], others[at], p[at], d, rng)
    return t


class Seats:
    """A part's restaurants: entries (ctx, word) with n customers at t tables."""

    def __init__(self, code: np.ndarray, n: np.ndarray, words: int, ctxs: int, t: np.ndarray | None = None):
        ctx, word = np.divmod(code, max(1, words))
        many = n > 1
        self.many, self.ctx, self.word, self.n = np.flatnonzero(many), ctx[many], word[many], n[many].astype(np.int64)
        self.singles = np.bincount(word[~many], minlength=words)
        self.customers = np.bincount(ctx, weights=n, minlength=ctxs)
        self.t = np.ones(len(self.n), np.int64) if t is None else t
        self.tables = np.bincount(ctx[~many], minlength=ctxs) + np.bincount(self.ctx, weights=self.t, minlength=ctxs).astype(np.int64)

    def sweep(self, parent: np.ndarray, d: float, rng: np.random.Generator) -> None:
        group = rng.integers(GROUPS, size=len(self.n))
        for g in range(GROUPS):
            at = np.flatnonzero(group == g)
            ctx, old = self.ctx[at], self.t[at]
            self.t[at] = drawn(self.n[at], self.tables[ctx] - old, parent[self.word[at]], d, rng)
            np.add.at(self.tables, ctx, self.t[at] - old)

    def sent(self) -> np.ndarray:
        """Customers that the tables send to the parent, by word."""
        return self.singles + np.bincount(self.word, weights=self.t, minlength=len(self.singles)).astype(np.int64)


#: kind: docs (a block's tokens), asked (a block's entries, as places in the part's lists), state (a part's entries), words (a part's
#: words of a range, with customers sent to the parent and tokens), tables (a part's seats).
KINDS = "kind string, part int, block long, range int, a binary, b binary, c binary, stats array<long>"
_FIELDS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _by_range(words: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    cut = np.searchsorted(place(words, ranges), np.arange(ranges + 1))
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]


def _opened(ranges: int, id_type: pa.DataType):
    """From the blocks' entries of a part: its state after the first sweeps, its words, and what the blocks ask for."""
    schema = _FIELDS
    for name, kind in (("ids", pa.list_(id_type)), ("sizes", pa.binary()), ("held", pa.binary()), ("entries", pa.binary())):
        schema = schema.append(pa.field(name, kind))

    def run(table: pa.Table) -> pa.Table:
        if table.column("key")[0].as_py() < 0:
            own = {"kind": pa.array(["docs"]), "block": table.column("block"), **{k: table.column(k) for k in ("ids", "sizes", "held", "entries")}}
            return pa.table([own.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
        part, rows = table.column("key")[0].as_py(), table.select(["block", "words", "ctxs", "codes", "n"]).to_pylist()
        w, c, codes = ([unpack_up(r[k]) for r in rows] for k in ("words", "ctxs", "codes"))
        n = np.concatenate([unpack(r["n"], "<u4") for r in rows])
        words, w_at = np.unique(np.concatenate(w), return_inverse=True)
        ctxs, c_at = np.unique(np.concatenate(c), return_inverse=True)
        w_at, c_at = np.split(w_at, np.cumsum([len(x) for x in w])[:-1]), np.split(c_at, np.cumsum([len(x) for x in c])[:-1])
        code = np.concatenate([cs[k // len(ws)] * len(words) + ws[k % len(ws)] for k, ws, cs in zip((k.astype(np.int64) for k in codes), w_at, c_at, strict=True)])
        code, at = np.unique(code[n > 0], return_inverse=True)
        n = np.bincount(at, weights=n[n > 0], minlength=len(code)).astype("<i8")
        seats = Seats(code, n, len(words), len(ctxs))
        tokens = np.bincount(code % len(words), weights=n, minlength=len(words)).astype("<i8")
        one, two = int((n == 1).sum()), int((n == 2).sum())
        # Before any exchange, the part's own tokens stand for the parent: restaurants are dealt out by hash.
        guess, rng = (tokens + 0.5) / (tokens.sum() + 0.5 * (len(words) + 1)), np.random.default_rng([0, part])
        for _ in range(BURN_IN):
            seats.sweep(guess, discount(one, two), rng)
        sent = seats.sent().astype("<i8")
        out = [{"kind": "state", "part": part, "a": pack_up(code), "b": pack(n), "stats": [len(words), len(ctxs), int(n.sum()), one, two]}, {"kind": "tables", "part": part, "a": pack(seats.t.astype("<i8"))}]
        out += [{"kind": "words", "part": part, "range": i, "a": pack_up(words[s]), "b": pack(sent[s]), "c": pack(tokens[s])} for i, s in _by_range(words, ranges)]
        out += [{"kind": "asked", "part": part, "block": r["block"], "a": pack_up(ws), "b": pack_up(cs), "c": r["codes"]} for r, ws, cs in zip(rows, w_at, c_at, strict=True)]
        return pa.Table.from_pylist(out, schema)

    return run


PARENT = "part int, range int, m binary, s binary, c binary, stats array<long>"


def _parent(world: dict | None, ranges: int, number: int):
    """Seats the parent's dishes of a range; answers each part with customers, tables and tokens of its words."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["part", "range", "a", "b", "c"]).to_pylist()
        lists = {r["part"]: r for r in rows if r["a"] is not None}
        sent = {r["part"]: unpack(r["b"], "<i8") for r in rows if r["b"] is not None}
        words, at = np.unique(np.concatenate([unpack_up(r["a"]) for r in lists.values()]), return_inverse=True)
        total = lambda x: np.bincount(at, weights=np.concatenate(x), minlength=len(words)).astype("<i8")
        m, c = total([sent[p] for p in lists]), total([unpack(r["c"], "<i8") for r in lists.values()])
        one, two, known = int((m == 1).sum()), int((m == 2).sum()), int((m > 0).sum())
        # Before the first sums are known, this range stands for all.
        d, v, tables = (world["d0"], world["V"], world["S"]) if world else (discount(one, two), known * ranges, known * ranges)
        s, rng = (m > 0).astype("<i8"), np.random.default_rng([1, number, rows[0]["range"]])
        for _ in range(BURN_IN):
            s = drawn(m, np.maximum(0, tables - s), np.full(len(m), 1.0 / (v + 1)), d, rng)
        cuts = np.split(at, np.cumsum([len(unpack_up(r["a"])) for r in lists.values()])[:-1])
        out = [{"part": p, "range": r["range"], "m": pack(m[i]), "s": pack(s[i]), "c": pack(c[i])} for (p, r), i in zip(lists.items(), cuts, strict=True)]
        out.append({"range": rows[0]["range"], "stats": [int(m.sum()), int(s.sum()), known, one, two]})
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("range", pa.int32()), ("m", pa.binary()), ("s", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64()))]))

    return run


def _sums(table: DataFrame, size: int) -> list[int]:
    got = table.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).first()
    return [int(x or 0) for x in got]


class Part:
    """A part's restaurants under the parent, from its rows of state, tables and parent."""

    def __init__(self, table: pa.Table, world: dict):
        rows = table.to_pylist()
        state = next(r for r in rows if r["kind"] == "state")
        t = next(unpack(r["a"], "<i8") for r in rows if r["kind"] == "tables")
        parent = sorted((r for r in rows if r["kind"] is None), key=lambda r: r["range"])
        self.world, self.part, self.code, self.n = world, state["part"], unpack_up(state["a"]).astype(np.int64), unpack(state["b"], "<i8")
        self.ranges = [r["range"] for r in parent]
        m, s, self.tokens = (np.concatenate([unpack(r[k], "<i8") for r in parent]) for k in ("m", "s", "c"))
        self.ends = np.cumsum([len(unpack(r["m"], "<i8")) for r in parent])
        self.parent = (m - world["d0"] * s + world["back"]) / (THETA + world["M"])
        self.words, self.ctxs = state["stats"][:2]
        self.seats = Seats(self.code, self.n, self.words, self.ctxs, t.astype(np.int64).copy())
        self.rng = np.random.default_rng([2, world["number"], self.part])

    def sweep(self) -> None:
        self.seats.sweep(self.parent, self.world["d1"], self.rng)

    def averaged(self) -> None:
        """Tables of entries and restaurants, averaged over the samples: probabilities are linear in them."""
        t, tables = np.zeros(len(self.seats.t)), np.zeros(self.ctxs)
        for i in range(BURN_IN + SAMPLES):
            self.sweep()
            if i >= BURN_IN:
                t, tables = t + self.seats.t / SAMPLES, tables + self.seats.tables / SAMPLES
        self.t = np.ones(len(self.n))
        self.t[self.seats.many] = t
        self.tables = tables

    def predicted(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Averaged probability of each word behind each context (places in the part's lists)."""
        d, code = self.world["d1"], ctx * self.words + word
        room = THETA + self.seats.customers[ctx]
        own = np.zeros(len(code))
        if len(self.code):
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            own = np.where(self.code[at] == code, self.n[at] - d * self.t[at], 0.0)
        return (own + (THETA + d * self.tables[ctx]) * self.parent[word]) / room


def _swept(world: dict):
    """A round of a part: its tables, and what they send to the parent."""

    def run(table: pa.Table) -> pa.Table:
        p = Part(table, world)
        for _ in range(BURN_IN):
            p.sweep()
        sent = np.split(p.seats.sent().astype("<i8"), p.ends[:-1])
        out = [{"kind": "tables", "part": p.part, "a": pack(p.seats.t.astype("<i8"))}, *({"kind": "words", "part": p.part, "range": r, "b": pack(x)} for r, x in zip(p.ranges, sent, strict=True))]
        return pa.Table.from_pylist(out, _FIELDS)

    return run


def _answers(world: dict):
    """For each block's entries of a part: log10 probability, and training count of the word."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        p = Part(state, world)
        p.averaged()
        out = {"block": [], "part": [], "lp": [], "c": []}
        for row in asked.to_pylist():
            w, c, code = (unpack_up(row[k]).astype(np.int64) for k in ("word_at", "ctx_at", "codes"))
            ctx, word = c[code // len(w)], w[code % len(w)]
            for k, v in zip(out, (row["block"], p.part, pack(np.log10(p.predicted(ctx, word)).astype("<f4")), pack(p.tokens[word])), strict=True):
                out[k].append(v)
        return pa.table(out, pa.schema([("block", pa.int64()), ("part", pa.int32()), ("lp", pa.binary()), ("c", pa.binary())]))

    return run


def _scores(world: dict):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part").to_pylist()
        lp = np.concatenate([unpack(a["lp"], "<f4") for a in answers]).astype(float)
        c = np.concatenate([unpack(a["c"], "<i8") for a in answers])
        base = np.log10((c + 0.5) / (world["N"] + 0.5 * (world["V"] + 1)))
        row = docs.combine_chunks()
        sizes, held = (unpack(row.column(k)[0].as_py(), t) for k, t in (("sizes", "<i8"), ("held", "u1")))
        entry = (unpack_up(row.column("entries")[0].as_py()) % np.uint64(len(lp))).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x[entry], start)
        return pa.table({"doc_id": row.column("ids")[0].values, "held_out": pa.array(held > 0), "n_tokens": pa.array(sizes), "n_known": pa.array(total((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(sizes), world["N"])), "base_score": pa.array(total(base)), "score": pa.array(total(lp))})

    return run


def trained(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """What waits (docs, asked), each part's rows (state, tables, parent) and sums over all parts."""
    kind = dict(rows.dtypes)["id"]
    parts = 1 + text_bytes(rows) // PART_BYTES
    id_type = pa.schema(rows.select("id").limit(0).toArrow().schema).field(0).type
    opened = dealt(blocks(rows, parts), parts, "key").groupBy("key").applyInArrow(_opened(parts, id_type), f"{KINDS}, ids array<{kind}>, sizes binary, held binary, entries binary")
    table = saved(opened, "opened", by="kind")
    of = lambda kind: table.where(F.col("kind") == kind)
    state = of("state").select("kind", "part", "a", "b", "stats")
    n, one, two = _sums(state.select(F.slice("stats", 3, 3).alias("stats")), 3)
    world = {"N": n, "d1": discount(one, two), "number": 0}
    tables, sent, swept = of("tables").select("kind", "part", "a"), of("words").select("part", "range", "a", "b", "c"), None
    for number in range(ROUNDS):
        parent = saved(dealt(sent, parts, "range").groupBy("range").applyInArrow(_parent(dict(world) if number else None, parts, number), PARENT), "parent")
        m, s, v, one, two = _sums(parent.where("stats is not null"), 5)
        d = discount(one, two)
        world |= {"M": m, "S": s, "V": v, "d0": d, "back": (THETA + d * s) / (v + 1), "number": number + 1}
        mine = state.unionByName(tables, allowMissingColumns=True).unionByName(parent.where("part is not null").drop("stats"), allowMissingColumns=True)
        if number + 1 < ROUNDS:
            last, swept = swept, saved(dealt(mine, parts, "part").groupBy("part").applyInArrow(_swept(dict(world)), KINDS), "swept")
            forget(parent, *filter(None, [last]))
            tables = swept.where("kind = 'tables'").select("kind", "part", "a")
            sent = of("words").select("part", "range", "a", "c").unionByName(swept.where("kind = 'words'").select("part", "range", "b"), allowMissingColumns=True)
    return table, mine, world | {"parts": parts}


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table, mine, world = trained(rows)
    asked = table.where("kind = 'asked'").select(F.col("part").alias("of"), "block", F.col("a").alias("word_at"), F.col("b").alias("ctx_at"), F.col("c").alias("codes"))
    parts = world["parts"]
    answers = dealt(asked, parts, "of").groupBy("of").cogroup(dealt(mine, parts, "part").groupBy("part")).applyInArrow(_answers(world), "block long, part int, lp binary, c binary")
    waiting = table.where("kind = 'docs'").select("block", "ids", "sizes", "held", "entries")
    return dealt(waiting, parts, "block").groupBy("block").cogroup(dealt(answers, parts, "block").groupBy("block")).applyInArrow(_scores(world), f"doc_id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """tokens, and perplexity of the base and the model, by held_out."""
    ppl = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), ppl("base_score").alias("base_perplexity"), ppl("score").alias("perplexity"))
