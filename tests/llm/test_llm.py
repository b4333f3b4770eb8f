"""Operators against SQL, brute force or exact round trips, and their special cases."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import bpe, exact_dedup, jaccard_join, line_dedup, mixing, pitman_yor, quality, queries, secrets, shared, token_counts, token_files

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, keep_id string, h int, component_id int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 14), (4, "same text here", "en", None, 14), (4, "same text here", "en", None, 14),
    (None, "same text here", "en", "b", 14), (6, LONG, "en", "b", len(LONG)), (7, LONG + " tail", "en", "b", 1), (8, " \t\n ", "en", "ü", 4), (9, "Größe 🎉 <|endoftext|> 'S", "de", "ü", 1), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_matches_sql(name, agrees):
    agrees(queries.QUERIES[name], queries.ORACLE_SQL[name])


def words(t):
    return (t or "").encode().split()


def link_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (i, len(s), find(i)) for i, s in sets.items()}


def test_jaccard_brute_force(spark, texts):
    got = queries.op1_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == link_components(texts, 3, 90, 100)


def test_jaccard_hot_group(spark):
    """A group of near copies whose members don't all link with its centre: components are exact still."""
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    group = {}
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", f"u{rng.randrange(20)}"])
        group[i] = " ".join(w)
    docs = spark.createDataFrame(list(group.items()), "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        got = jaccard_join.near_duplicates(docs, k, num, 100).collect()
        assert {r["doc_id"]: tuple(r) for r in got} == link_components(group, k, num, 100)


def test_jaccard_all_links(spark, texts):
    """Each link between two documents comes out, those inside a component too."""
    import random

    rng = random.Random(6)
    base = [f"b{i}" for i in range(250)]
    group = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(["x", "y"])
        group[1000 + i] = " ".join(w)
    every = texts | group | {2000: None, 2001: " "}
    links, members = jaccard_join.linked(spark.createDataFrame(list(every.items()), "doc_id long, text string"), 3, 90, 100)
    sets = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i, w in ((i, (t or "").encode().lower().split()) for i, t in every.items()) if w}
    ids = sorted(sets)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert rep == {i: min(j for j in ids if sets[j] == sets[i]) for i in ids}
    got = [tuple(r) for r in links.collect()]
    assert sum(n for _, _, n in got) == len(want)
    assert Counter({(a, b): n for a, b, n in got}) == Counter(tuple(sorted((rep[a], rep[b]))) for a, b in want)
    assert len(got) == len({(a, b) for a, b, _ in got})
    assert sum(a != b for a, b, _ in got) > len({a for a, b, _ in got} | {b for a, b, _ in got})  # more than a spanning tree


def test_jaccard_repeated_rows(spark):
    """Rows that repeat both identifier and text, in one block and in several, are linked like single ones."""
    base = [f"b{i}" for i in range(100)]
    near = [*base[:50], "x", *base[51:]]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (2, " ".join(near)), (3, " ".join(f"c{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs.coalesce(1), docs.repartition(4)):
        got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df, 3, 90, 100).collect())
        assert got == Counter({(1, 1): 2, (2, 1): 2, (3, 3): 1})


def test_jaccard_odd(odd):
    got = Counter(map(tuple, jaccard_join.near_duplicates(odd, 3, 90, 100).collect()))
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 1, 3): 1, (4, 1, 3): 2, (None, 1, None): 1, (6, 29998, 6): 1, (7, 29999, 6): 1, (8, 0, 8): 1, (9, 2, 9): 1, (None, 0, None): 1})


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    got = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    got += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    got += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(got)


def test_secrets_brute_force(spark, texts):
    hard = {-1: "password=token:abcdefghij", -2: "🎉 token = 'abcdefgh1' " * 3 + "AKIA" + "B" * 12 + "a" * 40, -3: "PASSWORD:a password == abcdefgh", -4: ""}
    docs = spark.createDataFrame(list((texts | hard).items()), "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        spans = base_spans((texts | hard)[r["doc_id"]])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_secrets_link_parts(spark):
    blob = "A" * 39 + "/"
    docs = {1: f"user=bob {blob}", 2: "user=bob alone", 3: f"{blob} alone", 4: "user=bob " + "x " * 150 + blob, 5: f"user=bob at https://db.example/x with {blob}", 6: "https://db.example/x user=bob", 7: "user=bob " + "x" * 195 + " token=abcdefgh1"}
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secrets.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {1: ["user", "blob"], 2: [], 3: [], 4: [], 5: ["user", "endpoint", "blob"], 6: [], 7: ["assign"]}


def test_secrets_link_behind_long_parts(spark, texts, tmp_path):
    """The query measures the gap: a long part doesn't hide what follows it. All links are held against pairs."""
    jwt, blob, access = "eyJ" + "x" * 300, "A" * 39 + "/", "AKIA" + "B" * 16
    url = "https://db.example/x?" + "q" * 300
    docs = {1: f"token={jwt} user=bob", 2: f"token={jwt} https://db.example/x {access}", 3: f"{url} {access} token=abcdefgh1", 4: f"token={jwt} " + "x " * 101 + "user=bob", 5: "user=bob" + " " * 200 + "token=abcdefgh1", 6: "user=bob" + " " * 201 + "token=abcdefgh1", 7: f"token={jwt}" + " " * 200 + "user=bob", 8: f"{access} {url} {blob}", 9: f"{access} token=abcdefgh1" + " " * 170 + url + " x"}
    spark.createDataFrame(list((docs | {100 + i: t for i, t in texts.items()}).items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_secrets(spark, str(tmp_path)).collect()
    got, links = {r["doc_id"]: r["spans"] for r in rows}, {r["doc_id"]: r["links"] for r in rows}
    assert links[1] == f"user:{len(jwt) + 7}:{len(jwt) + 15}>assign:0:{len(jwt) + 6}"
    kinds = {i: [s.split(":")[0] for s in got[i].split(",") if s] for i in docs}
    assert kinds == {1: ["assign", "user"], 2: ["assign", "endpoint", "access"], 3: ["endpoint", "access", "assign"], 4: ["assign"], 5: ["user", "assign"], 6: ["assign"], 7: ["assign", "user"], 8: ["access", "endpoint"], 9: ["access", "assign", "endpoint"]}
    for i, t in docs.items() | {100 + i: t or "" for i, t in texts.items()}.items():
        base = [(a, k, b) for a, k, b in base_spans(t)]
        weak = [(m.start(), k, m.end()) for k, kind in enumerate(secrets.KINDS) if k >= 3 for m in re.finditer(secrets.PATTERNS[kind], t)]
        weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
        near = lambda w, role: any(secrets.ROLE[secrets.KINDS[k]] == role and max(a - w[2], w[0] - b) <= 200 for a, k, b in base + weak)
        spans = sorted(base + [w for w in weak if all(near(w, r) for r in secrets.NEEDS[secrets.KINDS[w[1]]])])
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        # Each reported weak part has a partner of each role that it needs, and the partner is near.
        found = Counter()
        for link in filter(None, links[i].split(",")):
            (kind, a, b), (kind2, a2, b2) = (x.split(":") for x in link.split(">"))
            assert max(int(a2) - int(b), int(a) - int(b2)) <= 200 and (int(a2), secrets.KINDS.index(kind2), int(b2)) in base + weak
            found[int(a), secrets.KINDS.index(kind), int(b), secrets.ROLE[kind2]] += 1
        assert found == Counter((a, k, b, r) for a, k, b in spans if k >= 3 for r in secrets.NEEDS[secrets.KINDS[k]])


def test_secrets_odd(spark, odd):
    """Nulls, empty and repeated texts, null identifiers, clashing columns, no rows, and very many matches in one text."""
    import time

    assert Counter(r["doc_id"] for r in secrets.scan(odd, gaps=True).collect()) == Counter(r[0] for r in ROWS)
    assert secrets.scan(odd.limit(0)).count() == 0
    rows = [(1, "user=bob token=abcdefgh1"), (1, "user=bob token=abcdefgh1"), (None, "user=bob token=abcdefgh1"), (None, None), (2, "user=bob")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, _h int, base string, _id string")
    both = "user:0:8,assign:9:24"
    assert Counter((r["doc_id"], r["spans"], r["n_linked"]) for r in secrets.scan(docs, gaps=True).collect()) == Counter({(1, both, 1): 2, (None, both, 1): 1, (None, "", 0): 1, (2, "", 0): 1})
    n, began = 60_000, time.time()
    many = " ".join(f"token=abcdefg{i:06d} user=u{i}" for i in range(n // 2))
    r = secrets.scan(spark.createDataFrame([(1, many)], "doc_id long, text string"), gaps=True).first()
    assert (r["n_assign"], r["n_linked"]) == (n // 2, n // 2)
    assert hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base_spans(many)).encode()).hexdigest() == r["base_sha256"]
    assert time.time() - began < 60


def test_pitman_yor(spark, texts):
    got = queries.op3_pitman_yor(spark, SF).collect()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    from math import log10

    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    again = {r["doc_id"]: r["score"] for r in queries.op3_pitman_yor(spark, SF).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def parts_of(rows):
    """The parts of a model as it is trained, with its sums."""
    import pyarrow as pa

    _, mine, world = pitman_yor.trained(rows)
    table = mine.toArrow()
    numbers = sorted(set(table.column("part").to_pylist()))
    parts = [pitman_yor.Part(table.filter(pa.compute.equal(table.column("part"), n)), world) for n in numbers]
    for p in parts:
        p.averaged()
    return parts, world


def test_pitman_yor_sums_to_one(spark, texts, monkeypatch):
    """On the production path, over several parts: each context's averaged probabilities of all words sum to one."""
    import numpy as np

    monkeypatch.setattr(pitman_yor, "PART_BYTES", 200_000)
    parts, world = parts_of(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3))
    assert len(parts) > 1
    unseen, contexts = world["back"] / (pitman_yor.THETA + world["M"]), 0
    for p in parts:
        # Words of the vocabulary that the part doesn't have get their share of the parent alone.
        known = p.tokens > 0
        absent = 1 - p.parent[known].sum()
        for c in range(0, p.ctxs, 37):
            back = (pitman_yor.THETA + world["d1"] * p.tables[c]) / (pitman_yor.THETA + p.seats.customers[c])
            total = p.predicted(np.full(known.sum(), c), np.flatnonzero(known)).sum() + back * absent
            assert total == pytest.approx(1, abs=1e-6)
            contexts += 1
    assert contexts > 100
    # The parent's probabilities over all parts' words, each once, and the unseen word sum to one too.
    tokens = Counter(w for i, t in texts.items() if not pitman_yor.held_out(i) for w in [*(t or "").encode().lower().split(), pitman_yor.END])
    assert world["V"] == len(tokens)
    everything, _ = parts_of_whole(spark, texts, monkeypatch)
    known = everything.tokens > 0
    assert known.sum() == len(tokens)
    assert everything.parent[known].sum() + everything.world["back"] / (pitman_yor.THETA + everything.world["M"]) == pytest.approx(1, abs=1e-6)
    assert unseen > 0


def parts_of_whole(spark, texts, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 1 << 40)
    parts, world = parts_of(spark.createDataFrame(list(texts.items()), "id long, text string"))
    return parts[0], world


def test_pitman_yor_against_slow_gibbs(spark):
    """A sampler that takes customers one by one away from their tables and seats them again agrees in the scores."""
    import random
    from math import log10

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(25)]
    chain = {w: rng.sample(vocab, 4) for w in vocab}
    docs = {}
    for i in range(120):
        w = [rng.choice(vocab)]
        while len(w) < 25:
            w.append(rng.choice(chain[w[-1]]) if rng.random() < 0.8 else rng.choice(vocab))
        docs[i] = w
    _, _, world = pitman_yor.trained(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id long, text string"))
    d1, d0, theta = world["d1"], world["d0"], pitman_yor.THETA
    end, context, parent = None, {}, {}  # restaurants: dish -> sizes of tables
    base = 1 / (world["V"] + 1)

    def prob0(w):
        t, c, k = parent.get(w, []), sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(t) - d0 * len(t) + (theta + d0 * k) * base) / (theta + c)

    def seat(r, dish, d, p):
        tables = r.setdefault(dish, [])
        k = sum(map(len, r.values()))
        u = rng.random() * (sum(tables) - d * len(tables) + (theta + d * k) * p)
        for j, size in enumerate(tables):
            u -= size - d
            if u < 0:
                tables[j] += 1
                return False
        tables.append(1)
        return True

    def leave(r, dish):
        tables = r[dish]
        j = rng.choices(range(len(tables)), tables)[0]
        tables[j] -= 1
        if not tables[j]:
            tables.pop(j)
            return True
        return False

    def enter(u, w):
        if seat(context.setdefault(u, {}), w, d1, prob0(w)):
            seat(parent, w, d0, base)

    train = [(u, w) for i, t in docs.items() if not pitman_yor.held_out(i) for u, w in zip([end, *t], [*t, end], strict=True)]
    held = [(i, list(zip([end, *t], [*t, end], strict=True))) for i, t in docs.items() if pitman_yor.held_out(i)]
    for u, w in train:
        enter(u, w)
    sums, samples = {}, 12
    for sweep in range(6 + samples):
        for u, w in train:
            if leave(context[u], w):
                leave(parent, w)
            enter(u, w)
        if sweep >= 6:
            for u, w in {x for _, t in held for x in t}:
                r = context.get(u, {})
                t, c, k = r.get(w, []), sum(map(sum, r.values())), sum(map(len, r.values()))
                sums[u, w] = sums.get((u, w), 0) + (sum(t) - d1 * len(t) + (theta + d1 * k) * prob0(w)) / (theta + c) / samples
    slow = {i: sum(log10(sums[x]) for x in t) for i, t in held}
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scored(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()}
    assert sum(got[i] for i in slow) == pytest.approx(sum(slow.values()), rel=0.01)
    assert all(got[i] == pytest.approx(slow[i], rel=0.05) for i in slow)


def test_pitman_yor_special_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 50_000)
    got = Counter(tuple(r)[:3] for r in pitman_yor.scored(odd).collect())
    assert got == Counter((r[0], pitman_yor.held_out(r[0]), 1 + len(words(r[1]))) for r in ROWS)
    assert pitman_yor.scored(odd.limit(0)).count() == 0


def test_pitman_yor_tells_words_before_apart(spark):
    """Words of one class (that end alike) have contexts of their own."""
    held = [i for i in range(2000) if pitman_yor.held_out(i)]
    train = [i for i in range(2000) if not pitman_yor.held_out(i)][:300]
    docs = [(i, "aaing p x bbing q x") for i in train] + list(zip(held, ["aaing p x", "aaing q x", "bbing q x", "bbing p x"], strict=False))
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1
    assert got[held[2]] > got[held[3]] + 1
    # Without training tokens every score is that of the uniform base, over the unseen word alone.
    only = pitman_yor.scored(spark.createDataFrame([(held[0], "a b"), (held[1], None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in only) == [(held[0], 3, 0.0), (held[1], 1, 0.0)]


def test_tables_are_drawn_from_their_conditional():
    """Stirling numbers against all seatings, drawn tables against their exact distribution, long runs against one by one."""
    import numpy as np

    def seatings(n, t, d):
        if n == 0:
            return float(t == 0)
        return (seatings(n - 1, t - 1, d) if t else 0) + max(0.0, n - 1 - d * t) * seatings(n - 1, t, d)

    table = pitman_yor.stirling(7, 0.4)
    for n in range(1, 8):
        for t in range(1, n + 1):
            assert np.exp(table[n, t]) == pytest.approx(seatings(n, t, 0.4))
    rng, n, d, p, others = np.random.default_rng(2), 6, 0.4, 0.3, 5
    weight = [seatings(n, t, d) * np.prod([(pitman_yor.THETA + d * (others + j)) * p for j in range(t)]) for t in range(1, n + 1)]
    got = np.bincount(pitman_yor.drawn(np.full(40_000, n), np.full(40_000, others), np.full(40_000, p), d, rng), minlength=n + 1)[1:] / 40_000
    assert got == pytest.approx(np.array(weight) / sum(weight), abs=0.01)
    slow = []
    for _ in range(3000):
        t = 1
        for i in range(1, 100):
            a = (pitman_yor.THETA + d * (others + t)) * p
            t += rng.random() < a / (a + i - d * t)
        slow.append(t)
    fast = pitman_yor.seated(np.full(3000, 100), np.full(3000, others), np.full(3000, p), d, rng)
    assert np.mean(fast) == pytest.approx(np.mean(slow), rel=0.03)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


def test_bpe_matches_library(spark, texts, tokenizer):
    for r in queries.op4_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinst \n\t'", max_size=80))
def test_bpe_any_text(tokenizer, text):
    c = bpe.codec(queries.BYTE_BPE)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert c.encode(text) == ids
    assert c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_odd(odd, tokenizer):
    got = bpe.encode(odd, queries.BYTE_BPE, ids=True).collect()
    assert len(got) == len(ROWS)
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


def test_mixing_odd(spark, odd):
    got = mixing.mix(odd, range_rows=2).collect()
    assert len(got) == len(ROWS)
    for s in {r["source"] for r in got}:
        rows = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert Counter(map(tuple, mixing.mix(odd.repartition(5), range_rows=2).collect())) == Counter(map(tuple, got))
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_docs(docs)
    assert out.columns == docs.columns
    n = Counter()
    for r in out.collect():
        n[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(n)
    assert mixing.mix(odd.limit(0)).count() == 0
    # Rows that share an identifier but not the text are told apart; repeated rows stand for one, with the words of all.
    total = sum(r["taken"] for r in got)
    mixed = mixing.mixed_docs(odd, range_rows=2)
    assert mixed.columns == odd.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == total
    assert mixing.mixed_docs(odd.limit(0)).count() == 0


def test_mixing_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 5, None: 700}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, total, fixed = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), sum(sizes.values()), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in sizes if s not in fixed)
        now = {s: rest * weights[s] / w for s in sizes if s not in fixed}
        over = {s: 3 * sizes[s] for s, t in now.items() if t > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(now | fixed)


def test_line_dedup_odd(spark):
    rows = [(i, "h", f"nav\nown {i}\nnav") for i in range(10)] + [(10, None, "nav\n\nx"), (11, "h", None), (12, "h", ""), (13, "one", "nav")]
    docs = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("lines", F.lit(1)).withColumn("bad", F.lit(2))
    got = {r["page_id"]: (r["n_dropped"], r["clean_text"]) for r in line_dedup.drop_boilerplate(docs, "page_id", F.col("host"), F.col("text")).collect()}
    assert got[3] == (2, "own 3")
    assert (got[10], got[11], got[12], got[13]) == ((0, "nav\n\nx"), (0, ""), (0, ""), (0, "nav"))


def test_line_dedup_blanks(spark):
    """Lines are compared without tabs, spaces and carriage returns around them; lines of only those are blank and stay."""
    rows = [(i, "h", f"\tnav\r\n \t\nown {i}\nnav \r\n\r\n\u00a0") for i in range(5)] + [(2, "h", "\tnav\r\n \t\nown 2\nnav \r\n\r\n\u00a0")] * 2 + [(9, None, "nav"), (None, "h", "nav\nz"), (None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("own", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("line", F.lit("x"))
    got = Counter(tuple(r) for r in line_dedup.drop_boilerplate(docs, "page_id", F.col("host"), F.col("text")).collect())
    # The no-break space is no blank here, so it is a line of its own, and boilerplate.
    want = Counter((i, "h", 6, 3, f" \t\nown {i}\n\r") for i in (0, 1, 3, 4)) + Counter({(2, "h", 6, 4, " \t\n\r"): 3})  # on 3 of 8 pages
    assert got == want + Counter({(9, None, 1, 0, "nav"): 1, (None, "h", 2, 1, "z"): 1, (None, None, 0, 0, ""): 1})
    assert line_dedup.drop_boilerplate(docs.limit(0), "page_id", F.col("host"), F.col("text")).count() == 0


def test_exact_dedup_odd(odd):
    for fan_in in (2, 3, 4, 16):
        got = Counter(map(tuple, exact_dedup.exact_groups(odd.repartition(9), fan_in=fan_in).select("doc_id", "keep_id", "group_size", "kept").collect()))
        assert got == Counter({(1, 2, 3, False): 1, (2, 2, 3, True): 1, (None, 2, 3, False): 1, (3, 4, 4, False): 1, (4, 4, 4, True): 2, (None, 4, 4, False): 1, (6, 6, 1, True): 1, (7, 7, 1, True): 1, (8, 8, 1, True): 1, (9, 9, 1, True): 1})
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9]
    assert exact_dedup.dedup(odd.limit(0)).count() == 0
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_token_counts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, None, None)], "source string, lang string, n long")
    store = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    assert store.commit("1", token_counts.inserts(docs, F.col("n"), "v1"))
    assert not store.commit("1", token_counts.inserts(docs, F.col("n"), "v1"))
    first = docs.where("n = 3")
    assert store.commit("2", token_counts.revisions(first, F.col("n"), "v1", F.col("n") * 10, "v2"))
    store.compact()
    assert not store.commit("2", token_counts.inserts(docs, F.col("n"), "v1"))
    assert store.commit("3", token_counts.deletes(docs.where("n is null"), F.col("n"), "v1"))
    (tmp_path / "r/batch=4").mkdir()  # an attempt that failed
    assert sorted(map(tuple, store.totals().collect())) == [("a", "en", "v1", 1, 4), ("a", "en", "v2", 1, 30)]
    assert store.commit("4", docs.limit(0).select("source", "lang", F.lit("v1").alias("tokenizer"), F.col("n").alias("docs"), F.col("n").alias("tokens")))


def test_token_files(spark, texts, odd):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_BPE)
    got, start = {r["doc_id"]: r for r in queries.op9_token_files(spark, SF).collect()}, 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = f"{shared.shared_dir(spark)}/files"
    manifest = token_files.write(odd, queries.WORD_BPE, folder, length=16)
    assert token_files.read(manifest).count() == len(ROWS)
    for r in manifest.collect():
        f = token_files.Sequences(f"{r['path']}.arrow")
        n = -(-r["n_tokens"] // 16)
        assert sum(int(f[i][1].sum()) for i in range(n)) == r["n_tokens"]
        assert all(len(f[i][0]) == 16 for i in range(n))
    assert token_files.round_trip(odd.limit(0), queries.WORD_BPE).count() == 0


def test_sequences_of_texts_longer_than_a_batch(tmp_path):
    import numpy as np

    rng, parts = np.random.default_rng(5), []
    f = token_files.SequenceFile(f"file://{tmp_path}/x.arrow", np.dtype("<u2"), 8)
    for n in (20_000, 3, 0, 4096, 4097, 1, 50_000, 7):
        parts.append(rng.integers(0, 40_000, n).astype("<u2"))
        f.add(parts[-1].tobytes())
    f.close()
    got, at = token_files.Sequences(f"file://{tmp_path}/x.arrow"), 0
    for p in parts:
        assert np.array_equal(got.ids(at, len(p)), p)
        at += len(p)
    with pytest.raises(EOFError):
        got.ids(at, 9)


def test_words_apart_equal_the_library():
    import random

    import numpy as np
    import pyarrow as pa

    w, r = token_files.WordIds(queries.WORD_BPE), random.Random(3)
    w.LIMIT = 900  # so that generations change
    some = "aZé×÷İß.,;:!?$#*%&()\"'s 'll 9²…\u0301\x85 \ufeff<|endoftext|>'D'\tÀ字"
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>.", "x.<|endoftext|>b", "don't!", "é.é", "a.\u0301", None]
    for t, got in zip(texts, w.of_batch(pa.array(texts)), strict=True):
        assert np.frombuffer(got, w.dtype).tolist() == w.model.encode(t or "", add_special_tokens=False).ids


def repeated(w):
    win, cov = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            cov.update(range(i, i + 5))
    return len(cov)


def test_quality_brute_force(spark, texts):
    for r in queries.op10_quality(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(w))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(w) < 10 or 100 * want[4] > 20 * len(w)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_quality_method_rejects(spark, texts):
    """kept is held against all windows of words; some texts pass the base rules and only the method rejects them."""

    def page(n, *passages):
        w, at = [f"p{i}" for i in range(n)], 0
        for size in passages:  # each passage stands twice
            w[at + size : at + 2 * size] = w[at : at + size]
            at += 2 * size + 7
        return " ".join(w)

    own = {-1: page(1000, 95), -2: page(4000, 390), -3: page(1000, 30, 30), -4: page(600, 24), -5: page(600, 25), -6: page(3000, 50), -7: page(3000, 51), -8: page(9000, 90), -9: page(9000, 91), -10: page(1000, *[19] * 4), -11: page(300)}

    def twice(w, n):
        win = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if win[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    want = {}
    for i, t in (texts | own).items():
        w = words(t)
        good = len(w) >= 10 and 100 * repeated(w) <= 20 * len(w)
        want[i] = (not good, good and 100 * len(twice(w, 20)) <= 8 * len(w) and not twice(w, max(50, len(w) // 100) + 1))
    got = quality.quality(spark.createDataFrame(list((texts | own).items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got} == want
    assert {i for i in own if want[i] == (False, False)} == {-1, -2, -3, -5, -7, -9}


def test_quality_keeps_labelled_clean(spark):
    """No document that is labelled clean and passes the base rules is lost to the method."""
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    got = queries.op10_quality(spark, SF).join(clean, "doc_id").where("not base_failed").groupBy("kept").count().collect()
    assert [r["kept"] for r in got] == [True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4))
def test_suffix_array(docs):
    got = quality.measured([" ".join(d).encode() for d in docs])
    for i, d in enumerate(docs):
        longest = max((n for n in range(len(d)) for a in range(len(d) - n + 1) for b in range(a) if d[a : a + n] == d[b : b + n]), default=0)
        assert (got[0][i], got[4][i], got[5][i]) == (len(d), repeated(d), longest)


def test_quality_odd(odd):
    got = quality.quality(odd).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"] for r in got if r["kept"]} == {6, 7}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [6, 7]


def test_empty_tables(spark, odd):
    """No rows in, no rows out, with the same columns."""
    none = odd.limit(0)
    for got in (jaccard_join.near_duplicates(none, 3, 90, 100), jaccard_join.keep_one(none), bpe.encode(none, queries.BYTE_BPE), quality.quality(none), quality.keep_good(none), *jaccard_join.linked(none, 3, 90, 100)):
        assert got.count() == 0


def test_jaccard_frequent_passage(spark, monkeypatch):
    """A passage that is in every prefix of unlinked documents, small blocks and ranges, sets common inside a block: all exact."""
    import random

    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    docs = {}
    for i in range(120):
        own = [f"o{i}_{j}" for j in range(rng.choice([3, 8, 30]))]
        docs[i] = " ".join(passage + own if i % 3 else own + passage[:40])
    for i in range(120, 160):  # from a few passages only: nothing in them is rare
        docs[i] = " ".join(w for n in rng.sample(range(8), 3) for w in (f"q{n}_{j}" for j in range(30)))
    docs |= {200 + i: docs[i] for i in range(0, 160, 5)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    for small in (False, True):
        if small:
            monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 2000)
            monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
            monkeypatch.setattr(jaccard_join, "COMMON", 3)
        for k, num in ((3, 90), (5, 80)):
            got = jaccard_join.near_duplicates(df, k, num, 100).collect()
            assert {r["doc_id"]: tuple(r) for r in got} == link_components(docs, k, num, 100)


def test_pipeline_odd(spark, odd, tmp_path):
    """Nulls, empty, long and repeated texts, clashing columns; no rows at all."""
    import corpus_pipeline as p

    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = p.run(spark, f"{tmp_path}/a").collect()
    # The rules keep the two long texts, which are near copies; the first stays and the mix takes it whole.
    assert {r["doc_id"] for r in got} == {6}
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert p.run(spark, f"{tmp_path}/b").count() == 0
    rows = [(1, " ".join(f"a{i}" for i in range(50))), (1, " ".join(f"b{i}" for i in range(50))), (2, " ".join(f"c{i}" for i in range(50)))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/c/documents.parquet")
    assert Counter(r["doc_id"] for r in p.run(spark, f"{tmp_path}/c").collect()) == {1: 2, 2: 1}


def test_token_counts_races(spark, tmp_path):
    """Two senders of a batch: one wins; attempts that failed are never read; folded batches go at the next fold."""
    docs = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n long")
    one, two = (token_counts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    deltas = token_counts.inserts(docs, F.col("n"), "v1")
    (tmp_path / "r/.work-x").mkdir(parents=True)
    two.committed = set  # it looked before the other was done
    assert [one.commit("1", deltas), two.commit("1", deltas)] == [True, False]
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v1", 1, 3)]
    one.compact()
    assert one.commit("2", deltas)
    one.compact()
    one.compact()
    assert sorted(n.name.split("-")[0] for n in (tmp_path / "r").iterdir() if n.name[0] != ".") == ["snapshot=000000002", "snapshot=000000003"]
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v1", 2, 6)]
    assert one.committed() == {"1", "2"} and not one.commit("2", deltas)


def test_pipeline_brute_force(spark, texts, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {i: t for i, t in texts.items() if len(words(t)) >= 10 and 5 * repeated(words(t)) <= len(words(t))}
    last = {}
    for i in sorted(good):
        last[good[i]] = i
    single = {i: t for t, i in last.items()}
    groups = {i: g for i, (_, _, g) in link_components(single, 5, 80, 100).items()}
    want = {i for i, g in groups.items() if i == g}
    for name, stage in p.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want)
    result = p.run(spark, SF)
    mix = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    n = Counter(r["doc_id"] for r in result.collect())
    assert n == {i: -(-r["taken"] // r["size"]) for i, r in mix.items() if r["taken"]}
