"""SimHash trees, impact-sorted lists and the divergence audit against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from dayloom.llm import components, divergence, impact_lists, vantage
from dayloom.operators import lookup


# ---- SimHash and vantage-point trees


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(values, most=4, asked=None):
    """Smallest position reachable from each, by links with an end among ``asked``."""
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if asked is not None and not (asked[i] or asked[j]):
                continue
            if (int(values[i]) ^ int(values[j])).bit_count() <= most:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def scattered(seed, n=400):
    """Fingerprints at random, with chains and a dense group of near ones."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    out = [rng.getrandbits(64) for _ in range(n)] + [0, 2**64 - 1]
    for x in list(out[:40]):
        for _ in range(rng.choice([1, 1, 6])):
            x = flip(x, rng.randint(1, 5))
            out.append(x)
    centre = rng.getrandbits(64)
    out += [flip(centre, rng.randint(0, 5)) for _ in range(n // 2)]
    return np.unique(np.array(out, np.uint64))


def test_fingerprints_equal_bit_by_bit():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "One two THREE", "a b c d", "a b c d e", "É é\x0bx y\x1cz", "  word   x y"]
    texts += [" ".join(rng.choice(["la", "le", "Il", "ñandú", "x"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for t in texts:
        assert int.from_bytes(vantage.fingerprint(t), "big") == plain_fingerprint(t), t


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000))
    whole = vantage.fingerprint(text)
    monkeypatch.setattr(vantage, "BITS", 64)
    assert vantage.fingerprint(text) == whole
    assert int.from_bytes(whole, "big") == plain_fingerprint(text)


@pytest.mark.parametrize("parts", [1, 2, 4])
@pytest.mark.parametrize("leaf, held, seed", [(2, 64, 1), (8, 1 << 10, 2), (32, 1 << 21, 3), (10_000, 1 << 12, 4)])
def test_trees_find_all_links(monkeypatch, parts, leaf, held, seed):
    monkeypatch.setattr(vantage, "LEAF", leaf)
    monkeypatch.setattr(vantage, "HELD", held)
    values = scattered(seed)
    home = np.random.default_rng(seed).random(len(values)) < 0.6
    joined = vantage.Forest(len(values))
    for mask in vantage.masks(parts):
        up = vantage.search(values, np.flatnonzero(home), np.flatnonzero(~home), 4, 4 // parts, mask)
        for i, r in enumerate(up.roots(np.arange(len(values)))):
            joined.link(np.array([i, r]))
    assert joined.roots(np.arange(len(values))).tolist() == reachable(values, asked=home)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("size", [1000, 60, 15])
def test_shards_meet_in_every_pair(monkeypatch, parts, size):
    monkeypatch.setattr(vantage, "LEAF", 8)
    values = scattered(size)
    joined = vantage.Forest(len(values))
    for mask in vantage.masks(parts):
        tree = vantage.grow(values[::2], 2, size, 4 // parts, mask)
        cell, at, own = vantage.route(tree, values, 4 // parts, mask)
        assert len(np.unique(cell)) > (size < 1000)
        for c in np.unique(cell):
            here = np.unique(at[cell == c])
            mine = np.isin(here, at[(cell == c) & own])
            up = vantage.search(values[here], np.flatnonzero(mine), np.flatnonzero(~mine), 4, 4 // parts, mask)
            for i, r in enumerate(up.roots(np.arange(len(here)))):
                joined.link(here[[i, r]])
    assert joined.roots(np.arange(len(values))).tolist() == reachable(values)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 32)
    monkeypatch.setattr(vantage, "LEAF", 4)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [None, "", "  ", "a b", "A  b", "a b c"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    table = [(i + 5, t, 1, "x") for i, t in enumerate(rows)]
    table += [table[3], (None, rows[0], 2, "y"), (None, None, 2, "y"), (7, "another text of this id altogether new", 3, "z")]
    df = spark.createDataFrame(table, "doc_id long, text string, fp int, component_id string")
    got = vantage.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    named = [(r[0], plain_fingerprint(r[1])) for r in table]
    values = sorted({f for k, f in named if k is not None})
    least = {}
    for (f, r) in zip(values, reachable(values)):
        least[r] = min([least.get(r, 10**9), *(k for k, x in named if x == f and k is not None)])
    group = {f: least[r] for f, r in zip(values, reachable(values))}
    want = sorted((k is None, k or 0, f"{f:016x}", None if k is None else group[f]) for k, f in named)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in got.collect()) == want
    assert vantage.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SALTS", 4)
    chain = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    got = {r.cid: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- impact-sorted lists


def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    found = [Counter(term.findall(low(t))) for _, t in docs]
    n_docs, length = sum(1 for f in found if f), sum(f.total() for f in found)
    df = Counter(t for f in found for t in f)
    out = []
    for (item, text), row in items:
        score = []
        for (key, _), f in zip(docs, found):
            s = 0
            for t in set(term.findall(low(text))) & set(f):
                m = 100 - 90 + (90 * f.total() * n_docs) // length
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * f[t]) // (1000 * f[t] + 8 * m))
            if s > 0:
                score.append((-s, key is None, key or 0))
        out += [(item, i + 1, None if null else key, -s, row) for i, (s, null, key) in enumerate(sorted(score)[:k])]
    return out


def shelf(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "a", "Of", "ña", "x1", "rare", "w-w", "zz", *(f"t{i}" for i in range(30))]
    pick = lambda m: " ".join(rng.choices(words, [30, 20, 20, 9, 5, 1, 3, 3, *[2] * 30], k=m))
    docs = [(i, pick(rng.choice([1, 5, 40, 300]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "--- !!"), (3, docs[3][1]), (None, docs[5][1]), (None, docs[8][1]), (n + 4, docs[5][1])]
    items = [((j, pick(rng.randint(1, 12))), 1) for j in range(12)]
    items += [((20, None), 1), ((21, "unheard"), 1), ((22, "the"), 1), ((22, "the rare zz"), 2), ((None, "ña x1"), 1)]
    return docs, items


@pytest.mark.parametrize("chunk, shard, stretch", [(1 << 16, 1 << 20, 64), (200, 500, 1), (50, 60, 7)])
def test_search_equals_scoring_everything(spark, monkeypatch, chunk, shard, stretch):
    for name, v in (("CHUNK", chunk), ("SHARD", shard), ("STRETCH", stretch)):
        monkeypatch.setattr(impact_lists, name, v)
    docs, items = shelf(chunk)
    table = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i, _ in items] + [(22, "the", 6)], "item_id long, text string, score int")
    got = impact_lists.search(table, asked, block=7)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order(plain_search(docs, items))
    assert impact_lists.search(table.limit(0), asked).count() == 0
    assert impact_lists.search(table, asked.limit(0)).count() == 0


def test_lists_are_left_early_with_final_scores():
    rng = np.random.default_rng(3)
    n, k = 5000, 10
    lists, total, worth = [], np.zeros(n, np.int64), rng.pareto(1.0, n) * 100
    for t in range(6):  # every document in every list: one that a list lacks is settled at its end only
        score = (worth * rng.uniform(0.5, 1, n)).astype(np.int64) + 1
        docs = np.argsort(-score, kind="stable")
        lists.append((score[docs], docs))
        total += score
    bar = np.sort(total)[-k]
    for floor in (1, int(bar), int(np.sort(total)[-3])):
        at, got, read = impact_lists.read_lists(lists, n, k, floor)
        want = np.flatnonzero(total >= max(bar, floor))
        assert sorted(at.tolist()) == want.tolist()
        assert (got == total[at]).all()
        assert read < sum(len(s) for s, _ in lists)


# ---- divergence


def plain_audit(rows, least=3, ranks=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = term.findall(low(text))
        df[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: count[g, s] for g, s in count if g == lang}
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        f = lambda p, q: (p - q) ** 2 // q
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            term_ = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term_)[:ranks])):
                out += [(lang, s, part, i, -v, r + 1) for r, (v, _, i) in enumerate(sorted(found))]
    return sorted(out)


@pytest.mark.parametrize("held, block, stripe, room, told", [(400_000, (1 << 16, 1 << 21), 256, 1 << 20, 99), (20, (5, 30), 2, 3, 0), (1, (7, 7), 1, 1, 0)])
def test_audit_equals_pair_by_pair(spark, monkeypatch, held, block, stripe, room, told):
    for name, v in (("HELD", held), ("BLOCK", block), ("STRIPE", stripe), ("SCATTER", room), ("TOLD", told), ("ROWS", 9)):
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(held)
    words = ["The", "la", "Ñu", "ñu", "x", "😀", "z9z", *(f"w{'abcdefghij'[i]}" for i in range(10))]
    rows = [
        (rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), " ".join(rng.choices(words, k=rng.randint(0, 30))))
        for _ in range(150)
    ]
    rows += [("de", "s1", "only once"), ("de", "s2", None), ("it", "s1", "12 34"), rows[0], rows[0], ("en", "s9", "")]
    df = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "lang string, source string, text string, term int, code string")
    for ranks in (200, 2):
        got = sorted(tuple(r) for r in divergence.audit(df, ranks=ranks).collect())
        assert got == plain_audit(rows, ranks=ranks)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, c, v = 3 * 10**13, 2 * 10**13 + 7, 12345
    df = spark.createDataFrame([(c, n, v), (0, 0, 0), (0, n, v)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence._share("c", "n")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v), 1, 1 + 10**9 // (n + v)]


def test_sql_twins_on_the_small_table(spark):
    """The SQL of both queries agrees with brute force, so that it can stand for them."""
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}") for i, (_, t) in enumerate(shelf(1, 60)[0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    items = [i for i in shelf(1, 60)[1] if i[0][0] is not None]
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [i for i, _ in items])
    assert sorted(con.execute(divergence.oracle()).fetchall()) == plain_audit([(r[2], r[3], r[1]) for r in rows])
    assert sorted(con.execute(impact_lists.oracle()).fetchall()) == sorted(plain_search([(r[0], r[1]) for r in rows], items))
