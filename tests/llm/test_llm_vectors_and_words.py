"""Vector codes, near-duplicate vectors and spelling variants against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import embedding_dedup, spelling_variants, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(width):
    """Rows that are dropped or stand alone."""
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [nan] * width, 1), (903, [inf] + [0.0] * (width - 1), 1), (904, [None] + [1.0] * (width - 1), 1)]


def vectors(seed=1, n=400, width=12, groups=5):
    rng = random.Random(seed)
    draw = lambda: [rng.gauss(0, 1) for _ in range(width)]
    centres = [draw() for _ in range(groups)]
    rows = []
    for i in range(n):
        kind = rng.random()
        x = draw() if kind < 0.3 else [c + rng.gauss(0, rng.choice([0.02, 0.2, 0.35])) for c in rng.choice(centres)]
        rows.append((i, [float(np.float32(c)) for c in x], rng.choice([0, 0, 1, 2, None])))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(20)]  # copies
    rows += [(n + 50, [2 * c for c in rows[3][1]], rows[3][2]), (5, rows[5][1], rows[5][2]), (5, rows[6][1], 0), (None, rows[7][1], rows[7][2]), (None, draw(), None)]
    rng.shuffle(rows)
    return rows


# Product codes


def coded(rows, rounds=4):
    whole = [(i, tuple(math.floor(1024 * c) for c in x), l) for i, x, l in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not whole:
        return Counter()
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    w = -(-len(whole[0][1]) // 4)
    parts = [[(r[1] + (0,) * 4)[p * w : (p + 1) * w] for r in whole] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, y)), e) for e, y in enumerate(b))
    for _ in range(rounds):
        for p in range(4):
            held = defaultdict(list)
            for x in parts[p]:
                held[near(x, books[p])[1]].append(x)
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    ends = [[near(parts[p][k], books[p]) for p in range(4)] for k in range(len(whole))]
    label = Counter()
    for r, e in zip(whole, ends):
        label[r[2]] += sum(d for d, _ in e)
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for _, k in e), sum(d for d, _ in e), label[r[2]], digest) for r, e in zip(whole, ends))


@pytest.mark.parametrize("width,n", [(12, 400), (10, 90), (3, 40), (64, 30)])
def test_codes(spark, width, n):
    rows = vectors(seed=width, n=n, width=width) + odd_vectors(width) + [(910, [1.0] * (width + 1), 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"part": F.lit("x"), "v": F.lit(0), "CODE": F.lit(1)}).repartition(5)
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress_vectors(df).collect())
    assert got == coded(rows)


def test_codes_of_edge_tables(spark):
    assert vector_codes.compress_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress_vectors(spark.createDataFrame(odd_vectors(8), VECTORS)).count() == 0
    rows = [(i, [3.0e38, -3.0e38, 0.0, -0.0005], None) for i in range(3)]
    out = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert [(r.code, r.error, r.label_error) for r in out] == [("00000000", 0, 0)] * 3


def test_bounds_lose_no_nearest_entry_and_spare_distances():
    rng = np.random.default_rng(3)
    for spread, width in ((300, 16), (5, 16), (2, 3), (1 << 26, 12), (0, 4)):
        x, book = rng.integers(-spread, spread + 1, (500, width)), rng.integers(-spread, spread + 1, (256, width))
        d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        code, error = vector_codes.nearest(x, book)
        assert error.tolist() == d.min(axis=1).tolist()
        assert code.tolist() == [row.tolist().index(min(row)) for row in d]
    x = np.cumsum(rng.integers(-100, 101, (500, 16)), axis=1)
    *_, taken = vector_codes._nearest(x, x[:256], vector_codes.Blocks(x[:256]))
    assert taken < 0.25 * 500 * 256


# Near-duplicate vectors


def linked(rows, threshold):
    good = [x is not None and len(x) > 0 and l is not None and all(c is not None and math.isfinite(c) for c in x) and any(x) for _, x, l in rows]
    links, part = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (_, x, l), (_, y, m) = rows[i], rows[j]
            if good[i] and good[j] and l == m and len(x) == len(y):
                x, y = [c / max(map(abs, x)) for c in x], [c / max(map(abs, y)) for c in y]
                if sum(a * b for a, b in zip(x, y)) >= threshold * math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)):
                    links[i] += 1
                    links[j] += 1
                    part[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        known = [k for k in (least[root(i)], r[0]) if k is not None]
        least[root(i)] = min(known) if known else None
    return Counter((r[0], links[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


def found_links(df, **options):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df, **options).collect())


@pytest.mark.parametrize("limit,average", [(512, 128), (40, 8)])
def test_links(spark, monkeypatch, limit, average):
    """Whole groups, and nodes by tokens with several blocks each."""
    monkeypatch.setattr(embedding_dedup, "LIMIT", limit)
    monkeypatch.setattr(embedding_dedup, "AVERAGE", average)
    rows = vectors(2) + odd_vectors(12) + [(920, [0.0] * 12, 1), (921, [0.0] * 12, 1), (922, [1.0] * 13, 1), (923, [1.0] * 12, 1), (924, [1e-30] * 12, 1), (925, [3e38] * 12, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"m": F.lit("x"), "gid": F.lit(0), "NODE": F.lit(1), "x": F.lit(2)}).repartition(5)
    want = linked(rows, 0.93)
    assert found_links(df) == want and sum(n for _, n, *_ in want) > 500
    assert found_links(df.where("vec_id IS NULL OR vec_id > 880")) == linked([r for r in rows if r[0] is None or r[0] > 880], 0.93)


def test_links_of_edge_tables(spark):
    assert embedding_dedup.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert found_links(spark.createDataFrame(odd_vectors(4), VECTORS)) == Counter((r[0], 0, r[0], True) for r in odd_vectors(4))
    names = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b")], "vec_id long, embedding array<double>, label string")
    assert found_links(names) == Counter({(1, 1, 1, True): 1, (2, 1, 1, False): 1, (3, 0, 3, True): 1})


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(4)
    for d in (3, 24, 64, 100):
        x = rng.normal(size=(3000, d))
        y = 0.93 * x / np.linalg.norm(x, axis=1)[:, None]
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1)[:, None] * x / (x * x).sum(axis=1)[:, None]
        y += math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = embedding_dedup.rotated(x), embedding_dedup.rotated(y)
        assert np.allclose((a * b).sum(axis=1), 0.93)
        p, q = embedding_dedup.Codes(a), embedding_dedup.Codes(b)
        estimate = (np.where(p.signs, 1, -1) / math.sqrt(a.shape[1]) * b).sum(axis=1) / p.factor
        if d > 20:
            assert abs(estimate.mean() - 0.93) < 0.01
        for i in range(300):
            s = [np.stack([u[i], v[i]]) for u, v in ((p.signs, q.signs), (p.factor, q.factor), (p.levels, q.levels), (p.grain, q.grain), (p.error, q.error))]
            assert embedding_dedup.possible(*s, 0.93)[0, 1]
    x = rng.normal(size=(200, 64))
    c = embedding_dedup.Codes(embedding_dedup.rotated(x / np.linalg.norm(x, axis=1)[:, None]))
    ruled_out = ~embedding_dedup.possible(c.signs, c.factor, c.levels, c.grain, c.error, 0.93)
    assert ruled_out.sum() > 0.999 * 200 * 199


def test_runs_find_a_pair_at_the_threshold():
    token, rng = embedding_dedup.same_token(0.93), np.random.default_rng(6)
    for size in (1000, 100_000):
        depth = embedding_dedup.depth_of(size)
        assert (1 - token**depth) ** embedding_dedup.runs_of(depth, token, 0.9999) <= 1e-4
    x = rng.normal(size=(400, 40))
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    meets = (embedding_dedup.nodes_of(x, 7, 100_000, token, 0.9999) == embedding_dedup.nodes_of(y, 7, 100_000, token, 0.9999)).any(axis=1)
    assert meets[(x * y).sum(axis=1) >= 0.93].all()


# Spelling variants


def variants(rows):
    n = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += len(run) > 6
            run = ""
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(around[w], key=lambda v: (-n[v], v)) for w in n if around[w]}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


def misspelt(seed=9):
    rng = random.Random(seed)
    letters = "abcÀé×÷ÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bananas"]
    rows = []
    for i in range(300):
        out = []
        for _ in range(40):
            w = rng.choice(words[: 1 + rng.randrange(len(words))])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            out.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice((" ", "7", "ß7ñ", "\n")).join(out)))
    return rows + [(1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]


def found_variants(df):
    out = spelling_variants.group_variants(df).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


def test_variants(spark):
    rows = misspelt()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "N", "wid", "key", "form")}).repartition(5)
    want = variants(rows)
    assert found_variants(df) == want
    assert len(want) > 300 and sum(v[0] is not None for v in want.values()) > 30 and max(v[3] for v in want.values()) > 3
    assert found_variants(df.limit(0)) == {}


def test_chains_of_forms(spark):
    """Each word is the form of the one before it; the last is the root of all."""
    words = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 11**k))
    doc = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words))
    got = found_variants(spark.createDataFrame([(doc, text)], "doc_id long, text string"))
    assert [got[w][:2] for w in words] == [(words[1], words[3]), (words[2], words[3]), (words[3], words[3]), (None, words[3])]


def test_very_long_words(spark):
    rng = random.Random(5)
    long_ = "".join(rng.choice("abc") for _ in range(300_000))
    other, more = long_[:1000] + "z" + long_[1001:], long_ + "a"
    same = "q" * 200_000
    rows = [(i, f"{w} {w}") for i, w in enumerate((long_, other, more, same, same + "q"))]
    rows = [(next(k for k in range(i, 10**6, 5) if zlib.crc32(f"{k}:{t.split()[0]}".encode()) % 31), t) for i, t in rows]
    got = found_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {w: v[2:4] for w, v in got.items()} == {long_: (2, 2), other: (2, 1), more: (2, 1), same: (2, 1), same + "q": (2, 1)}


def test_collisions_link_nothing(spark, monkeypatch):
    """With one hash for all, words meet at random and only their strings decide."""
    monkeypatch.setattr(spelling_variants, "mix", lambda x: np.full(len(x), np.uint64(7)))
    row, place, key, role = spelling_variants.deletion_keys(["abcdefg", "abcxefg", "abcdefgh", "mnopqrs"])
    assert len(set(key.tolist())) == 1
    words = ["abcdefg", "abcxefg", "abcdefgh", "mnopqrs"]
    out = spelling_variants.meet([(int(r), int(p), int(k), words[r], 5 - int(r)) for r, p, k in zip(row, place, role)])
    assert sorted(out) == [(0, 1, 3, "abcdefgh"), (0, 1, 4, "abcxefg"), (1, 1, 5, "abcdefg"), (2, 1, 5, "abcdefg")]
