"""Source divergence and vector codes against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import divergence, vectorcode


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        df = Counter(t for l, _, w in docs if l == lang for t in set(w))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        count = defaultdict(Counter)
        for l, s, w in docs:
            if l == lang:
                count[s].update(t for t in w if df[t] >= least)
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        p = {s: share(c) for s, c in ((s, count[s]) for l, s, _ in docs if l == lang)}
        q = share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", best)):
                for k, (value, item) in enumerate(found):
                    out[lang, s, part, item.decode(), -value, k + 1] += 1
    return out


def audited(docs, **how):
    return Counter(tuple(r) for r in divergence.audit(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("chunk, held, few", [(4096, 400_000, 1_000_000), (3, 5, -1)])
def test_audit(spark, chunk, held, few, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "MAX_BROADCAST", few)
    monkeypatch.setattr(divergence, "SLICE", 50)
    rng = random.Random(2)
    vocabulary = "a b the The é Éa ß 中文 zz zeta 😀x don't x1y ~ _u".split()
    rows = [(" ".join(rng.choice(vocabulary[: 4 + rng.randint(0, 11)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S", "é", None, "~"])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "xx", "alone"), ("word", "yy", "p"), ("word", "yy", "q"), ("1 2 3", "yy", "r"), ("the " * 500, "en", "s2"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "docs", "v", "groups", "value", "rank", "item")})
    assert audited(docs.repartition(5), least=3, top=4) == brute_audit(rows, 3, 4)


def test_audit_of_nothing(spark):
    assert not audited(spark.createDataFrame([], "text string, lang string, source string"))


def test_shares_of_counts_beyond_a_long_product():
    n, total, v = 5 * 10**12, 9 * 10**14, 10**6
    assert divergence.share(np.array([n]), total, v)[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
    assert divergence.share(np.array([total]), total, 1)[0] == 1 + 10**9


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain Lloyd: every distance, every round."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(by_id[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // parts
    books = [[r[1][p * w : p * w + w] for r in [x for x in by_id if len(x[1]) == size][:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((dist(v[p * w : p * w + w], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        of = [[near(p, v)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), c in zip(kept, of) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out, total = [], Counter()
    for i, v, label in kept:
        best = [near(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        total[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total[label], digest) for i, label, c, e in out)


def vectors(seed, n, size=32, kind="even"):
    rng = np.random.default_rng(seed)
    if kind == "grid":  # many equal distances
        x = rng.integers(-2, 3, (n, size)) / 64
    else:
        x = rng.normal(0, 1, (n, size)) + 3 * rng.integers(0, 4, (n, 1))
    return [(int(i), [float(np.float32(c)) for c in v], int(i) % 3 if i % 5 else None) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("kind, entries, parts, few", [("even", 64, 16, 100), ("grid", 64, 16, -1), ("grid", 256, 8, 100), ("even", 1, 4, 100), ("even", 7, 32, 100)])
def test_vector_codes(spark, kind, entries, parts, few, monkeypatch):
    monkeypatch.setattr(vectorcode, "MAX_BROADCAST", few)
    rows = vectors(3, 150, kind=kind)
    odd = [(1000, None, 1), (-5, [1.0, None] * 16, 1), (-6, [float("nan")] * 32, 2), (-7, [float("inf")] * 32, 2), (-8, [], 2), (1001, [1.0] * 3, 2), (None, [0.5] * 32, 0), rows[0], rows[0], (rows[1][0], [0.25] * 32, 1)]
    docs = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "x", "code", "upper", "error", "__label2")})
    got = Counter(tuple(r) for r in vectorcode.coded(docs.repartition(4), entries=entries, parts=parts).select("id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes([*rows, *odd], parts, entries)


def test_few_vectors_none_and_such_that_do_not_fit(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(3, [0.1, -0.2, 0.3, 0.4], "a"), (1, [0.1, -0.2, 0.3, 0.4], None)]
    got = vectorcode.coded(spark.createDataFrame(rows, schema), parts=4).select("id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == brute_codes(rows, 4)
    assert vectorcode.coded(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    with pytest.raises(ValueError):
        vectorcode.coded(spark.createDataFrame(rows, schema), parts=3)
    with pytest.raises(Exception, match="beyond"):
        vectorcode.coded(spark.createDataFrame([(1, [1e30] * 4, "a")], schema), parts=4).collect()


@pytest.mark.parametrize("seed", range(6))
def test_bounds_skip_and_never_change_a_code(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-300, 300, (4000, 4)), rng.integers(-300, 300, (64, 4))
    book[5], x[:64] = book[4], book
    code, upper, lower = vectorcode.scan(x, book)
    scanned = 0
    for step in range(4):
        new = book + rng.integers(-3, 4, book.shape) * (rng.random((64, 1)) < 0.5)
        scanned += vectorcode.follow(x, code, upper, lower, book, new)
        book = new
        d = vectorcode.distances(x, book)
        assert (code == d.argmin(1)).all()
        assert (upper >= np.sqrt(d.min(1)) * vectorcode.UNIT).all()
    assert 0 < scanned < 4 * 4000 * 0.8
