import itertools
import random

import pytest

from pixelloom.operators import prefixcode


def cheapest(counts, limit, reserved):
    """The least cost over all lengths that leave room, by trying every one."""
    n = len(counts)
    best = None
    for lengths in itertools.product(range(1, limit + 1), repeat=n):
        room = (1 << limit) - sum(1 << (limit - k) for k in lengths)
        if room >= (1 << (limit - max(lengths)) if reserved else 0):
            cost = sum(c * k for c, k in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


def by_group(rows):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    return found


@pytest.mark.parametrize("limit,reserved", [(3, False), (4, True), (5, False)])
def test_least_cost(spark, limit, reserved):
    rng = random.Random(limit)
    groups = {d: [rng.choice([1, 1, 2, 3, 5, 8, 100, 1000]) for _ in range(rng.randrange(2, 6))] for d in range(25)}
    rows = [(d, s * 7, c) for d, cs in groups.items() for s, c in enumerate(cs)]
    got = by_group(prefixcode.prefix_codes(spark.createDataFrame(rows, "doc_id int, symbol int, n long"), ["doc_id"], limit, reserved).collect())
    assert set(got) == set(groups)
    for d, cs in groups.items():
        codes = sorted(format(r.code, f"0{r.length}b") for r in got[d])
        assert all(not b.startswith(a) for a, b in zip(codes, codes[1:])) and max(map(len, codes)) <= limit
        assert sum(r.n * r.length for r in got[d]) == cheapest(cs, limit, reserved)
        assert not reserved or all("0" in c for c in codes)
        order = sorted(got[d], key=lambda r: (r.length, r.symbol))
        assert [r.code << (limit - r.length) for r in order] == sorted(r.code << (limit - r.length) for r in order)


def test_limit_binds_and_kraft_is_full(spark):
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    rows = [(0, s, c) for s, c in enumerate(fib)] + [(1, s, 1) for s in range(256)] + [(2, s, 1 + s * s) for s in range(300)]
    got = by_group(prefixcode.prefix_codes(spark.createDataFrame(rows, "doc_id int, symbol int, n long"), ["doc_id"], 12).collect())
    assert max(r.length for r in got[0]) == 12 and {r.length for r in got[1]} == {8}
    for rows in got.values():
        assert sum(1 << (12 - r.length) for r in rows) == 1 << 12


def test_defined_cases(spark):
    rows = [(0, 5, 9), (1, None, 3), (1, 2, 0), (1, 3, None), (1, 4, 2), (1, 4, 2), (1, 6, 4), (None, 1, 1), (None, 2, 1), *[(2, s, 1) for s in range(9)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, symbol int, n long, length string")
    got = by_group(prefixcode.prefix_codes(df, ["doc_id"], 3).collect())
    assert [(r.symbol, r.n, r.length, r.code) for r in got[0]] == [(5, 9, 1, 0)]
    assert sorted((r.symbol, r.n, r.length, r.code) for r in got[1]) == [(4, 4, 1, 0), (6, 4, 1, 1)]
    assert sorted((r.symbol, r.length, r.code) for r in got[None]) == [(1, 1, 0), (2, 1, 1)]
    assert len(got[2]) == 9 and all(r.length is None and r.code is None for r in got[2])
    eight = prefixcode.prefix_codes(df.filter("symbol < 8 and doc_id = 2"), ["doc_id"], 3, reserved=True)
    assert eight.filter("length is null").count() == 8
    assert prefixcode.prefix_codes(df.limit(0), ["doc_id"]).isEmpty()
    with pytest.raises(ValueError):
        prefixcode.prefix_codes(df, ["doc_id"], 31)
    assert sorted(tuple(r) for r in prefixcode.counted(df, ["doc_id"]).filter("doc_id = 1").collect()) == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 6, 1)]
