"""Exact laws of small samples against enumeration."""

import itertools
import math
import random

import pytest

from kohort.operators import assoc as A
from kohort.operators.exact import fisher_rxc


def enumerated(rows):
    """p of a table by walking through every table with its margins."""
    r, c = [sum(x) for x in rows], [sum(x) for x in zip(*rows)]
    log = lambda t: -sum(math.lgamma(x + 1) for row in t for x in row)
    total, tail, bar = 0.0, 0.0, log(rows) + math.log1p(1e-7)

    def fillings(limit, left):
        if len(limit) == 1:
            if left <= limit[0]:
                yield (left,)
            return
        for x in range(min(limit[0], left) + 1):
            for rest in fillings(limit[1:], left - x):
                yield (x, *rest)

    def walk(left, table):
        nonlocal total, tail
        if len(table) == len(r):
            if not any(left):
                w = math.exp(log(table))
                total += w
                tail += w if log(table) <= bar else 0
            return
        for row in fillings(left, r[len(table)]):
            walk([a - b for a, b in zip(left, row)], [*table, row])
    walk(c, [])
    return tail / total


def cells(spark, tables):
    rows = [(f"v{k}", f"l{i}", f"g{j}", o) for k, t in enumerate(tables) for i, row in enumerate(t) for j, o in enumerate(row) if o]
    return spark.createDataFrame(rows, "variable string, level string, grp string, o bigint").repartition(3)


def test_tables_of_all_shapes_at_once(spark):
    r = random.Random(1)
    tables = [[[3, 0, 1], [1, 4, 0], [0, 1, 5]], [[1, 2, 3, 4], [4, 3, 2, 1]], [[2, 2], [0, 5], [3, 1], [1, 1], [4, 0]],
              [[6, 6, 6], [6, 6, 6]], [[10, 1], [1, 10]], [[0, 3], [3, 0]], [[5, 0, 0], [0, 5, 0], [0, 0, 5]]]
    while len(tables) < 16:
        t = [[r.randrange(4) for _ in range(r.randrange(2, 4))] for _ in range(1)]
        t += [[r.randrange(4) for _ in t[0]] for _ in range(r.randrange(1, 4))]
        if all(map(any, t)) and all(map(any, zip(*t))):
            tables.append(t)
    got = {x.variable: (x.n, x.p_value) for x in fisher_rxc(cells(spark, tables)).collect()}
    for k, t in enumerate(tables):
        assert got[f"v{k}"][0] == sum(map(sum, t))
        assert got[f"v{k}"][1] == pytest.approx(enumerated(t), rel=1e-9), t


def test_agrees_with_the_two_by_two_test(spark):
    rows = [(a, b) for a, b, n in (("x", "p", 7), ("x", "q", 2), ("y", "p", 3), ("y", "q", 11)) for _ in range(n)]
    df = spark.createDataFrame(rows, "v string, g string")
    two = A.fisher_2x2(df, ["v"], "g").first().p_value
    assert fisher_rxc(A._cells(df, ["v"], "g")).first().p_value == pytest.approx(two, rel=1e-9)


def test_one_row_empty_and_large_tables(spark):
    got = {x.variable: x.p_value for x in fisher_rxc(cells(spark, [[[3, 4]], [[500] * 5] * 5, [[3, 0], [0, 3]], [[1] * 13] * 13]),
                                                      max_arcs=10_000).collect()}
    assert got["v0"] == 1.0 and got["v1"] is None and got["v2"] == pytest.approx(0.1) and got["v3"] is None
    assert fisher_rxc(cells(spark, [[[1]]]).filter("o > 1")).count() == 0


def test_a_node_with_many_ways_goes_out_in_pieces(spark, monkeypatch):
    from kohort.operators import exact
    tables = [[[3, 0, 1], [1, 4, 0], [0, 1, 5]], [[1, 2, 3, 4], [4, 3, 2, 1], [2, 2, 0, 5]], [[9, 1], [2, 8]], [[5, 0, 0], [0, 5, 0], [0, 0, 5]],
              [[2, 0, 1, 1], [0, 3, 1, 0], [1, 1, 2, 1], [0, 1, 0, 3]]]
    monkeypatch.setattr(exact, "ARCS_PER_PART", 4)
    got = {x.variable: x.p_value for x in fisher_rxc(cells(spark, tables)).collect()}
    for k, t in enumerate(tables):
        assert got[f"v{k}"] == pytest.approx(enumerated(t), rel=1e-9), t
    node = spark.createDataFrame([("x", [9, 7, 4, 3, 0], 8)], "variable string, v array<bigint>, c bigint")
    want = sorted(x for x in itertools.product(range(9), range(8), range(5), range(4), [0]) if sum(x) == 8)
    found = []
    for p in exact._pieces(node, 5).collect():
        mine = [x for x in want if all(a <= y <= b for a, y, b in list(zip(p.lo, x, p.hi))[:-1])]
        assert len(mine) <= 4
        found += mine
    assert sorted(found) == want


def by_grid(rows):
    """p of a 3 x 3 table whose last row is the rest: all fillings of the two others."""
    import numpy as np
    r, c = [sum(x) for x in rows], [sum(x) for x in zip(*rows)]
    log_f = np.array([math.lgamma(x + 1) for x in range(max(c) + 1)])
    grid = lambda n: [(a, b, n - a - b) for a in range(n + 1) for b in range(n + 1 - a)]
    second = np.array(grid(r[1]))
    whole = math.lgamma(sum(r) + 1) - sum(math.lgamma(x + 1) for x in r + c)
    bar, p = -log_f[np.array(rows)].sum() + math.log1p(1e-7), 0.0
    for first in grid(r[0]):
        left = np.array(c) - first - second
        w = -log_f[list(first)].sum() - log_f[second].sum(axis=1) - log_f[np.maximum(left, 0)].sum(axis=1)
        p += np.exp(w[(w <= bar) & (left >= 0).all(axis=1)] - whole).sum()
    return p


def test_every_table_has_its_p_however_large(spark):
    # more than 50,000,000 paths in a stage; their law by a grid over two cells
    import numpy as np
    wide = [[2700, 2600, 2800], [2650, 2750, 2600]]
    log_f = np.array([math.lgamma(x + 1) for x in range(8101)])
    r, c = [sum(x) for x in wide], [sum(x) for x in zip(*wide)]
    bar, p = -log_f[np.array(wide)].sum() + math.log1p(1e-7), 0.0
    for x in range(c[0] + 1):
        y = np.arange(max(0, r[0] - x - c[2]), min(c[1], r[0] - x) + 1)
        z = r[0] - x - y
        w = -log_f[x] - log_f[c[0] - x] - log_f[y] - log_f[c[1] - y] - log_f[z] - log_f[c[2] - z]
        p += np.exp(w[w <= bar] - (math.lgamma(sum(r) + 1) - sum(math.lgamma(v + 1) for v in r + c))).sum()
    # 13 levels on either side, one row a cell: all tables are alike; with two rows in a cell, it is one of 14 * 13 / 2 pairs
    ones = [[int(i == j) for j in range(13)] for i in range(13)]
    pair = [[2 if i == j == 0 else x for j, x in enumerate(row)] for i, row in enumerate(ones)]
    got = {x.variable: x.p_value for x in fisher_rxc(cells(spark, [wide, ones, pair])).collect()}
    assert got["v0"] == pytest.approx(p, rel=1e-6)
    assert got["v1"] == pytest.approx(1.0) and got["v2"] == pytest.approx(2 / (14 * 13), rel=1e-9)


def test_uneven_margins_and_small_p(spark, monkeypatch):
    from kohort.operators import exact
    tables = [[[23, 19, 42], [18, 17, 47], [3007, 2895, 8932]], [[1, 2, 30], [25, 3, 2], [300, 310, 290]], [[9, 0, 8], [0, 12, 9], [0, 1, 150]],
              [[0, 30, 2], [20, 1, 1], [40, 30, 20]], [[8, 8, 8], [7, 7, 7], [70, 70, 70]]]
    want = [by_grid(t) for t in tables]
    assert min(want) < 1e-9 and max(want) > 0.99
    for share in (exact.ARCS_PER_PART, 20):
        monkeypatch.setattr(exact, "ARCS_PER_PART", share)
        got = {x.variable: x.p_value for x in fisher_rxc(cells(spark, tables)).collect()}
        assert [got[f"v{k}"] for k in range(len(tables))] == pytest.approx(want, rel=1e-8, abs=0)


def test_association_table_keeps_its_other_test(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"g{k % 3}", r.choice("abcd") if k > 8 else "e") for k in range(90)]
    df = spark.createDataFrame(rows, "g string, v string")
    assert A.association_table(df, ["v"], [], "g").first().test == "fisher"
    monkeypatch.setattr(A, "MAX_ARCS", 100)
    assert A.association_table(df, ["v"], [], "g").first().test == "chisq_low_expected"


def exact_rank_sum(a, b):
    """Two-sided p by all ways to choose the first sample's ranks."""
    pool = sorted(a + b)
    rank = {v: k + 1 for k, v in enumerate(pool)}
    m = len(a)
    w = sum(rank[v] for v in a) - m * (m + 1) // 2
    stats = [sum(x) - m * (m + 1) // 2 for x in itertools.combinations(range(1, len(pool) + 1), m)]
    low, high = sum(s <= w for s in stats), sum(s >= w for s in stats)
    return w, min(1.0, 2 * min(low, high) / len(stats))


def test_rank_sums(spark):
    r = random.Random(2)
    sizes = [(1, 1), (1, 6), (5, 5), (3, 9), (8, 6), (7, 7), (2, 12), (10, 4)]
    names = [f"x{k}" for k in range(len(sizes))]
    values = [r.sample(range(1000), a + b) for a, b in sizes]
    values[5] = list(range(7)) + list(range(500, 507))  # wholly apart
    rows = []
    for k, ((a, b), v) in enumerate(zip(sizes, values)):
        rows += [tuple(["p" if i < a else "q"] + [float(x) if j == k else None for j in range(len(sizes))]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {x.variable: x for x in A.rank_sum_test(df, names, "g", exact=True).collect()}
    for c, (a, _), v in zip(names, sizes, values):
        w, p = exact_rank_sum(v[:a], v[a:])
        assert (got[c].statistic, got[c].method) == (w, "exact") and got[c].p_value == pytest.approx(p, rel=1e-12)


def test_rank_sum_rule_ties_and_sizes(spark):
    rows = [("p" if k % 2 else "q", float(k * 37 % 101), float(k // 2), float(k) if k < 98 else None) for k in range(100)]
    got = {x.variable: x.method for x in A.rank_sum_test(spark.createDataFrame(rows, "g string, a double, b double, c double"),
                                                         ["a", "b", "c"], "g", exact=True).collect()}
    assert got == {"a": "normal", "b": "normal", "c": "exact"}  # 50 a group; ties; 49 a group
    p = A.rank_sum_test(spark.createDataFrame(rows, "g string, a double, b double, c double"), ["c"], "g", exact=True).first().p_value
    z = 24 / math.sqrt(49 * 49 * 99 / 12)  # 24.5 from the mean, less the continuity correction
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-3)


def test_association_table_chooses_exact_tests(spark):
    r = random.Random(3)
    rows = [(f"g{k % 2}", r.choice("abc"), r.choice("xy"), r.random()) for k in range(14)]
    df = spark.createDataFrame(rows, "g string, three string, two string, value double")
    got = {x.variable: x for x in A.association_table(df, ["three", "two"], ["value"], "g").collect()}
    assert got["three"].test == got["two"].test == "fisher" and got["value"].test == "rank_sum_exact"
    table = [[sum(x[1] == lv and x[0] == g for x in rows) for g in ("g0", "g1")] for lv in "abc"]
    assert got["three"].p_value == pytest.approx(enumerated([t for t in table if any(t)]), rel=1e-9)
