import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kohort.llm import periodic_runs as P
from kohort.llm.common import table
from kohort.llm.queries import QUERIES
from tests.llm.data import clashing, docs


def slow_runs(w):
    """All runs, from the definition: for every period the maximal stretches, then the smallest period of each."""
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((l, r - l, q) for (l, r), q in found.items())


def slow_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_planted(doc_id, text):
    w = slow_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def slow_row(doc_id, text):
    w = slow_planted(doc_id, text)
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, *sha)


def random_words(r):
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(60))]
    if kind == 1:  # nested repetition
        w = [r.choice("abc") for _ in range(r.randrange(1, 4))] * r.randrange(1, 6)
        w += [r.choice("abc") for _ in range(r.randrange(3))]
        return (w * r.randrange(1, 9))[:r.randrange(1, 400)]
    if kind == 2:  # a Fibonacci word: many squares, no fourth power but small ones
        a, b = ["a"], ["a", "b"]
        while len(b) < 200:
            a, b = b, b + a
        return b[r.randrange(50):][:r.randrange(10, 150)]
    w = [f"w{r.randrange(30)}" for _ in range(r.randrange(1, 40))]
    return [f"x{k}" for k in range(r.randrange(20))] + w * r.randrange(1, 12) + w[:r.randrange(len(w))] + ["end"] * r.randrange(9)


def all_runs(lists):
    codes = {}
    flat = np.array([codes.setdefault(x, len(codes)) for w in lists for x in w], np.int64)
    bounds = np.cumsum([0, *map(len, lists)])
    first, stop, period = P.all_runs(flat, bounds)
    out = [[] for _ in lists]
    for l, r, q in zip(first, stop, period):
        k = int(np.searchsorted(bounds, l, "right")) - 1
        out[k].append((int(l - bounds[k]), int(r - l), int(q)))
    return [sorted(x) for x in out]


def test_all_runs_against_the_definition():
    r = random.Random(5)
    for _ in range(40):
        lists = [random_words(r) for _ in range(r.randrange(1, 30))]
        assert all_runs(lists) == [slow_runs(w) for w in lists]


@pytest.mark.parametrize("size", [1, 2, 4, 32, 256])
def test_convolution_finds_every_repeat(size):
    rng = np.random.default_rng(size)
    x = np.concatenate([np.tile(rng.integers(0, 3, 2 * size + 1), 4), rng.integers(0, 3, 5 * size), np.full(4 * size, 9)])
    starts = np.arange(0, len(x) - 4 * size, size)
    s, q = P.zero_mismatches(x.astype(np.uint64), starts, size, P.Transform(2 * size))
    want = {(a, d) for a in starts for d in range(size, 2 * size) if (x[a:a + size] == x[a + d:a + d + size]).all()}
    assert set(zip(s.tolist(), q.tolist())) == {(int(a), int(d)) for a, d in want}


def test_transform_is_a_cyclic_convolution():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, P.PRIME, (3, 16), dtype=np.uint64) for _ in range(2))
    t = P.Transform(16)
    got = t.inverse(P._mod(t.of(a.copy()) * t.of(b.copy())))
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
        assert z == [sum(x[k] * y[(d - k) % 16] for k in range(16)) % P.PRIME for d in range(16)]


def test_sums_that_vanish_modulo_the_prime_are_no_runs(monkeypatch):
    # with a small prime nearly every block seems to occur everywhere; the comparison of words decides
    monkeypatch.setattr(P, "PRIME", 257)
    monkeypatch.setattr(P, "ROOT", 3)
    monkeypatch.setattr(P, "LOG_SIZE", 8)
    r = random.Random(6)
    lists = [random_words(r) for _ in range(60)]
    assert all_runs(lists) == [slow_runs(w) for w in lists]


def test_long_texts_of_one_word_and_of_a_long_period():
    a, b = ["w"] * 30_000, [f"w{k}" for k in range(3_000)] * 7
    assert all_runs([a, b, a[:5], []]) == [[(0, 30_000, 1)], [(0, 21_000, 3_000)], [], []]


def result(spark, rows):
    found = P.digests(P.periodic_runs(P.planted(docs(spark, rows).select("doc_id", "text"))))
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_rows_against_the_definition(spark):
    r = random.Random(7)
    space = [" ", "\n", "\t ", "\x0b", "\r\n"]
    rows = [(k, "".join(x + r.choice(space) for x in random_words(r))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "a " * 9), (3, "a b " * 9), (3, "a b " * 9),
             (1003, "               "), (1004, "a" * 100_000)]
    assert result(spark, rows) == sorted([slow_row(*x) for x in rows], key=repr)


def test_planted_texts_are_the_rule(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 57))) for k in range(400)]
    got = {x.doc_id: slow_words(x.text) for x in P.planted(docs(spark, rows).select("doc_id", "text")).collect()}
    assert got == {k: slow_planted(k, t) for k, t in rows}
    assert any(w != slow_words(t) for (_, t), w in zip(rows, (got[k] for k, _ in rows)))


def test_general_interface_empty_table_and_clashing_columns(spark):
    rows = clashing(docs(spark, [(1, "x " + "a b " * 6 + "y"), (2, None)])).withColumnRenamed("n", "runs")
    found = {x.doc.doc_id: x for x in P.periodic_runs(rows).collect()}
    assert [tuple(x) for x in found[1].runs] == [(1, 12, 2)] and found[1].collapsed == "x a b y"
    assert found[1].doc.runs == "x" and found[1].n_words == 14
    assert found[2].runs == [] and found[2].collapsed == "" and found[2].n_words == 0
    assert P.digests(P.periodic_runs(docs(spark, [(1, "a")]).filter("doc_id = 2"))).count() == 0


def test_whole_table_against_the_definition(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    short = [x for x in rows if len(slow_words(x.text)) <= 3_000]  # the definition is a square law
    want = sorted((slow_row(*x) for x in short), key=repr)
    ids = {x.doc_id for x in short}
    got = [tuple(x) for x in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows)
    assert sorted((x for x in got if x[0] in ids), key=repr) == want
