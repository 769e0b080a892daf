import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from kohort.llm import spelling as S
from kohort.llm.common import table
from kohort.llm.queries import QUERIES
from tests.llm.data import clashing, docs

LOWER = {k: k + 32 for k in range(65, 91)}


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def slow_near(words):
    """Words that share what is left when one place of either is blotted out or deleted, compared letter by letter."""
    buckets = defaultdict(set)
    for w in words:
        buckets[w].add(w)
        for k in range(len(w)):
            buckets[w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for held in buckets.values():
        for a in held:
            near[a] |= {b for b in held if a != b and one_edit(a, b)}
    return near


def slow_groups(words):
    near = slow_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def groups(spark, words, parts=3):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(parts)
    return sorted(tuple(x) for x in S.spelling_groups(df).collect())


def random_words(r, n, letters="abcdé", longest=9):
    words = {}
    for _ in range(n):
        w = "".join(r.choice(letters) for _ in range(r.randrange(1, longest)))
        words[w] = r.choice([3, 3, 6, 7, 12, 24, 24, 50])
        for _ in range(r.randrange(3)):  # variants, anagrams among them
            v = list(w)
            k = r.randrange(len(v))
            v[k:k + r.randrange(2)] = r.choice(["", "a", "x", "ñ"])
            if r.random() < 0.3:
                r.shuffle(v)
            if v:
                words["".join(v)] = r.choice([3, 6, 12, 24, 100])
    return words


def test_against_brute_force(spark):
    r = random.Random(1)
    words = random_words(r, 400)
    want = slow_groups(words)
    near = {w: {v for v in words if one_edit(w, v)} for w in words}  # by all pairs, to check the slow way itself
    assert all(len(near[x[0]]) == x[4] for x in want)
    assert groups(spark, words) == want


def test_many_cells_and_pieces(spark, monkeypatch):
    for name, value in {"PER_CELL": 40, "LEAF": 4, "POINT_LETTERS": 90, "QUERY_LETTERS": 200, "QUERIES_AT_ONCE": 64}.items():
        monkeypatch.setattr(S, name, value)
    words = random_words(random.Random(2), 500, "abcdefg", 12)
    assert groups(spark, words, 5) == slow_groups(words)


def test_cells_from_a_poor_sample_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 7)
    monkeypatch.setattr(S, "PER_CELL", 30)
    words = random_words(random.Random(3), 300)
    assert groups(spark, words) == slow_groups(words)


def test_ties_chains_anagrams_long_words_and_letters_of_one_class(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96,  # a chain to the last
             "kitten": 5, "mitten": 10, "bitten": 10,  # ties: the smaller
             "listen": 9, "silent": 90, "enlist": 90,  # anagrams aren't near
             "x" * 6_000: 4, "x" * 6_001: 8, "x" * 5_999 + "y": 9, "x" * 4_500: 3,
             "àbcde": 3, "Ġbcde": 7,  # both of one letter class
             "single": 3, "\U0001F600bcde": 50}
    got = {x[0]: x for x in groups(spark, words)}
    assert sorted(got.values()) == slow_groups(words)
    assert got["aaaaa"][2] == "bbbbb" and got["kitten"][1] == "bitten" and got["listen"][4] == 0


def test_query_rows_over_documents(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioußétrn") for _ in range(r.randrange(4, 9))) for _ in range(150)]
    vocabulary += [w.upper() for w in vocabulary[:20]] + ["ÀÉÎÕÜ", "àéîõü"]
    rows = [(k, " ".join(r.choice(vocabulary) + r.choice(["", "!", "1", "-"]) for _ in range(200))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "12 34"), (None, " ".join(vocabulary)), (3, rows[3][1]), (3, rows[3][1])]
    words = S.occurrences(clashing(docs(spark, rows))).select(S.thinned(F.col("doc_id"), F.col("run")).alias("word"))
    got = sorted(tuple(x) for x in S.spelling_groups(S.vocabulary(words)).collect())
    assert got == slow_groups(slow_words(rows))
    assert any(x[1] for x in got)


def test_empty_table(spark):
    assert S.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert groups(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]


def test_tree_reaches_every_leaf_in_range():
    rng = np.random.default_rng(1)
    rows, queries = (rng.integers(0, 5, (n, 6)).astype(np.int8) for n in (500, 80))
    for unit in (None, np.ones(6, np.int32)):
        tree = S.Tree(rows.astype(np.int32), 10, unit)
        leaf = {int(k): node for node in range(len(tree.rows)) if tree.child[node, 0] < 0 for k in tree.rows[node]}
        assert sorted(leaf) == list(range(500))
        asked = {(int(q), node) for node, held in tree.reached(queries.astype(np.int32), 2) for q in held}
        near = np.abs(queries[:, None].astype(int) - rows[None]).sum(axis=2) <= 2
        assert all((int(q), leaf[int(p)]) in asked for q, p in zip(*np.nonzero(near)))
        assert len(asked) < 80 * len(set(leaf.values()))


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in table(spark, sf_dir, "documents").collect()]
    got = sorted(tuple(x) for x in QUERIES["op12_spelling"](spark, sf_dir).collect())
    assert got == slow_groups(slow_words(rows))
