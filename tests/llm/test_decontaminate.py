import hashlib
import random
import re

from kohort.llm import decontaminate as d
from tests.llm.data import clashing, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return WORD.findall(low)


def brute(rows, items, window=10):
    out = []
    for doc, text in rows:
        w = words(text)
        hit, ids = set(), set()
        for item, t in items:
            v = words(t)
            wins = [v[k:k + window] for k in range(max(1, len(v) - window + 1))] if v else []
            for win in wins:
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        if item is not None:
                            ids.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def case(seed=1, short=True):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)] + ["Été", "ß1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 11, 25] + [4] * short)))) for k in range(14)]
    items += [items[0], (99, items[1][1]), (100, None), (101, "..."), (None, items[2][1]), (10, items[3][1])]
    rows = []
    for k in range(50):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 30, 120]))]
        if k % 3 == 0:
            v = items[rng.randrange(14)][1].upper().split()
            a = rng.randrange(len(v))
            at = rng.randrange(len(t) + 1)
            t[at:at] = v[a:a + rng.choice([5, 10, 40])]
        rows.append((k, ", ".join(t)))
    return rows + [(None, items[0][1]), (5, None), (5, ""), (6, items[4][1]), (6, items[4][1]), (7, "zz " * 60000 + items[5][1])], items


def got(spark, rows, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.digests(d.matched(clashing(docs(spark, rows)), clashing(bench), **kw))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    for seed, short in ((1, True), (2, False)):
        rows, items = case(seed, short)
        assert got(spark, rows, items) == brute(rows, items)


def test_several_blocks_give_the_same(spark):
    rows, items = case(3)
    assert got(spark, rows, items, block_bytes=200) == brute(rows, items)


def test_one_word_items_and_empty_tables(spark):
    rows, items = [(1, "A b a"), (2, "c")], [(1, "a"), (2, "b a")]
    assert got(spark, rows, items) == brute(rows, items)
    assert got(spark, rows, []) == brute(rows, [])
    assert got(spark, [], items) == []


def test_longest_matches_and_places(spark):
    item = " ".join(f"t{k}" for k in range(30))
    rows = [(1, "x y " + " ".join(f"t{k}" for k in range(5, 25)) + " z"), (2, item + " " + item)]
    out = {r.doc_id: [tuple(m) for m in r.found.matches]
           for r in d.matched(docs(spark, rows), spark.createDataFrame([(8, item)], "item_id long, text string")).collect()}
    assert out == {1: [(8, 5, 2, 20)], 2: [(8, 0, 30, 30), (8, 0, 0, 30)]}


def test_pieces_of_a_long_text():
    text = "ab cd " * 600000
    assert sum(map(len, d.split_words(text, d.word_table()))) == 1200000


def test_filter(spark):
    rows, items = case(4)
    kept = d.decontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted(str(r[0]) for r in brute(rows, items) if not r[-1])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
