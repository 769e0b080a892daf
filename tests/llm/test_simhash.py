import random

import numpy as np
import xxhash

from kohort.llm import simhash
from kohort.llm.graph import connected_components
from tests.llm.data import clashing, docs


def slow_fp(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words, cur = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    fps = [slow_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["École", "İx", "a b"]
    out = []
    for k in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))]
        out.append((k, " ".join(base)))
        for c in range(rng.choice([0, 0, 3])):
            near = list(base)
            if near:
                near[rng.randrange(len(near))] = "changed"
            out.append((1000 + k * 10 + c, "\t".join(near).upper()))
    return out + [(None, out[5][1]), (None, None), (7, None), (8, ""), (8, ""), (9, " \n"), (2000, "x " * 30000)]


def test_groups_match_brute_force(spark):
    rows = texts()
    found = simhash.near_duplicates(clashing(docs(spark, rows)))
    got = [tuple(r) for r in found.select("doc_id", simhash.hex_fp("fp"), "component_id").collect()]
    assert sorted(got, key=str) == slow_groups(rows)


def test_links_are_complete_at_any_tile_size(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 2, 20])):
            f ^= 1 << rng.randrange(64)
            if rng.random() < .5:
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in signed}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for x in signed:
        for y in signed:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 3:
                parent[find(x)] = find(y)
    want = {}
    for f in signed:
        want.setdefault(find(f), set()).add(f)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for tile_rows in (1, 3, 4096):
        groups = {}
        for r in connected_components(simhash.links(df, 3, tile_rows)).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in groups.values()} == want


def test_many_copies_give_few_links(spark):
    signed = [0] + [1 << k for k in range(62)]  # all within two bits of each other
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert simhash.links(df).count() < 5 * len(signed)


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (None, "a b c d"), (5, "other words stand here"), (None, None)]
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, "A b c d"), (5, "other words stand here")]
    assert kept.count() == 3
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}
