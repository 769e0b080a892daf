import random

from pyspark.sql import functions as F

from kohort.llm import line_dedup as d
from tests.llm.data import clashing, docs


def brute(rows):
    """By the definition, without chunks: from each line that isn't blank to the next, all but the first of equal ones go."""
    seen, out = set(), {}
    for null, i, t in sorted({(i is None, i or 0, t) for i, t in rows if t is not None}):
        lines = t.split("\n")
        units = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b in zip(units, units[1:]):
            part = "\n".join(lines[a:b + 1])
            if part in seen:
                gone |= set(range(a, b + 1))
            seen.add(part)
        out[(None if null else i, t)] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return sorted(((i, *(out[(i, t)] if t is not None else (None, 0, 0))) for i, t in rows), key=str)


def case():
    rng = random.Random(2)
    pool = [f"line {k} of the pool" for k in range(60)] + ["", " ", "é ü"]
    passages = [[rng.choice(pool) for _ in range(rng.choice([2, 4, 12]))] for _ in range(6)]
    rows = []
    for k in range(60):
        t = [rng.choice(pool) + f" {rng.random()}" for _ in range(rng.choice([0, 1, 4, 20]))]
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(passages)
        rows.append((k, "\n".join(t)))
    copy = rows[9][1]
    return rows + [(100, copy), (100, copy), (None, copy), (101, None), (None, None), (102, ""), (103, "\n" * 50),
                   (104, "same\n" * 3000), (105, "same\n" * 3000), (106, "one line only"), (107, "one line only")]


def got(spark, rows):
    out = d.deduplicated(clashing(docs(spark, rows))).select("doc.doc_id", "new_text", "n_lines", "n_removed")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rows = case()
    want = brute(rows)
    assert sum(r[3] > 0 for r in want) > 5
    assert got(spark, rows) == want


def test_short_passages_go_whole(spark):
    for size in (2, 3, 5):
        passage = [f"passage {size} line {k}" for k in range(size)]
        rows = [(k, "\n".join([f"own {k} a", f"own {k} b"] + passage + [f"own {k} c", f"own {k} d"])) for k in range(20)]
        assert [r[3] for r in sorted(got(spark, rows))] == [0] + [size] * 19


def test_overlaps_blank_lines_and_first_occurrences(spark):
    rows = [(1, "X\nA\nB"), (2, "Y\nA\nB"), (3, "Y\nA\nZ"), (4, "\np\n\n \nq\n"), (5, "p\n\n \nq"), (6, "p\n\nq"),
            (7, "s\ns\ns\ns")]
    assert got(spark, rows) == [(1, "X\nA\nB", 3, 0), (2, "Y", 3, 2), (3, "Z", 3, 2), (4, "\np\n\n \nq\n", 6, 0), (5, "", 4, 4),
                                (6, "p\n\nq", 3, 0), (7, "s", 4, 3)] == brute(rows)
    assert sorted(r.doc_id for r in d.without_repeats(docs(spark, rows)).collect()) == [1, 2, 3, 4, 6, 7]


def test_borders_resist_shifts(spark):
    rng = random.Random(4)
    lines = [f"{rng.random()}" for _ in range(40)]
    rows = docs(spark, [(1, "\n".join(lines)), (2, "\n".join(["new"] * 3 + lines))])
    found = rows.select("doc_id", F.explode(d._chunks(F.col("text"))).alias("c")).select("doc_id", "c.*").collect()
    first, moved = ({r.stop - 3 * (i - 1) for r in found if r.doc_id == i} for i in (1, 2))
    assert len(first) > 5 and len(first - moved) <= 1


def test_whole_table_matches_brute_force(spark):
    from kohort.llm.common import table
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[3] > 0 for r in want) > 50
    assert got(spark, rows) == want


def test_empty_and_columns(spark):
    assert got(spark, []) == []
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, None)]
    left = d.without_repeats(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(tuple(r)[:2] for r in left.collect()) == [(1, "a\nb\nc\nd"), (3, None)]


def test_no_python_in_the_plan(spark):
    plan = d.deduplicated(docs(spark, [(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
