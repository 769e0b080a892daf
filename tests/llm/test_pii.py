import hashlib
import random
import re
from pathlib import Path

from kohort.llm import pii
from kohort.session import checkpoint_dir
from tests.llm.data import clashing, docs

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            v = m.group(0)
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def row(i, text):
    b = base(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
    return (i, *(sum(x[0] == k for x in b) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())


def got(spark, rows):
    return sorted((tuple(r) for r in pii.digests(pii.personal_data(clashing(docs(spark, rows)))).collect()), key=str)


ODD = ["a@b.co_x@y.zz", "a@b@c.d", "x..y@z..w a@b.c.d. q@r-s.t-u.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.001", "1.2.3", "4111 1111-1111 1111 9",
       "4111111111111111", "4111  1111", "x4111-1111-1111-1111-", "+1 (017) 555-7713 +1+2345678901 +12 .", "é😀 4111111111111111 a@b.c",
       "\u0001\u0002\u0003a@b.c\u0004 1\u00022 +1\u0003 234567890", "9" * 3000, "a" * 3000 + "@b.c", "1-2 3-4 5-6 7 8 9 0 1 2 3 4 5", "", None,
       "a@" + "b." * 2000 + "c", "1." * 3000, "4 " * 3000, "%+-@-.-", "+1.........9999999999 ", "0" * 14 + "18", "- 4111111111111111 - "]


def test_base_matches_brute_force(spark):
    rng = random.Random(6)
    bits = list("0123456789.@ +-()ab\n_é") + ["1.2.3.4", "a@b.cd", "4111111111111111", "+1 555 123 4567"]
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(100 + k, "".join(rng.choice(bits) for _ in range(rng.choice([5, 40, 200])))) for k in range(300)]
    rows += [(7, "a@b.c"), (7, "a@b.c"), (None, "a@b.c"), (None, None)]
    assert [r[:6] for r in got(spark, rows)] == sorted((row(*r) for r in rows), key=str)


def test_contexts_reveal_others_and_spare_the_rest(spark):
    rng = random.Random(1)
    rows = [(k, f"please call me at +1 555 {k:03d} {rng.randrange(1000, 9999)} or the shop") for k in range(30)]
    rows += [(100 + k, f"the year was {1900 + k} and the house 10{k}20") for k in range(30)]
    rows += [(200, "Please call me  at 0555-123987, or not"), (201, "the at 77712345"), (202, "nobody was 55512345 at home")]
    rows += [(300 + k, f"mail k{k}@x.org") for k in range(20)]
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert out[200] == "phone:19:30"
    assert out[201] == "" and out[202] == "" and out[100] == ""
    assert out[0].startswith("phone:18:")


def test_copies_do_not_raise_the_bar_of_a_pattern(spark):
    rng = random.Random(2)
    rows = [(k, f"you can dial us on +1 555 {k:03d} {rng.randrange(1000, 9999)} or walk in") for k in range(8)]
    rows += [(100 + k, "then ring +1 555 000 0000 now " * 250) for k in range(20)]
    rows += [(200, "or dial us on 0555-123987 today")]
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert out[200] == "phone:14:25"


def test_trusted_instances_raise_further_patterns(spark):
    rng = random.Random(3)
    rows = [(k, f"please call at +1 555 {k:03d} {rng.randrange(1000, 9999)} or walk in") for k in range(40)]
    rows += [(100 + k, f"you may call at 0555-1239{k:02d} today") for k in range(6)]
    rows += [(200 + k, f"or dial us on 0555-1239{k:02d} today") for k in range(6)]
    rows += [(300, "or dial us on 0777-555444 today")]
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert out[100] == "phone:16:27"
    assert out[200] == "phone:14:25" and out[300] == "phone:14:25"


def test_common_pairs_are_not_counted_for_a_few_instances(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, f"please call me at +1 555 {k:03d} {rng.randrange(1000, 9999)} or the shop") for k in range(30)]
    rows += [(100 + k, f"one of the k{k}@x.org") for k in range(6)]
    rows += [(200 + k, f"some of the {1000 + 17 * k} and of the many of the few") for k in range(20)]
    rows += [(300, "Please call me  at 0555-123987, or not")]
    counted, count = [], pii.pattern_totals

    def spied(docs, patterns):
        counted.extend(r.pattern for r in patterns.collect())
        return count(docs, patterns)
    monkeypatch.setattr(pii, "pattern_totals", spied)
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert counted == ["me at"]  # "of the" stands before 6 addresses and 20 other numbers
    assert out[300] == "phone:19:30" and out[200] == "" and out[100] == "email:11:19"


def test_common_pairs_are_ruled_out_by_a_part_of_the_corpus(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, f"please call me at +1 555 {k:03d} {rng.randrange(1000, 9999)} or the shop") for k in range(30)]
    rows += [(100 + k, f"one of the k{k}@x.org") for k in range(6)]  # nothing else that may identify stands behind it
    rows += [(200, "Please call me  at 0555-123987, or not"), (201, "one of the 0555-123987")]
    rows += [(1000 + k, f"some of the many and of the few {rng.choice('abc')}") for k in range(12_000)]
    counted, count = [], pii.pattern_totals

    def spied(docs, patterns):
        totals = count(docs, patterns)
        counted.append({r.pattern: r.total for r in totals.collect()})
        return totals
    monkeypatch.setattr(pii, "pattern_totals", spied)
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert sum(c.get("of the", 0) for c in counted) < 6_000  # of 24,007 in all
    assert counted[-1] == {"me at": 31}  # what is scored is counted in the whole corpus
    assert out[200] == "phone:19:30" and out[201] == "" and out[100] == "email:11:19"


def test_parts_change_no_result(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, f"please call at +1 555 {k:03d} {rng.randrange(1000, 9999)} or walk in") for k in range(80)]
    rows += [(100 + k, f"you may call at 0555-1239{k:02d} today") for k in range(12)]
    rows += [(200 + k, f"or dial us on 0555-1239{k:02d} today") for k in range(12)]
    rows += [(300, "or dial us on 0777-555444 today"), (None, "dial us on 0777-555445"), (None, None), rows[0]]
    rows += [(400 + k, f"one of the k{k}@x.org and of the few and of the {1000 + k}") for k in range(9)]
    whole = got(spark, rows)
    assert sum("phone:14:25" in r[-1] for r in whole) == 13
    for first, step in [(3, 4), (9, 16)]:
        monkeypatch.setattr(pii, "FIRST", first)
        monkeypatch.setattr(pii, "STEP", step)
        assert got(spark, rows) == whole


def test_small_tables_write_no_file_for_each_partition(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, f"please call me at +1 555 {k:03d} {rng.randrange(1000, 9999)} or the shop") for k in range(30)]
    rows += [(100 + k, f"one of the k{k}@x.org") for k in range(6)]
    rows += [(200 + k, f"some of the {1000 + 17 * k} and of the many of the few") for k in range(20)]
    rows += [(300, "Please call me  at 0555-123987, or not"), (None, None), rows[0]]
    want, folder = got(spark, rows), Path(checkpoint_dir(spark).removeprefix("file:"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, kept = {k: spark.conf.get(k) for k in conf}, spark.sparkContext._jsc.getPersistentRDDs().size()
    there, made, checkpoint = set(folder.rglob("part-*")), [], pii.materialize

    def spied(df):
        out = checkpoint(df)
        made.append(set(folder.rglob("part-*")) - there)
        return out
    monkeypatch.setattr(pii, "materialize", spied)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert got(spark, rows) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "phone:19:30" in {r[-1] for r in want}
    assert len(set().union(*made)) <= 6 * 40  # with a checkpoint for each table of the graph: over 10 * 40
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept  # nothing stays behind


def test_kinds_that_start_at_one_place_count_it_once(spark):
    rows = [(k, f"log in as 10.0.0.{k}@x.org now") for k in range(6)] + [(100, "log in as root@host now")]
    out = {r[0]: r[-1] for r in got(spark, rows)}
    assert out[0] == "email:10:24,ip:10:18" and out[100] == "email:10:19"


def test_empty(spark):
    assert got(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = pii.personal_data(docs(spark, [(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
