import random

from kohort.operators import lookup as LK


def run(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame(rules, "rule_order long, pattern string, label string")
    return [r.g for r in LK.substring_rules(df, "t", table, "g", "other").orderBy("id").collect()]


def test_first_rule_wins(spark):
    texts = ["mama izquierda", "pulmon", "", None, "colon", "a.b", "axb", "MAMA", "ño😀ño", "pulmon", "x" * 50000 + "end"]
    rules = [(2, "mama", "breast"), (1, "izq", "left"), (3, "pulmon", "lung"), (4, None, "null"), (5, "a.b", "dot"),
             (6, "o😀ñ", "face"), (7, "co", "two"), (0, "xxend", "long"), (9, "lon", "late")]
    assert run(spark, texts, rules) == ["left", "lung", "other", "other", "two", "dot", "other", "other", "face", "lung", "long"]
    assert run(spark, texts, []) == ["other"] * len(texts)
    assert run(spark, [], rules) == []
    assert run(spark, ["", None, "q"], [(1, "", "any")]) == ["any", "other", "any"]


def test_many_rules_against_a_loop(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rules = [(k % 900, "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 8))), f"l{k}") for k in range(3000)]

    def want(text):
        hits = [r for r in rules if r[1] in text]
        return min(hits)[2] if hits else "other"
    assert run(spark, texts, rules) == [want(t) for t in texts]


def test_patterns_with_white_space(spark):
    texts = ["a b", "a  b", "ab", " ", "", "x a\tb", "the end of it", "end", "of", "the  end", "foo bar baz", "xfoo barx", None, "foo", "\u00a0", "a\nb"]
    rules = [(5, "a b", "ab"), (4, "\t", "tab"), (3, "  ", "two"), (2, "end of", "eo"), (1, "foo bar", "fb"), (9, " ", "blank"),
             (6, "oo", "oo"), (0, "o barx", "late"), (7, "\u00a0", "hard"), (8, "a\nb", "line"), (6, "oo", None)]

    def want(text):
        hits = [r for r in rules if text is not None and r[1] in text]
        return min(hits, key=lambda r: (r[0], r[1], r[2] or ""))[2] or "other" if hits else "other"
    assert run(spark, texts, rules) == [want(t) for t in texts]


def test_words_are_matched_once_for_all_texts(spark, monkeypatch):
    texts = [f"alpha beta gamma-{k % 3}" for k in range(300)] + ["delta"]
    seen, containing = [], LK._containing

    def spied(words, pieces):
        seen.extend(r.word for r in words.collect())
        return containing(words, pieces)
    monkeypatch.setattr(LK, "_containing", spied)
    monkeypatch.setattr(LK, "LITERAL_BROADCAST_MAX_ROWS", 0)  # nothing is small enough
    assert run(spark, texts, [(2, "mma", "g"), (1, "elt", "d")]) == ["g"] * 300 + ["d"]
    assert sorted(seen) == ["", "alpha", "beta", "delta", "gamma-0", "gamma-1", "gamma-2"]


def test_rules_meet_texts_by_equality(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    rules = spark.createDataFrame([(1, "abc", "x")], "rule_order long, pattern string, label string")
    plan = LK.substring_rules(df, "t", rules, "g", "other")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
