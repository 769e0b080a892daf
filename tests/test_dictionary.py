from kohort.sources import io


def test_exact_counts(spark):
    rows = [(1, "a", 0.0, ["a, b"], True), (1, None, -0.0, ["a", "b"], None), (2, "1", float("nan"), None, True),
            (None, "a", float("nan"), ["a", "b"], False)]
    df = spark.createDataFrame(rows, "i int, s string, d double, l array<string>, `b.c` boolean")
    want = [(1, "i", "int", 1, 2), (2, "s", "string", 1, 2), (3, "d", "double", 0, 2), (4, "l", "array<string>", 1, 2),
            (5, "b.c", "boolean", 1, 2)]
    got = [tuple(r)[:5] for r in io.data_dictionary(df).orderBy("position").collect()]
    assert got == want
    assert [tuple(r)[:5] for r in io.data_dictionary(df, exact=False).orderBy("position").collect()] == want
    for exact in (True, False):
        none = io.data_dictionary(df.limit(0), exact=exact).orderBy("position").collect()
        assert [(r.column_name, r.n_missing, r.n_distinct) for r in none] == [(n, 0, 0) for _, n, _, _, _ in want]


def test_cells_do_not_carry_their_rows(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS a", "cast(id AS string) AS s")
    plan = io.data_dictionary(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 2
