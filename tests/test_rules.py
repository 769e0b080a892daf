"""Literal fixtures for the NULL rules N1-N14, quirks, and skew-safe plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kohort.functions import dates as D
from kohort.functions import nulls as N
from kohort.functions import recode as R
from kohort.functions import rowwise as RW
from kohort.operators import aggregate as agg
from kohort.operators import columns as C
from kohort.operators import dedup
from kohort.operators import joins as J


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_n1_if_else_null_propagates(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    out = df.select(N.if_else(F.col("x") == 1, "Si", "No").alias("y"))
    assert sorted(rows(out, "y"), key=str) == sorted([("Si",), ("No",), (None,)], key=str)


def test_n2_missing_branch(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    out = df.select("x", N.if_else_missing(F.col("x") == 1, 1, 0, 0).alias("y"))
    assert dict(rows(out, "x", "y")) == {1: 1, 0: 0, None: 0}


def test_n4_case_without_default_is_null(spark):
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    out = df.select("x", R.case_map([(F.col("x") == "a", "A")]).alias("y"))
    assert dict(rows(out, "x", "y")) == {"a": "A", "z": None}


def test_n5_n6_regex_and_membership_on_null(spark):
    df = spark.createDataFrame([("metas",), ("x",), (None,)], "x string")
    out = df.select("x", N.rlike_or_false("x", "met").alias("r"), N.isin_or_false("x", ["x"]).alias("m"))
    assert {r[0]: (r[1], r[2]) for r in rows(out, "x", "r", "m")} == {
        "metas": (True, False), "x": (False, True), None: (False, False)}


def test_n8_kleene_severity(spark):
    df = spark.createDataFrame([(True, None), (False, None), (False, False)], "a boolean, b boolean")
    out = df.select(R.severity([F.col("a"), F.col("b")]).alias("s"))
    assert sorted(rows(out, "s"), key=str) == sorted([("Grave",), (None,), ("Leve",)], key=str)


def test_n9_nulls_last_both_directions(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (1, 5)], "k int, v int")
    asc = dedup.row_number_col(df, ["k"], ["v"], "n")
    desc = dedup.row_number_col(df, ["k"], [("v", "desc")], "n")
    assert dict(rows(asc, "v", "n")) == {2: 1, 5: 2, None: 3}
    assert dict(rows(desc, "v", "n")) == {5: 1, 2: 2, None: 3}


def test_n10_join_null_matches_null(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert sorted(rows(J.natural_join(a, b, "inner"), "a", "b")) == [(1, 10), (2, 20)]


def test_n11_strict_max(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "k int, v int")
    out = df.groupBy("k").agg(N.strict_max("v").alias("m"))
    assert dict(rows(out, "k", "m")) == {1: None, 2: 3}


def test_n13_floor_division(spark):
    df = spark.createDataFrame([(-7,)], "a int")
    assert df.select(N.floor_div("a", F.lit(2)).alias("q")).collect()[0]["q"] == -4


def test_n14_first_keeps_null_value(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b")], "k int, o int, v string")
    out = agg.collapse_multi(df, ["k"], ["v"], ["o"])
    r = out.collect()[0]
    assert r["v_1"] is None and r["v_2"] == "b" and r["n_records"] == 2


def test_age_bands_literal(spark):
    ages = [None, 17, 18, 39, 40, 79, 80, 101]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = dict(rows(df.select("age", R.age_bands("age").alias("b")), "age", "b"))
    assert got == {None: None, 17: None, 18: "18-39", 39: "18-39", 40: "40-59", 79: "60-79",
                   80: "80+", 101: "80+"}


def test_serial_dates(spark):
    df = spark.createDataFrame([("43893",), ("2020-03-03",), ("N/D",), ("1e20",), ("NaN",)], "x string")
    got = [r["d"] for r in df.select(R.to_date_lenient("x").alias("d")).collect()]
    assert got == [dt.date(2020, 3, 3), dt.date(2020, 3, 3), None, None, None]


def test_days_and_years(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 3), dt.date(2020, 12, 31))], "a date, b date")
    r = df.select(D.days_between("a", "b").alias("d"), D.years_between("a", "b").alias("y")).collect()[0]
    assert r["d"] == 303 and r["y"] == 0


def test_row_sum_and_any(spark):
    df = spark.createDataFrame([(1, None, 0), (None, None, None), (0, 0, 0)], "a int, b int, c int")
    got = rows(df.select(RW.row_sum(["a", "b", "c"]).alias("s"), RW.row_any(["a", "b", "c"]).alias("y")), "s", "y")
    assert got == [(1, 1), (None, None), (0, 0)]


def test_q4_fractional_count_band_is_unknown(spark):
    df = spark.createDataFrame([(1.5,), (2.0,)], "n double")
    got = [r["b"] for r in df.select(R.count_bands("n", ("0", "1", "2", ">2"), "unknown").alias("b")).collect()]
    assert got == ["unknown", "2"]


def test_clean_names():
    assert C.clean_name_list(["Order Key", "custKey", "Estado Ñandú", "Total %", "2nd", "order key"]) == [
        "order_key", "cust_key", "estado_nandu", "total_percent", "x2nd", "order_key_2"]


def test_rename_missing_column_raises(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError):
        C.rename(df, {"b": "nope"})


def test_deidentify_refuses_identifiers(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    with pytest.raises(ValueError):
        C.final_projection(df, ["id", "name"], identifiers=["name"])


def test_row_number_hot_key_matches_window(spark):
    """A key with most rows, NULL order values and ties broken by id: the
    bucketed numbering equals a plain window's, with many buckets."""
    from pyspark.sql import Window
    data = [(0 if i % 3 else i % 7, None if i % 11 == 0 else (i * 7919) % 97, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, v int, id int")
    got = dedup.row_number_col(df, ["k"], [("v", "desc"), "id"], "n", n_ranges=37)
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), F.col("id").asc_nulls_last())
    want = df.withColumn("n", F.row_number().over(w))
    assert sorted(rows(got, "k", "id", "n")) == sorted(rows(want, "k", "id", "n"))


def test_first_per_key_is_aggregate_and_keeps_whole_row(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, None, "z"), (2, 5, "e")], "k int, o int, v string")
    out = dedup.first_per_key(df, ["k"], ["o"])
    assert sorted(rows(out, "k", "o", "v")) == [(1, 1, "a"), (2, 5, "e")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_cohort_report_runs_end_to_end(spark, sf_dir):
    from kohort.plans import pipelines as P
    rep = P.cohort_report(spark, sf_dir)
    assert rep["km_groupings"].count() > 0
    assert rep["levels_tumour_type"].orderBy("ord").first()["level"] == "Sólido"
    assert rep["levels_code_group"].orderBy("ord").collect()[-1]["level"] == "other"
    assoc = {r["variable"]: r for r in rep["association"].collect()}
    assert set(assoc) == {"age_cat", "tumour_type", "severity", "com_band", "age", "ecog_num"}
    assert assoc["age"]["test"] == "rank_sum"
    coefs = rep["cox_coefficients"].collect()
    assert {r["variable"] for r in coefs} == {"treat_class", "age_cat"}
    n_age = sum(1 for r in coefs if r["variable"] == "age_cat")
    assert rep["cox_nested_test"].collect()[0]["df"] == n_age
    lr = rep["logrank"].collect()
    assert {r["variable"] for r in lr} <= set(P.REPORT_GROUPINGS)
    s = rep["cox_martingale"].agg(F.sum("residual")).collect()[0][0]
    assert abs(s) < 1e-6


def test_cox_degenerate_data_does_not_fail(spark):
    from kohort.operators import cox as CX
    df = spark.createDataFrame([(i, 5, 0, "a" if i % 2 else "b") for i in range(10)],
                               "id int, t int, e int, g string")
    fit = CX.coxph(df, "t", "e", ["g"])
    assert fit.n_events == 0 and fit.beta[0] == 0.0


def _scans(df, path_part):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return final.count(path_part)


def test_statistics_scan_input_once(spark, sf_dir):
    """Operators that branch on an aggregate read the base table once (in
    the checkpoint job); the final plan only reads the checkpoint."""
    from kohort.operators import assoc as A
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert _scans(SM_exact(li), "lineitem.parquet") == 0
    assert _scans(A.rank_sum_test(li, ["l_quantity"], "l_linestatus"), "lineitem.parquet") == 0
    assert _scans(A.chi2_test(li, ["l_returnflag"], "l_linestatus"), "lineitem.parquet") == 0


def SM_exact(li):
    from kohort.operators import summary as SM
    return SM.exact_quantiles(li, ["l_quantity", "l_discount"])


def test_row_number_text_key_hot_key_matches_window(spark):
    from pyspark.sql import Window
    words = ["alpha", "alp", "beta", "b", "", "zeta", "ñu", "alphabet", None, "Zed"]
    data = [(0 if i % 4 else 1, words[i % len(words)], i) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, s string, id int")
    for how in ("asc", "desc"):
        got = dedup.row_number_col(df, ["k"], [("s", how), "id"], "n", n_ranges=20)
        o = F.col("s").desc_nulls_last() if how == "desc" else F.col("s").asc_nulls_last()
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(o, F.col("id"))))
        assert sorted(rows(got, "k", "id", "n")) == sorted(rows(want, "k", "id", "n"))


def test_read_table_csv_tokens_and_parts(spark, tmp_path):
    from kohort.sources import io
    raw = tmp_path / "registry.csv"
    raw.write_text("Id Pte,Fecha Apertura,ECOG,Comorb. Cardio\n"
                   "1,43893,1 - ok,1\n2,N/D,Desconocido,999\n3,2020-03-03,NA,0\n", encoding="utf-8")
    df = C.clean_names(io.read_table(spark, str(raw), "csv", io.NA_TOKENS_V1))
    assert df.columns == ["id_pte", "fecha_apertura", "ecog", "comorb_cardio"]
    got = {r["id_pte"]: r for r in df.collect()}
    assert got["2"]["fecha_apertura"] is None and got["2"]["ecog"] is None and got["2"]["comorb_cardio"] is None
    assert got["3"]["ecog"] is None and got["1"]["ecog"] == "1 - ok"
    dates = {r["id_pte"]: r["d"] for r in df.select("id_pte", R.to_date_lenient("fecha_apertura").alias("d")).collect()}
    assert dates == {"1": dt.date(2020, 3, 3), "2": None, "3": dt.date(2020, 3, 3)}
    # a two-part source, one directory per part
    for part in (1, 2):
        spark.createDataFrame([(part, "x")], "k int, v string").write.parquet(str(tmp_path / "src" / str(part)))
    assert io.read_dataset(spark, str(tmp_path / "src"), 2).collect()[0]["k"] == 2
    # round trip keeps types and NULLs
    out = io.write_clean(df.withColumn("d", R.to_date_lenient("fecha_apertura")), str(tmp_path / "clean"))
    back = io.read_clean(spark, out)
    assert dict(back.dtypes)["d"] == "date" and back.filter(F.col("d").isNull()).count() == 1


def test_odd_column_names_in_generated_sql(spark):
    from kohort.sources import io
    from kohort.operators import summary as SM
    df = spark.createDataFrame([(1, None), (None, "x")], "`it's` int, `a.b` string")
    dd = {r["column_name"]: r for r in io.data_dictionary(df).collect()}
    assert dd["it's"]["n_missing"] == 1 and dd["a.b"]["n_distinct"] == 1
    assert {r["variable"] for r in SM.na_pareto(df).collect()} == {"it's", "a.b"}


def test_value_counts_sorted_by_level_desc(spark):
    from kohort.operators import aggregate as agg
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "x string")
    assert [r["level"] for r in agg.value_counts(df, "x", sort="level_desc").collect()] == ["c", "b", "a"]


def test_title_case_modes(spark):
    df = spark.createDataFrame([("ñandú-x rojo",), ("ABC def",), ("",), (None,)], "s string")
    got = [(r["a"], r["b"]) for r in df.select(R.title_case("s").alias("a"),
                                               R.title_case("s", "nonletter").alias("b")).collect()]
    assert got == [("Ñandú-x Rojo", "Ñandú-X Rojo"), ("Abc Def", "Abc Def"), ("", ""), (None, None)]


def test_results_independent_of_input_partitioning(spark, sf_dir):
    """Same rows with 1 and 7 input partitions (survey invariant)."""
    from kohort.operators import summary as SM
    from kohort.operators import survival as S
    from kohort.plans import fixtures as fx
    rec = fx.fx_rec(spark, sf_dir)
    sess = fx.fx_sess(spark, sf_dir)

    def ops(r, s_):
        return {
            "collapse": agg.collapse_multi(r, ["subject_id"], ["code", "morph"], ["dx_date", "record_id"],
                                           strict_max_cols=["ecog"]),
            "first": dedup.first_per_key(r, ["subject_id"], ["dx_date", "record_id"]),
            "rownum": dedup.row_number_col(r, ["subject_id"], [("ecog", "desc"), "record_id"], "n",
                                           n_ranges=5),
            "quant": SM.exact_quantiles(s_, ["age"], (0.25, 0.5, 0.75), n_buckets=7),
            "km": S.kaplan_meier(s_.withColumn("e", (F.col("age") > 25).cast("int")), "l_linenumber", "e",
                                 n_buckets=3),
        }

    def canon(df):
        return sorted(tuple("" if v is None else str(round(v, 9) if isinstance(v, float) else v) for v in r)
                      for r in df.collect())
    one = ops(rec.repartition(1), sess.repartition(1))
    seven = ops(rec.repartition(7), sess.repartition(7))
    for k in one:
        assert canon(one[k]) == canon(seven[k]), k


def test_degenerate_inputs_give_null_not_errors(spark):
    from kohort.operators import assoc as A
    from kohort.operators import summary as SM
    empty = spark.createDataFrame([], "x int, y string")
    assert SM.na_pareto(empty, only_na=False).collect()[0]["ratio"] is None
    full = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert all(r["cumulative"] is None for r in SM.na_pareto(full, only_na=False).collect())
    ties = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("a", 1.0)], "g string, v double")
    r = A.rank_sum_test(ties, ["v"], "g").collect()[0]
    assert r["z"] is None and r["p_value"] is None
    one = spark.createDataFrame([("a", 2.0)], "g string, v double")
    assert A.rank_sum_test(one, ["v"], "g").collect()[0]["z"] is None


def test_data_dictionary_persisted(spark, tmp_path):
    from kohort.sources import io
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    dd = io.data_dictionary(df, path=str(tmp_path / "dict"))
    assert {r["column_name"]: r["n_missing"] for r in dd.collect()} == {"a": 0, "b": 1}
    assert (tmp_path / "dict").exists()


def test_clean_then_report_jobs(spark, tmp_path):
    from kohort.plans import jobs
    cohort = jobs.clean(spark, "/root/testdata/sf0.01", str(tmp_path / "cohort"))
    assert spark.read.parquet(cohort).count() > 0
    assert spark.read.parquet(str(tmp_path / "cohort_dictionary")).count() > 0
    written = jobs.report(spark, cohort, str(tmp_path / "report"))
    assert {"km_groupings", "logrank", "cox_coefficients", "association", "missing"} <= set(written)
    assert spark.read.parquet(written["km_groupings"]).count() > 0
    cohort2 = jobs.clean(spark, "/root/testdata/sf0.01", str(tmp_path / "cohort2"), version="v2")
    written2 = jobs.report(spark, cohort2, str(tmp_path / "report2"))
    assert {"km_delayed_entry", "association", "levels_loc_tumor"} <= set(written2)
    assert spark.read.parquet(written2["km_delayed_entry"]).count() > 0


def test_entry_from_another_directory_runs_python_tasks(tmp_path):
    """The driver may import the entry module from elsewhere: Python tasks
    (log-rank solves) must not need the package importable on workers."""
    import subprocess
    import sys as _sys
    code = (
        "import importlib.util\n"
        "spec = importlib.util.spec_from_file_location('se', '/root/repo/__spark_entry__.py')\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
        "print('ROWS', m.queries()['logrank_two_group'](s, '/root/testdata/sf0.001').count())\n")
    out = subprocess.run([_sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=300)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]


def test_collapse_takes_tied_records_whole(spark):
    from kohort.operators import aggregate as agg
    rows = [(1, 5, f"a{i}", f"b{i}", i) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, day int, x string, y string, z int").repartition(4)
    r = agg.collapse_multi(df, ["id"], ["x", "y"], ["day"], first_only=["z"]).collect()[0]
    assert r["x_1"][1:] == r["y_1"][1:] == str(r["z"]) and r["x_2"][1:] == r["y_2"][1:]
    assert r["n_records"] == 8
