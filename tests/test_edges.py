"""Nulls, ties, hot groups, empty inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.functions import filters as FL
from furrow.functions.keys import attach, null_safe_join
from furrow.operators import aggregates as A
from furrow.operators import joins as J
from furrow.operators import quantiles as Q
from furrow.operators import reshape as R
from furrow.operators.loess import loess_trend
from furrow.operators.scenario import normalise_by_reference, rebase_after, scenario_difference
from furrow.operators.seasons import SEASONS, expand_seasons, join_panel
from furrow.operators.trend import anomalies, poly_trend, polynomial_trends
from furrow.operators.validate import FOUR_FOLDS, block_folds, cv_split, mix_scenarios
from furrow.session import configure
from furrow.sources import delimited as IO


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert set(rows(null_safe_join(a, b, ["k"], "full"))) == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}
    assert rows(null_safe_join(a, b, ["k"], "left_anti")) == [("x", 2)]
    left, right = J.mutual_domain(a, b, ["k"])
    assert rows(left) == [(None, 1)] and rows(right) == [(None, 3)]


def test_attach_without_keys_plans_no_join(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2.0)
    out = attach(df, df.agg(F.avg("v").alias("m")), [])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["m"] for r in out.collect()} == {9.0}


@pytest.fixture
def skewed(spark):
    # one group holds most rows and many ties
    return (
        spark.range(6000)
        .select(
            F.when(F.col("id") % 4 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 16).cast("string"))).alias("k"),
            F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"),
        )
    )


@pytest.mark.parametrize("accuracy", [10_000, 200])
def test_quantiles_of_slices_and_of_whole_groups(skewed, monkeypatch, accuracy):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    got = {r["k"]: r for r in Q.group_quantiles(skewed, ["k"], "v", [0.25, 0.5, 0.9], ["a", "b", "c"]).collect()}
    pdf = skewed.toPandas()
    assert set(got) == set(pdf["k"])
    for k, part in pdf.groupby("k"):
        want = np.quantile(part["v"], [0.25, 0.5, 0.9])
        np.testing.assert_allclose([got[k]["a"], got[k]["b"], got[k]["c"]], want)
        assert got[k]["n"] == len(part)


def test_quantiles_of_whole_table_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (7.0,), (None,)], "v double")
    r = Q.group_quantiles(df, [], "v", [0.25, 0.5], ["a", "b"]).first()
    assert (r["a"], r["b"], r["n"]) == (1.75, 3.0, 4)


def test_quantiles_with_far_values_and_nan(spark, monkeypatch):
    monkeypatch.setattr(Q, "ACCURACY", 500)
    df = spark.range(20_000).select(
        F.lit("g").alias("k"),
        F.when(F.col("id") == 7, 1e15).when(F.col("id") == 8, float("-inf")).when(F.col("id") < 4, float("nan"))
        .otherwise((F.col("id") * 7919 % 20_011).cast("double")).alias("v"),
    )
    got = Q.group_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9], ["a", "b", "c", "d"]).first()
    v = np.sort(df.toPandas()["v"].to_numpy())  # NaN last, as in Spark
    for name, p in (("b", 0.1), ("c", 0.5), ("d", 0.9)):
        h = p * (len(v) - 1)
        assert got[name] == pytest.approx(v[int(h)] + (h - int(h)) * (v[int(np.ceil(h))] - v[int(h)]))
    assert got["a"] == float("-inf") and got["n"] == 20_000


def test_wide_form_refuses_two_values_for_a_cell(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("b", "y", None)], "k string, n string, v double")
    with pytest.raises(Exception, match="more than one value"):
        R.to_wide(df, ["k"], "n", "v", ["x", "y"]).collect()
    assert {tuple(r) for r in R.to_wide(df.distinct(), ["k"], "n", "v", ["x", "y"]).collect()} == {("a", 1.0, None), ("b", None, None)}


def test_nest_splits_equal_rows(spark):
    nested = R.nest_group(spark.range(5000).select(F.lit("k").alias("k"), F.lit(1).alias("v")), ["k"], max_rows=500)
    assert nested.agg(F.max(F.size("data"))).first()[0] < 1000 and nested.count() == 10


def test_full_join_splits_into_two_joins(spark):
    from furrow.functions.keys import null_safe_join

    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, x string")
    b = spark.createDataFrame([(1, 10), (None, 20), (3, 30)], "k int, y int")
    got = {tuple(r) for r in null_safe_join(a, b, ["k"], "full").collect()}
    assert got == {(1, "a", 10), (None, "b", 20), (2, "c", None), (3, None, 30)}


def test_nest_splits_large_groups(skewed):
    df = skewed.withColumn("i", F.monotonically_increasing_id())
    nested = R.nest_group(df, ["k"], max_rows=500)
    assert nested.agg(F.max(F.size("data"))).first()[0] < 1000
    assert R.unnest_group(nested).count() == 6000


def test_mean_and_extremes_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 4.0), ("b", 3.0, None)], "k string, x double, y double")
    strict = {r["k"]: (r["x"], r["y"]) for r in A.group_mean_all(df, ["k"]).collect()}
    assert strict == {"a": (None, 3.0), "b": (3.0, None)}
    loose = {r["k"]: r["mean_x"] for r in A.group_moments(df, ["k"], ["x"], ("mean",)).collect()}
    assert loose == {"a": 1.0, "b": 3.0}
    got = rows(df.select(C.row_min("x", "y"), C.row_max("x", "y", skip_nulls=True)))
    assert got == [(1.0, 2.0), (None, 4.0), (None, 3.0)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("1.234,5",), ("-7",), ("n/a",), (None,)], "t string")
    assert [r[0] for r in df.select(C.parse_decimal("t")).collect()] == [1234.5, -7.0, None, None]
    parts = C.separate(spark.createDataFrame([("a_b",), ("c",)], "t string"), "t", ["x", "y"], "_")
    assert rows(parts) == [("a", "b"), ("c", None)]
    names = spark.createDataFrame([("bar_win_gs",), ("zz_zz_gs",)], "c string").select(C.recode("c", {"bar_win_gs": "barley"}, default=None))
    assert rows(names) == [("barley",), (None,)]
    assert IO.sanitise_columns(spark.createDataFrame([(1, 2, 3)], ["0<Tx<10", ".fitted", "Seq PR"])).columns == ["0_lt_Tx_lt_10", "fitted", "Seq_PR"]


def test_cuts(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.5,), (None,)], "v double")
    assert [r[0] for r in df.select(C.cut_fixed("v", [0, 1, 3])).collect()] == [None, "(0,1]", "(1,3]", None, None]
    assert [r[0] for r in df.select(C.cut_fixed("v", [0, 1, 3], include_lowest=True)).collect()][0] == "[0,1]"
    assert [r["bin"] for r in C.cut_width(df.limit(4), "v", 7).collect()] == [1, 2, 4, 7]
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r["bin"] for r in C.cut_width(same, "v", 4).collect()} == {2}


def test_feature_names():
    have = ["Tn_2", "Tn_9", "Tn_10", "Tn_10_sq", "PR"]
    assert C.feature_columns(have, ["Tn", "PR"], range(1, 13), squares=True, last_n=2) == ["Tn_9", "Tn_10", "Tn_10_sq"]
    assert C.feature_columns(have, ["PR", "RV"]) == ["PR"]


def test_flat_series_can_remove_neighbours(spark):
    df = spark.createDataFrame(
        [("a", m, float(v)) for m, vs in ((1, [1, 1, 1]), (2, [1, 2, 3])) for v in vs] + [("b", 1, 1.0), ("b", 1, 9.0)], "k string, m int, v double"
    )
    assert {(r["k"], r["m"]) for r in FL.drop_flat_series(df, ["k", "m"], "v").collect()} == {("a", 2), ("b", 1)}
    assert {(r["k"], r["m"]) for r in FL.drop_flat_series(df, ["k", "m"], "v", ["k"]).collect()} == {("b", 1)}


def test_seasons(spark):
    df = spark.createDataFrame([(1958, 7), (1958, 10), (1959, 1)], "year_cal int, month int")
    out = {(r["sp"], r["year_cal"], r["month"]): r["year_harvest"] for r in expand_seasons(df, drop_before=(1958, 8)).collect()}
    assert out[("wht_win_gs", 1958, 10)] == 1959 and out[("wht_win_gs", 1959, 1)] == 1959
    assert ("wht_win_gs", 1958, 7) not in out and out[("mai_tot_gs", 1958, 7)] == 1958
    assert ("sun_tot_gs", 1958, 10) not in out and len(SEASONS) == 16


def test_rebase_refuses_two_rows_in_a_year(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2000, 2.0), ("a", 2001, 3.0)], "k string, year int, v double")
    trend = poly_trend(df, ["k"], "year", "v")
    with pytest.raises(Exception, match="more than one row"):
        rebase_after(trend, ["k"], "year", "v", [2000]).collect()
    assert rebase_after(trend, ["k"], "year", "v", [2000], strict=False).count() == 6


def test_rebase_without_base_year_and_legacy(spark):
    df = spark.createDataFrame([("a", 2000 + i, float(i)) for i in range(5)], "k string, year int, v double")
    trend = poly_trend(df, ["k"], "year", "v")
    out = {(r["type"], r["year"]): r["value"] for r in rebase_after(trend, ["k"], "year", "v", [1990, 2002], legacy_first=True).collect()}
    assert out[("y1990", 2003)] == pytest.approx(3.0) and out[("y2002", 2004)] == pytest.approx(2.0)
    gone = {(r["type"], r["year"]): r["value"] for r in rebase_after(trend, ["k"], "year", "v", [1990]).collect()}
    assert gone[("y1990", 2003)] is None
    diff = scenario_difference(rebase_after(trend, ["k"], "year", "v", [2002]), ["k", "year"])
    assert max(r["difference"] for r in diff.collect()) == pytest.approx(2.0)


def test_anomaly_with_zero_fit_and_one_row(spark):
    df = spark.createDataFrame([("z", i, 0.0) for i in range(5)] + [("one", 1, 4.0)], "k string, x int, v double")
    out = anomalies(polynomial_trends(df, ["k"], "x", "v"), ["k", "method"])
    assert out.count() == 24
    assert {r["anomaly_norm"] for r in out.where("k = 'z'").collect()} == {None}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k string, x int, v double")
    assert polynomial_trends(empty, ["k"], "x", "v").count() == 0
    assert loess_trend(empty, ["k"], "x", "v").count() == 0
    assert Q.group_quantiles(empty, ["k"], "v", [0.5], ["m"]).count() == 0
    assert A.standardise(empty, ["k"], ["v"]).count() == 0


def test_normalise_uses_reference_moments_only(spark):
    df = spark.createDataFrame([("OBS", 1.0), ("OBS", 3.0), ("y99", 100.0)], "type string, value double").withColumn("k", F.lit("a"))
    out = {r["value"]: r["value_norm"] for r in normalise_by_reference(df, ["k"]).collect()}
    assert out[100.0] == pytest.approx(98 / np.sqrt(2))


def test_folds_and_splits(spark):
    df = spark.createDataFrame([("a", y) for y in range(1990, 2010)] + [("b", 1990)], "k string, year int")
    folded = block_folds(df, "year", FOUR_FOLDS)
    per_year = folded.groupBy("year").agg(F.countDistinct("fold").alias("n"))
    assert per_year.agg(F.max("n")).first()[0] == 1
    split = cv_split(folded, "fold", ["k"], ["Y1", "Y2", "Y3", "Y4"])
    assert {r["k"] for r in split.collect()} == {"a"}
    assert split.where("role = 'val'").count() == 20 and split.where("role = 'cal'").count() == 60


def test_mixed_scenario(spark):
    df = spark.createDataFrame([("k", "T", "OBS", 1.0), ("k", "T", "y82", 2.0), ("k", "P", "OBS", 3.0)], "k string, clim_var string, type string, value double")
    r = mix_scenarios(df, ["k"], {"T": {"type": "y82"}, "P": {"type": "OBS"}}, label="mix").first()
    assert (r["T"], r["P"], r["type"]) == (2.0, 3.0, "mix")


def test_join_panel_cleans_keys(spark):
    w = spark.createDataFrame([("cote_d'or", "wht_win_gs", 2000, 1.0)], "departement string, sp string, year_harvest int, Tn double")
    y = spark.createDataFrame([("COTE-D-OR", "wheat_winter", 2000, 5.0)], "departement string, sp string, year_harvest int, yield double")
    assert rows(join_panel(w, y)) == [("COTE-D-OR", "wheat_winter", 2000, 1.0, 5.0)]


def test_grid_and_natural_join(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert sorted(rows(J.grid(df, ["k", "n"]))) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    with pytest.raises(ValueError):
        J.natural_full_join(df, df.toDF("x", "y"))


def test_named_files(spark, tmp_path):
    for name, value in (("yield_wheat_1900-2016.txt", "1,5"), ("yield_maize_1900-2016.txt", "NA")):
        (tmp_path / name).write_text(f"department;year;yield\nAIN;1950;{value}\n")
    out = IO.read_tagged(spark, f"{tmp_path}/*16.txt", "department string, year int, yield double", "sp", "yield_(.*)_1900", decimal=",")
    assert sorted(rows(out.select("sp", "yield")), key=str) == [("maize", None), ("wheat", 1.5)]


def test_by_key_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    IO.write_by_key(df, f"{tmp_path}/t", ["k"])
    back = IO.read_partition(spark, f"{tmp_path}/t", "k", "b")
    assert sorted(r["v"] for r in back.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(k" in back._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_split_when_values_are_joined_back(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = spark.range(0, 90_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), (F.col("id") * 1.5).alias("v")
        )
        # grouped again by the same key: the split must survive the next aggregate
        out = A.standardise(df, ["k"], ["v"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert out.agg(F.max("n"), F.sum("n")).first() == (30_000, 90_000)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_nesting_does_not_depend_on_partitions(spark):
    from furrow.operators.reshape import nest_group, unnest_group

    rows = [("a" if i % 4 else None, i % 50, None if i % 7 == 0 else f"v{i % 90}") for i in range(3000)] + [("c", 1, "same")] * 700
    df = spark.createDataFrame(rows, "k string, x int, v string")
    parts = lambda d: sorted(map(str, nest_group(d, ["k"], max_rows=100).collect()))
    nested = parts(df.repartition(7, "x"))
    assert nested == parts(df.orderBy(F.rand(1))) == parts(df.coalesce(1))
    back = unnest_group(nest_group(df, ["k"], max_rows=100))
    assert sorted(map(str, back.select("k", "x", "v").collect())) == sorted(map(str, df.collect()))
    same = nest_group(df, ["k"], max_rows=100).where("k = 'c'").select(F.size("data").alias("n")).collect()
    assert [r.n for r in same] == [100] * 7


def _joins_run(df):
    df.collect()
    return re.findall(r"(\w+Join)(?:\(skew=true\))?\b", str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0])


def test_rows_of_a_few_groups_are_not_sorted_to_be_joined(spark, skewed):
    configure(spark)
    wide = skewed.withColumn("w", F.col("v") * 2)
    # far more partitions than groups, and rows that are not known to be few before they are read
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "8k"}
    before = {c: spark.conf.get(c) for c in changed}
    try:
        for c, v in changed.items():
            spark.conf.set(c, v)
        summary, boxes = A.summary_stats(wide, ["v", "w"]), A.boxplot_stats(wide, ["k"], "v")
        assert "BroadcastHashJoin" in summary._jdf.queryExecution().executedPlan().toString()  # before any row is moved
        got = {r["variable"]: r for r in summary.collect()}
        for df in (summary, boxes):
            joins = _joins_run(df)
            assert joins and "SortMergeJoin" not in joins
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    pdf = wide.toPandas()
    for c in ("v", "w"):
        np.testing.assert_allclose([got[c][q] for q in ("q1", "median", "q3")], np.quantile(pdf[c], [0.25, 0.5, 0.75]))
