"""Registered queries against their SQL on the smallest tables.

A representative set by default; FURROW_ALL=1 runs every query that has SQL.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, key, norm

SF = "/root/testdata/sf0.001"
CHOSEN = """p5_parse_decimal p17_cut_width p22_derive_variable f9_min_group_size f10_drop_flat_series j2_natural_full_join
j7_mutual_domain j10_grid j12_code_lookup a7_iqr a10_missing_share a12_boxplot_stats a14_density_grid r3_feature_wide r4_nest_unnest
s1_read_tagged s3_read_decimal_comma t1_expand_seasons t3_fit_diagnostics t4_best_poly t5_loess_trend t9_mean_anomaly t10_rebase_after
t12_normalise_by_reference t13_join_panel m0_gram_many_features m3_weighted_panel_trend m4_elastic_net m6_fit_pls m7_select_ncomp
m8_tree_cross_validated m17_cv_split m18_cross_validate m19_cross_validate_pooled m23_regional_production m25_coef_table q1_gof""".split()
SQL = entry.oracle_sql()
NAMES = list(SQL) if os.environ.get("FURROW_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-5 + 1e-8 * abs(b)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=key)
    assert got, "no rows"
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(close(a, b) for a, b in zip(g, w)), (g, w)


def test_registry():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
