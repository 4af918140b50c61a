import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from furrow.llm import pareto as P

SCHEMA = "doc_id long, text string, source string"


def by_sql(rows, spark):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", table)
    return Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in con.sql(P.MIX_SQL).fetchall())


def ours(rows, spark):
    got = P.mix_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("doc_id", "size", "source_size", "target", "taken")
    return Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in got.collect())


def words(rng, n):
    return " ".join(f"w{rng.randrange(9999)}" for _ in range(n))


def corpus(kind):
    rng = random.Random(3)
    ids = {
        "unique": lambda i: i,
        "null": lambda i: None,
        "repeated": lambda i: i // 40,
        "copies": lambda i: None if i % 2 else 7,
    }[kind]
    one = words(rng, 13)
    text = (lambda: one) if kind == "copies" else (lambda: words(rng, rng.randrange(0, 30)))
    sources = ["a"] * 20 + ["b"] * 6 + [None] * 3 + ["c"]
    return [(ids(i), text(), rng.choice(sources)) for i in range(400)]


@pytest.mark.parametrize("kind", ["unique", "null", "repeated", "copies"])
def test_equals_sql_and_comes_near_the_targets(spark, kind):
    rows = corpus(kind)
    got = ours(rows, spark)
    assert got == by_sql(rows, spark) == ours(rows, spark)
    largest = max(k[1] for k in got)
    targets = {(k[2], k[3]) for k in got}
    assert len(targets) == 4
    for size, target in targets:
        taken = sum(k[4] * n for k, n in got.items() if (k[2], k[3]) == (size, target))
        assert abs(taken - target) <= largest / 2 + 1e-6
    assert all(k[4] <= 3 * k[1] for k in got)


@pytest.mark.parametrize("kind", ["null", "copies"])
def test_mixture_holds_what_the_report_says(spark, kind):
    docs = spark.createDataFrame([(*r, "own") for r in corpus(kind)], SCHEMA + ", __size string")
    mixed = P.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    sized = P.sizes(docs)
    report = P.with_copies(sized, P.mix_plan(sized), P.F.col("size")).collect()
    said = Counter()
    for r in report:
        said[r.source] += r["size"] * r.copies
    assert taken == said


def test_hard_rows(hard, none):
    report = P.mix_report(hard)
    assert report.count() == hard.count() and P.mix_report(none).count() == 0
    assert {r.taken for r in report.where("doc_id in (2, 3, 4)").collect()} == {0}
    assert P.mixed_documents(hard).columns == hard.columns
