import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import sketches as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(*values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(data, seed=h % 2**64)
    return signed(h)


def hashes(text):
    words = [xx(w) for w in WORD.findall(text)]
    if not words:
        return set()
    if len(words) < 5:
        h = xx("few")
        for w in words:
            h = xx(h, w)
        return {h}
    return {xx(*words[i : i + 5]) for i in range(len(words) - 4)}


def brute_sketch(text, k):
    return sorted(hashes(text))[:k]


def brute_near(a, b, k):
    u = sorted(set(a) | set(b))[:k]
    return len(set(a) & set(b) & set(u)) / len(u) if u else 1.0


def brute(rows, k=K.K):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), xx(r[1])))
    out = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, e, n = (brute_sketch(x, k) for x in (t, edited, after))
        text = lambda s: "".join(f"{x % 2**64:016x}" for x in s).upper()
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(e), brute_near(own, e, k), brute_near(own, n, k)))
    return sorted(out, key=str)


def shown(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def made(n, seed=3):
    rng = random.Random(seed)
    return [(i * 7 % 1009, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 400)))) for i in range(n)]


def test_query_against_brute_force(spark):
    from furrow.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert shown(QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 9, 150])
def test_small_tables_any_partitions(spark, n):
    rows = made(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(K.fingerprints(docs.repartition(5))) == brute(rows) == shown(K.fingerprints(docs.coalesce(1)))


def test_repeated_and_null_ids(spark):
    """A third of the rows has no id, another third one id; texts repeat among them."""
    rng = random.Random(9)
    pool = [t for _, t in made(40, seed=4)]
    rows = [(rng.choice([None, 5, rng.randrange(1000)]), rng.choice([*pool, None, ""])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert shown(K.fingerprints(docs)) == brute(rows)


def test_hard_rows(hard, none):
    assert shown(K.fingerprints(hard)) == brute([(r.doc_id, r.text) for r in hard.collect()])
    assert K.fingerprints(none).collect() == []


def test_extreme_ids(spark):
    rows = [(2**63 - 1, "a b c"), (-(2**63), "d e f g h i"), (0, "x"), (-1, "y z")]
    assert shown(K.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_estimates(spark):
    """Within four standard errors of the truth for sets far larger than the sketch."""
    words = [f"t{i}" for i in range(9000)]
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(K.sketch(F.col("a")).alias("a"), K.sketch(F.col("b")).alias("b"))
    got = row.select(
        K.resemblance(F.col("a"), F.col("b")).alias("r"), K.containment(F.col("a"), F.col("b")).alias("c"),
        K.distinct_shingles(F.col("a")).alias("n"), K.distinct_shingles(K.merged(F.col("a"), F.col("b"))).alias("u"),
    ).first()
    assert abs(got.r - 2996 / 8996) < 4 * (0.33 * 0.67 / 128) ** 0.5
    assert abs(got.c - 0.5) < 4 * (0.25 / 64) ** 0.5
    assert abs(got.n / 5996 - 1) < 4 / 126**0.5 and abs(got.u / 8996 - 1) < 4 / 126**0.5


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_merged_in_rounds(spark, monkeypatch, fan):
    monkeypatch.setattr(K, "FAN", fan)
    rows = [(["hot", "cold", None][min(i % 5, 2)], t) for i, (_, t) in enumerate(made(120))]
    parts = spark.createDataFrame(rows, "part string, text string").select("part", K.sketch(F.col("text")).alias("sketch"))
    got = {r["part"]: (r["sketch"], r["parts"]) for r in K.merge_sketches(parts, ["part"]).collect()}
    for key in {p for p, _ in rows}:
        union = set().union(*[hashes(t) for p, t in rows if p == key])
        assert got[key] == (sorted(union)[: K.K], sum(p == key for p, _ in rows))
    assert K.merge_sketches(parts.limit(0), ["part"]).collect() == []


def test_text_moves_once_and_natively(spark, small):
    plan = K.fingerprints(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Pandas" not in plan
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2
