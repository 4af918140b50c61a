import random

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import ordinal as O


def made(seed, n):
    """Texts of which the marks, not the length, decide the grade."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grade = rng.randrange(3)
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        marks = {0: ["awful", "nasty"], 1: ["dull", "plain"], 2: ["bright", "clear"]}[grade]
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(marks)
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades():
    train, test = made(1, 900), made(2, 300)
    features = lambda rows: list(O.text_features(pa.array([t for _, t, _ in rows])))
    model = O.fit_arrays(features(train), np.array([g for *_, g in train]), 3)
    p = model.tails(pa.array([t for _, t, _ in test]))
    assert (p[:, 0] >= p[:, 1]).all() and model.thresholds[0] <= model.thresholds[1]
    guess = (p >= 0.5).sum(axis=1)
    assert np.mean(guess == np.array([g for *_, g in test])) > 0.9


def test_features_are_words_and_beginnings_of_each_text():
    one = list(O.text_features(pa.array(["", "Trash, trash!", "abcdefg abcdefx", "a"])))
    assert [len(x) for x in one] == [0, 3, 3, 1]
    alone = [list(O.text_features(pa.array([t])))[0] for t in ["", "Trash, trash!", "abcdefg abcdefx", "a"]]
    assert all((a == b).all() for a, b in zip(one, alone))


def test_in_spark_with_bounded_sample(spark):
    train, test = made(3, 700), made(4, 200)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = O.fit_grades(frame(train), 3, sample=400)
    again = O.fit_grades(frame(train).repartition(5), 3, sample=400)
    assert (model.weights == again.weights).all()
    got = {r.doc_id: r for r in O.score_grades(frame(test), model).collect()}
    assert np.mean([round(got[i].expected_grade) == g for i, _, g in test]) > 0.8
    assert all(abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 and r.kept == (r.p_ge_2 >= 0.5) for r in got.values())


def test_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    graded = O.grade_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert graded[graded.toxic == 1].kept.mean() < 0.1
    assert graded[(graded.toxic == 0) & (graded.quality == 1)].kept.mean() > 0.95


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (8, 1, None), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = O.grade_documents(hard, labels)
    assert got.count() == hard.count() and got.where("expected_grade is null or kept is null").count() == 0
    assert O.grade_documents(none, labels.limit(0)).count() == 0
    with pytest.raises(ValueError):
        O.grade_documents(hard, labels.limit(0)).count()
