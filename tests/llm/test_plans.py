"""What the plans of the filtering and mixing stages evaluate, and how often."""

from furrow.llm import pareto, quality


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_verdict_is_evaluated_once(small):
    plan = optimised(quality.sound_documents(small))
    assert plan.count("scalar-subquery") <= 1 and plan.lower().count("log2") <= 32


def test_words_are_counted_once(small):
    assert optimised(pareto.mixed_documents(small)).count("regexp_count") <= 1
