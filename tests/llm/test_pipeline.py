import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm import test_jaccard, test_quality, test_templates, test_wavelet


def test_stages_against_brute_force(spark, small):
    sf_dir = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in small.collect()}
    stage = dict(P.STAGES)

    sound = stage["quality rules"](spark, small, sf_dir)
    verdict = test_quality.verdicts([(r.text, r.lang) for r in rows.values()])
    want = {d for d, v in zip(rows, verdict) if v[6]}
    assert {r.doc_id for r in sound.collect()} == want and sound.columns == small.columns

    alone = stage["n-gram Jaccard join"](spark, sound, sf_dir)
    want = {c for _, _, c in test_jaccard.brute([(d, rows[d].text) for d in sorted(want)])}
    assert {r.doc_id for r in alone.collect()} == want and alone.columns == small.columns

    clean = stage["benchmark decontamination"](spark, alone, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want -= {d for d, _ in test_templates.brute([(d, rows[d].text) for d in want], items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == small.columns

    mixed = stage["mixing sources"](spark, clean, sf_dir)
    taken = sorted(r.doc_id for r in mixed.collect())
    assert mixed.columns == small.columns and set(taken) <= want
    assert max(map(taken.count, taken)) <= 3
    report = {r.doc_id: r.taken for r in P.pareto.mix_report(clean).collect()}
    assert {d: n for d, n in report.items() if n} == {d: taken.count(d) * len(rows[d].text.split()) for d in set(taken)}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    got = sorted((tuple(r) for r in P.run(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == test_wavelet.brute([(d, rows[d].text) for d in taken], encode)


def test_hard_rows(spark, hard, none):
    for docs in (hard, none):
        for k, (_, stage) in enumerate(P.STAGES[:-1]):
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == hard.columns
        assert P.to_tokens(spark, docs, "").count() == docs.count()


def test_one_stays_of_repeated_rows(spark, hard):
    kept = P.drop_near_copies(spark, hard, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 7, 8, 9], key=str)
