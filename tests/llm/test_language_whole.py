import numpy as np

from lodeworks.llm import language


def test_every_labelled_row_counts(spark):
    """More rows than were once sampled: each of the rare languages has one row, and each odd text is a low score."""
    odd = [" ".join(chr(97 + (i * 7 + k * k) % 26) for k in range(i % 9 + 2)) + " the of and" for i in range(60)]
    rows = [(i, "the of and to in", "en") for i in range(24_000)] + [(50_000 + i, x, f"l{i:02d}") for i, x in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(docs).languages == ["en", *(f"l{i:02d}" for i in range(60))]
    learnt = language.learn(docs.filter("lang = 'en'"))
    scores = [r[0] for r in language.identify(docs, learnt, keep=[]).select("score").collect()]
    assert abs(language.least_score(docs, learnt) - np.quantile(scores, language.REJECT_SHARE)) < 1e-6
