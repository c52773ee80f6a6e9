import helpers
import numpy as np
import pytest

from lodeworks.llm import toxicity


def corpus(spark, n=400):
    import random

    rnd = random.Random(4)
    plain, bad = [f"word{i}" for i in range(80)], ["scoundrel", "nitwit", "dunce", "vermin"]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + i % 15):
                w[rnd.randrange(60)] = rnd.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_severity_is_found_and_clean_text_left_alone(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == toxicity.GRADES - 1
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 2]
    assert not any(got[i]["toxic"] for i in held if i % 5)
    assert all(got[i]["toxic"] for i in held if i % 5 == 0 and i % 15 >= 3)
    mild, severe = ([got[i]["expected_severity"] for i in held if i % 5 == 0 and ok(i % 15)] for ok in (lambda k: k < 3, lambda k: k > 9))
    assert np.mean(severe) > np.mean(mild)


def test_gradient_reaches_the_likelihoods_maximum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(3000)
    grades = (x + rng.logistic(size=3000) * 0.5 > np.array([[0.0], [1.0]])).sum(axis=0)
    rows = [(np.array([0]), np.array([v])) for v in x]
    w, cuts = toxicity.fit_ordinal(rows, grades, 1, rounds=1500)
    assert w[0] == pytest.approx(2.0, abs=0.2) and cuts == pytest.approx([0.0, 2.0], abs=0.2)


def test_odd_rows_and_empty_tables(spark):
    docs, labels = corpus(spark, 60)
    model = toxicity.train(docs.unionAll(spark.createDataFrame([(None, "x"), (7, None)], docs.schema)), labels.unionAll(spark.createDataFrame([(None, 1, 1), (3, 0, None), (999, 1, 1), (0, 1, 1)], labels.schema)))
    got = toxicity.score(helpers.awkward(spark), model).collect()
    assert len(got) == 19 and all(0 <= r["expected_severity"] <= 3 for r in got)
    assert toxicity.score(helpers.empty(spark), model).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert not any(r["toxic"] for r in toxicity.score(docs, none).collect())


def plain_score(text, model):
    """Probabilities, expected severity and grade by the definition, word after word."""
    import collections
    import math
    import re

    words = re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", (text or "").lower()).split()
    at = {w: i for i, w in enumerate(model.words)}
    x = sum(model.weights[at[w]] * (1 + math.log(n)) for w, n in collections.Counter(words).items() if w in at)
    over = [1 / (1 + math.exp(min(500, max(-500, c - x)))) for c in model.cuts]
    each = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
    return sum(over), max(range(len(each)), key=lambda k: (each[k], -k)), over[0] >= 0.5


def test_query_against_brute_force(spark, tmp_path):
    from lodeworks.llm.queries import QUERIES

    docs, labels = corpus(spark, 200)
    odd = [(900, None), (901, ""), (902, "scoundrel " * 3000), (903, "x" * 100_000), (None, "dunce nitwit vermin dunce"), (5, "word1 word2")]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op3_toxicity"](spark, str(tmp_path)).collect()
    model = toxicity.train(docs, labels)
    want = [(i, *plain_score(t, model)) for i, t in docs.collect()]
    assert len(got) == len(want) == 206

    def key(row):
        return str(row[0]), round(row[1], 6)

    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2:] == b[2:]


def test_ids_of_any_type_and_repeated_ids_stay_within_the_bound(spark):
    rows = [("same", f"word{i} word{i + 1} other{i}") for i in range(9000)] + [("same", "scoundrel")] * 50
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([("same", 1, 0), ("same", 1, 1)], "doc_id string, quality int, toxic int")
    picked = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100)
    assert picked.count() == 9001 and {r["label"] for r in picked.collect()} == {1}
    assert 40 < toxicity.bounded(picked, 100).count() < 200
    assert toxicity.score(docs, toxicity.train(docs, labels, rows=100)).count() == len(rows)
