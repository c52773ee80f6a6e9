import zlib

import helpers
import numpy as np
import pytest

from lodeworks.llm import language

WORDS = {"en": "the of and to in that with was for this from which have".split(), "de": "der die und das nicht ist ein eine mit für auf wird".split(), "fr": "le la les des et une est pour dans que qui très".split()}


def corpus(spark, n=240):
    import random

    rnd = random.Random(1)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(60)), lang, 0.5, "zz"))
    rows += [(900, None, "en", 0.1, "x"), (901, "123 !?", "en", 0.1, "x"), (902, "", None, 0.1, "x"), (None, "the and of", None, 0.1, "x"), (903, "漢字 仮名 漢字", None, 0.1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus(spark).withColumn("held_out", language.held_out())
    found = language.identify(docs, language.learn(docs.filter("not held_out")))
    assert found.columns.count("score") == 1
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == 245
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if i is not None and i < 900:
            assert r["lang_pred"] == r["lang"]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (900, 901, 902))
    assert got[None]["lang_pred"] == "en" and got[903]["lang_pred"] != "und"


def test_prediction_does_not_depend_on_partitions(spark):
    docs = corpus(spark)
    learnt = language.learn(docs)
    a, b = (sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 4)) for r in language.identify(docs.repartition(n), learnt).collect()) for n in (1, 7))
    assert a == b


def plain_vector(text):
    """A text's bundle by the definition, one n-gram after another."""
    p, letters = language.Profiler(), [0]
    for c in text:
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or letters[-1]:
            letters.append(code)
    if letters[-1]:
        letters.append(0)
    out = np.zeros(p.dimension)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        out += np.roll(p.letter(a), 2).astype(float) * np.roll(p.letter(b), 1) * p.letter(c)
    return out / max(np.linalg.norm(out), 1e-9)


ODD = ["a", "The cat, the CAT.", "漢字 仮名 漢字", "Ünïcödé straße İstanbul", "", "1 2", "x" * 5000, "ab " * 3000, "привет мир", "a" + chr(0x20000)]


def test_vectors_are_bound_permuted_and_bundled():
    got = language.Profiler().unit(ODD)
    for text, own in zip(ODD, got):
        assert np.allclose(own, plain_vector(text), atol=1e-5), text
    assert not got[4].any() and not got[5].any()


def test_many_distinct_ngrams_in_slices(monkeypatch):
    texts = ["".join(chr(0x4E00 + i * 7 % 9000 + k) for i in range(400)) for k in range(3)] + ["abc def"]
    want = language.Profiler().unit(texts)
    monkeypatch.setattr(language, "_SLICE", 50)
    monkeypatch.setattr(language, "_KEPT", 160)
    assert np.allclose(language.Profiler().unit(texts), want, atol=1e-5)


@pytest.mark.parametrize("part", [1, 2, 3, 7])
def test_texts_in_parts(monkeypatch, part):
    p = language.Profiler()
    want = [p.grams(t) for t in ODD]
    monkeypatch.setattr(language, "_PART", part)
    for text, (g, n) in zip(ODD, want):
        a, b = p.grams(text)
        assert a.tolist() == g.tolist() and b.tolist() == n.tolist(), text


def test_query_against_brute_force(spark, tmp_path):
    """The registered query: prototypes and cosines by the definition, over every row."""
    from lodeworks.llm.queries import QUERIES

    docs = corpus(spark, 60).drop("lang_pred")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    held = {r["doc_id"]: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    sums = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and not held[r["doc_id"]]:
            sums[r["lang"]] = sums.get(r["lang"], 0) + plain_vector(r["text"])
    sums = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    for r in rows:
        own = plain_vector(r["text"] or "")
        cosines = {k: float(own @ v) for k, v in sums.items()}
        best = max(sorted(cosines), key=cosines.get) if own.any() else "und"
        want = max(0.0, cosines[best]) if own.any() else 0.0
        assert got[r["doc_id"]]["held_out"] == held[r["doc_id"]]
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - want) < 1e-3


def test_repeated_ids_are_sampled_by_text(spark):
    rows = [(None if i % 2 else 7, f"{' '.join(WORDS['en' if i % 3 else 'de'])} n{i} {chr(97 + i % 26) * 3}", "en" if i % 3 else "de") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(docs, rows=200).languages == ["de", "en"]


def test_least_score_and_lead(spark, monkeypatch):
    docs = corpus(spark, 120)
    learnt = language.learn(docs.filter(~language.held_out()))
    assert language.least_score(docs.filter(language.held_out()), learnt) == 0  # too few rows
    monkeypatch.setattr(language, "LEAST_HELD", 10)
    least = language.least_score(docs.filter(language.held_out()), learnt)
    scores = sorted(r["score"] for r in language.identify(docs.filter(language.held_out() & docs.lang.isNotNull() & docs.text.isNotNull()), learnt).collect() if r["lang_pred"] != "und")
    assert scores[0] <= least <= scores[1]
    assert language.least_score(docs.filter("false"), learnt) == 0
    rows = language.identify(docs, learnt).collect()
    assert all(0 <= r["lead"] <= r["score"] for r in rows)


@pytest.mark.parametrize("table", [helpers.empty, helpers.awkward])
def test_nothing_learnt(spark, table):
    docs = table(spark)
    got = language.identify(docs, language.learn(docs.filter("false"))).collect()
    assert len(got) == docs.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got)
