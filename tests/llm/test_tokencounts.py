import collections

import helpers
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import queries, tokencounts
from lodeworks.llm.wordtokens import default_vocabulary

SCHEMA = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_signed_batches_apply_once(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "t/1", 10, None), ("insert", "a", "en", "t/1", 5, None), ("insert", None, None, "t/1", None, None)], SCHEMA)
    more = spark.createDataFrame([("revise", "a", "en", "t/1", 7, 5), ("delete", "a", "en", "t/1", 10, None), ("insert", "b", "de", "t/2", 3, None)], SCHEMA)
    assert rollup.commit("day 1/a", first) and rollup.commit("day 2", more)
    assert not rollup.commit("day 1/a", first) and not rollup.commit("day 2", first)
    want = {("a", "en", "t/1", 1, 7), (None, None, "t/1", 1, 0), ("b", "de", "t/2", 1, 3)}
    assert set(map(tuple, rollup.totals().collect())) == want
    rollup.commit("gone", spark.createDataFrame([("delete", "b", "de", "t/2", 3, None)], SCHEMA))
    assert set(map(tuple, tokencounts.Rollup(spark, str(tmp_path / "r")).totals().collect())) == {x for x in want if x[0] != "b"}


def test_a_failed_batch_is_written_anew(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    bad = spark.createDataFrame([("upsert", "a", "en", "t", 1, None)], SCHEMA)
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("x", bad)
    assert rollup.batches() == []
    assert rollup.commit("x", bad.replace("upsert", "insert", ["op"]))
    assert rollup.totals().first()["tokens"] == 1


def test_counts_equal_the_tokenizers(spark):
    whole = Tokenizer.from_file(default_vocabulary())
    docs = helpers.awkward(spark)
    got = tokencounts.count_tokens(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["bpe_tokens"] == len(whole.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["word_tokens"] == len(helpers.WORD.findall(r["text"] or ""))
    assert tokencounts.count_tokens(helpers.empty(spark), ["doc_id"]).count() == 0


def test_query(spark, tmp_path):
    texts = ["a b", "a b", "c d e", None, None, "", "Straße"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    whole = Tokenizer.from_file(default_vocabulary())
    want = collections.Counter()
    for i, t, lang, source, _ in rows:
        if t is not None and t in texts[:i]:
            continue
        for name, n in (("word_bpe_49k/1", len(whole.encode(t or "", add_special_tokens=False).ids)), ("ascii_words/1", len((t or "").split()))):
            want[source, lang, name, "d"] += 1
            want[source, lang, name, "t"] += n
    got = queries.op8_token_counts(spark, str(tmp_path)).collect()
    have = collections.Counter()
    for r in got:
        have[r["source"], r["lang"], r["tokenizer"], "d"], have[r["source"], r["lang"], r["tokenizer"], "t"] = r["documents"], r["tokens"]
    assert have == want
