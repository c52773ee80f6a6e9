import json

import pytest
from pyspark.sql import functions as F

from lodeworks import pipelines
from lodeworks.functions.registry import MANIFEST, NamedTokenizer, fingerprint, read_manifest
from lodeworks.functions.tokenizers import ByteTokenizer, CodepointTokenizer, FileTokenizer


def put(root, revision, vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({w: i for i, w in enumerate(vocabulary)}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    folder = root / "words" / revision
    folder.mkdir(parents=True)
    made.save(str(folder / "tokenizer.json"))


@pytest.fixture
def registry(tmp_path):
    pytest.importorskip("tokenizers")
    root = tmp_path / "registry"
    put(root, "main", ["?", "a", "b", "c"])
    put(root, "v2", ["?", "c", "b", "a"])
    put(root, "same", ["?", "a", "b", "c"])
    return str(root)


def test_two_revisions(spark, registry, tmp_path):
    first, second = (NamedTokenizer(spark, registry, "words", r, eos_token_id=0) for r in ("main", "v2"))
    rows = spark.createDataFrame([(0, "s", "a b c"), (1, "s", "c")], "doc_id long, source string, text string")
    got = rows.orderBy("doc_id").select(first.ids(F.col("text")).alias("x"), second.ids(F.col("text")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [([1, 2, 3], [3, 2, 1]), ([3], [1])]
    assert first.decode([1, 3]) == "a c" and first.vocab_size == 4
    pipelines.tokenize(rows, first, str(tmp_path / "raw"))
    pipelines.split(spark, str(tmp_path / "raw"), str(tmp_path / "parts"), 0, fraction=0.5)
    for at in ("raw", "parts"):
        said = read_manifest(str(tmp_path / at))
        assert (said["name"], said["revision"], said["fingerprint"]) == ("words", "main", fingerprint(first)) and first.digest in said["fingerprint"]
        good = pipelines.check(spark, str(tmp_path / at), 4, 0, tokenizer=first)
        assert good["errors"] == [] and good["tokenizer"] == said and good["total_tokens"] == 6
        wrong = pipelines.check(spark, str(tmp_path / at), 4, 0, tokenizer=second)
        assert wrong["error_count"] == 1 and "another tokenizer" in wrong["errors"][0] and wrong["text"].endswith("RESULT: FAILED") and "total_tokens" not in wrong
    same = NamedTokenizer(spark, registry, "words", "same", eos_token_id=0)
    assert pipelines.check(spark, str(tmp_path / "raw"), 4, 0, tokenizer=same)["errors"] == []


def test_fingerprints(spark, registry):
    named = NamedTokenizer(spark, registry, "words", "main", eos_token_id=0)
    assert fingerprint(named) == fingerprint(FileTokenizer(f"{registry}/words/main/tokenizer.json", eos_token_id=0))
    assert len({fingerprint(t) for t in (named, NamedTokenizer(spark, registry, "words", "main", eos_token_id=1), ByteTokenizer(), CodepointTokenizer())}) == 4
    with pytest.raises(FileNotFoundError, match="revisions: main, same, v2"):
        NamedTokenizer(spark, registry, "words", "v3")
    with pytest.raises(FileNotFoundError, match="none"):
        NamedTokenizer(spark, registry, "other")


def test_shards_that_say_nothing_are_checked_all_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(0, "s", "abc")], "doc_id long, source string, text string")
    pipelines.tokenize(rows, ByteTokenizer(), str(tmp_path / "raw"))
    assert json.loads((tmp_path / "raw" / MANIFEST).read_text())["vocab_size"] == 259
    (tmp_path / "raw" / MANIFEST).unlink()
    got = pipelines.check(spark, str(tmp_path / "raw"), 259, 2, tokenizer=CodepointTokenizer())
    assert got["errors"] == [] and got["tokenizer"] is None
