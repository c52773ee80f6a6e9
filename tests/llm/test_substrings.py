import collections
import hashlib
import random

import helpers
import pytest

from lodeworks.llm import substrings
from lodeworks.llm.automaton import SuffixAutomaton


def plain(rows, window):
    words = [helpers.WORD.findall(x or "") for _, x in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1, 128])
@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_against_a_plain_version(spark, table, shard):
    docs = table(spark)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], 35)
    assert sorted(map(tuple, substrings.remove_repeats(docs, shard=shard).collect()), key=str) == want
    assert any(n for _, _, n, _ in want)
    got = substrings.remove_repeats(docs, shard=shard, digest=True).collect()
    assert sorted(r["kept_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for *_, t in want)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    docs = helpers.documents(spark, texts)
    assert sorted(map(tuple, substrings.remove_repeats(docs, window=9, gram=4, shard=4).collect()), key=str) == plain(list(enumerate(texts)), 9)


@pytest.mark.parametrize("seed", range(40))
def test_shard_masks(seed):
    rnd = random.Random(seed)
    w = rnd.choice([2, 3, 5])
    segments = list(collections.Counter(b" ".join(rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(w, 12))) for _ in range(rnd.randint(1, 6))).items())
    count = collections.Counter()
    for s, times in segments:
        words = s.split()
        for i in range(len(words) - w + 1):
            count[tuple(words[i : i + w])] += times
    for (s, _), mask in zip(segments, substrings.shard_masks(segments, w)):
        words = s.split()
        assert mask == sum(1 << i for i in range(len(words) - w + 1) if count[tuple(words[i : i + w])] > 1)


def test_matching_statistics():
    shard = SuffixAutomaton()
    shard.add("abcab")
    shard.finish()
    assert list(shard.matching("xabcx", 9)) == [(0, 0), (1, 2), (2, 2), (3, 1), (0, 0)]


def test_no_documents(spark):
    assert substrings.remove_repeats(helpers.empty(spark)).count() == 0


def test_ids_of_any_type_and_hot_rows(spark):
    texts = [(r["doc_id"], r["text"]) for r in helpers.awkward(spark).collect()]
    rows = [(None if i is None else f"doc-{i}", t) for i, t in texts] + [("same", helpers.PASSAGE)] * 40
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == plain(rows, 35)


def test_very_long_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "x" * 3_000_000), (1, " ".join(f"n{i}" for i in range(200_000)) + f" {passage}"), (2, f"{passage} end"), (3, " \t\n" * 500_000)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == {0: (1, 0), 1: (200_060, 60), 2: (61, 60), 3: (0, 0)}


def test_the_catalog_keeps_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    substrings.remove_repeats(helpers.documents(spark)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_ways_count_every_window(spark):
    docs = helpers.documents(spark)
    got = {r["way"]: r["windows"] for r in substrings.ways(docs, shard=1).collect()}
    words = [len(helpers.WORD.findall(r["text"] or "")) for r in docs.collect()]
    assert sum(got.values()) == sum(max(0, n - 34) for n in words) and got["alike"] + got["counted"] > 0
