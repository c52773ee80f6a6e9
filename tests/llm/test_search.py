"""Ranked search against scoring every document, and the cut of posting lists against every cut."""

import math
import random
import re
from collections import Counter

import numpy as np
from helpers import awkward, documents, empty, lower_az

from lodeworks.llm import search as module
from lodeworks.llm.search import block_ends, search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, best=50):
    held = [(d, Counter(WORDS.findall(lower_az(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(WORDS.findall(lower_az(text or ""))) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "item_id long, text string, score long, doc_id long")


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "The quick brown FOX, passage7!"), (2, None), (3, ""), (4, "word5 and1 word5 été 漢字"), (5, "nothing-like-it"), (6, "line " * 200 + "dog")]


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(search(docs, items_of(spark, ITEMS))) == plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_many_documents_ties_and_few_best(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD_DOCS", 150)
    monkeypatch.setattr(module, "_FIRST_POSTINGS", 1)
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(9000)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 25))) for _ in range(700)]
    texts += texts[:100] + ["w1 w2"] * 300
    ids = rnd.sample(range(5000), len(texts))
    items = [(i, " ".join(rnd.choices(words, k=6))) for i in range(12)] + [(50, "w1"), (51, "w1 w2 w2")]
    for best in (1, 7, 50):
        assert got(search(documents(spark, texts, ids).repartition(3), items_of(spark, items), best=best)) == plain(list(zip(ids, texts)), items, best)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(module, "PASS_BYTES", 40)
    docs = awkward(spark)
    assert got(search(docs, items_of(spark, ITEMS))) == plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_empty_tables(spark):
    assert search(empty(spark), items_of(spark, ITEMS)).count() == 0
    assert search(awkward(spark), items_of(spark, ITEMS).limit(0)).count() == 0


def spent(scores, ends, cost):
    cut = [0, *ends]
    return sum((b - a) * max(scores[a:b]) - sum(scores[a:b]) + cost for a, b in zip(cut, cut[1:]))


def test_blocks_cost_the_least():
    rnd = random.Random(8)
    lists = [[rnd.randint(1, 20) for _ in range(n)] for n in (1, 9, 1, 10, 4, 7)]
    flat, firsts = np.array(sum(lists, []), np.int64), np.cumsum([0, *map(len, lists)])
    for longest, cost in ((3, 5), (4, 1), (10, 12)):
        ends = block_ends(flat, firsts, longest, cost)
        for own, a, b in zip(lists, firsts, firsts[1:]):
            mine = [int(x - a) for x in ends if a < x <= b]
            assert mine[-1] == len(own) and max(np.diff([0, *mine])) <= longest
            cuts = ([i + 1 for i in range(len(own)) if i + 1 == len(own) or bits >> i & 1] for bits in range(1 << (len(own) - 1)))
            least = min(spent(own, c, cost) for c in cuts if max(np.diff([0, *c])) <= longest)
            assert spent(own, mine, cost) == least


def shard_of(postings, n):
    """A shard of n documents of ten terms each; ``postings``: {term: (documents, occurrences)}."""
    docs, tf = (np.concatenate([p[i] for p in postings.values()]) for i in (0, 1))
    ends = np.cumsum([0, *(len(p[0]) for p in postings.values())])
    row = {"n": np.full(n, 10, "<i8"), "terms": np.array(list(postings), "<i4"), "ends": ends.astype("<i8"), "docs": docs.astype("<i4"), "tf": tf.astype("<i8")}
    return {k: v.tobytes() for k, v in row.items()}


def test_blocks_that_cannot_win_are_skipped():
    """One document in a thousand is far better than the others: few postings are looked at."""
    n = 20_000
    tf = np.where(np.arange(n) % 1000 == 0, 50, 1)
    row = shard_of({0: (np.arange(n), tf), 1: (np.arange(0, n, 2), tf[::2])}, n)
    shard = module.Postings(row, module.Counts(n, 10 * n, np.array([5, 7], np.int64)))
    docs, _ = shard.search(np.array([0, 1]), 10)
    assert docs.tolist() == list(range(0, 10_000, 1000)) and len(shard.low) > 500


def test_frequent_terms_are_looked_up_for_few_documents():
    """A rare telling term and a frequent one: the frequent list is not gone through."""
    n = 50_000
    row = shard_of({0: (np.arange(n), np.ones(n, int)), 1: (np.arange(0, n, 500), np.ones(n // 500, int))}, n)
    shard = module.Postings(row, module.Counts(n, 10 * n, np.array([20, 6_000], np.int64)))
    docs, scores = shard.search(np.array([0, 1]), 50)
    assert docs.tolist() == list(range(0, 25_000, 500)) and len(set(scores.tolist())) == 1
    assert shard.looked_at <= 2 * n // 500


def test_search_of_random_shards_is_exact():
    rng = np.random.default_rng(6)
    for trial in range(60):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 9))
        postings = {}
        for t in range(k):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.002, 0.05, 0.5, 1.0]))
            if len(docs):
                postings[t] = (docs, np.minimum(rng.geometric(0.6, len(docs)) * rng.choice([1, 1, 30], len(docs)), 99))
        if not postings:
            continue
        counts = module.Counts(n, 10 * n, rng.integers(0, 9000, k))
        shard = module.Postings(shard_of(postings, n), counts)
        total = np.zeros(n, np.int64)
        for t, (docs, tf) in postings.items():
            total[docs] += counts.weight[t] * module.impacts(tf.astype(np.int64), counts.norms(np.full(len(docs), 10)))
        for best in (1, 5, 50):
            docs, scores = shard.search(np.arange(k), best)
            order = np.lexsort((np.arange(n), -total))
            want = order[total[order] > 0][:best]
            assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
