import collections
import random
import zlib

import helpers
import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import packing
from lodeworks.llm.wordtokens import WordTokenizer, default_vocabulary


def naive(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((capacity if best is None else best) - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 16, 33, 100])
    counts = collections.Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(1, 90)))
    plan = packing.plan(dict(counts), capacity)
    length = np.array([n for n in counts for _ in range(counts[n])])
    rank = np.array([k for n in counts for k in range(counts[n])])
    bins, offset = plan.place(length, rank)
    filled = collections.defaultdict(list)
    for b, o, n in zip(bins, offset, length):
        filled[b].append((o, n))
    for own in filled.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in filled.values()) == naive(counts.elements(), capacity)


def test_plan_rejects_lengths_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_word_tokens_equal_whole_text_tokens():
    import pyarrow as pa

    whole = Tokenizer.from_file(default_vocabulary())
    own = WordTokenizer.opened(default_vocabulary())
    assert own.quick
    odd = ["'S x''ll a'd", "½ ² ª º µ × ÷", "a\x1cb\x85c d", "ǅ ſt ﬁ Σς", "<|startoftext|>a", "A" * 300]
    texts = [*helpers.TEXTS, *odd]
    ids, at = own.encode_column(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(x or "", add_special_tokens=False).ids, x


@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_pieces_and_places(spark, table):
    docs = table(spark)
    got = packing.pack_documents(docs, capacity=512, with_ids=True).toPandas()
    whole = Tokenizer.from_file(default_vocabulary())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 512)):
            part = ids[s : s + 512]
            want[r["doc_id"], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    have = collections.Counter((None if d != d else d, *r) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 512
    assert all(len(i) == n for i, n in zip(got["ids"], got["length"]))


def test_sequences_put_pieces_together(spark):
    packed = packing.pack_documents(helpers.documents(spark), capacity=512, with_ids=True).persist()
    rows = packed.collect()
    for r in packing.sequences(packed).collect():
        own = sorted((x for x in rows if x["sequence_id"] == r["sequence_id"]), key=lambda x: x["offset"])
        assert r["ids"] == [t for x in own for t in x["ids"]]


def test_no_documents(spark):
    assert packing.pack_documents(helpers.empty(spark)).count() == 0


def test_equal_rows_are_spread_over_buckets_and_long_texts_are_cut(spark):
    docs = spark.createDataFrame([(None, "")] * 400 + [(1, "z" * 200_000), (2, "a b " * 20_000)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert sum(r["doc_id"] is None for r in rows) == 400 and all(r["length"] == 1 for r in rows if r["doc_id"] is None)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= packing.CAPACITY
