"""Window packing: ids and checksums, gapless sequences without padding, whole documents where they fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import TEXTS, awkward, documents, empty

from lodeworks.llm.bytetokens import ByteTokenizer, default_vocabulary
from lodeworks.llm.packing import plan
from lodeworks.llm.windowpack import Pouring, pack_windows


def whole(text):
    return ByteTokenizer.opened(default_vocabulary()).whole.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    rnd = random.Random(3)
    signs = [" ", "\n", "\t", "a", "b'", "s", "1", "é", " ", "　", "!", "日", "\r", "'", "🙂", "Z", "Â", "\x85", "\x1f", "ll"]
    odd = ["a  b", "a \n b", "  x", "x  ", "\n\n x", "A\n\nB \n\n C", "foo  <|endoftext|> bar", "it's 'll 12 3a", "\r\n x\r\n\r\ny", "", None, "", " ", "\n ", *TEXTS]
    odd += ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    ids, at = ByteTokenizer.opened(default_vocabulary()).encode_column(pa.array(odd, pa.string()))
    assert all(ids[at[i] : at[i + 1]].tolist() == whole(x) for i, x in enumerate(odd))


def check(rows, docs, capacity):
    """``rows``: of one table; ``docs``: ids of its documents, as often as they are there."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    want = defaultdict(int)
    for d, ids in docs:
        want[d] += len(ids)
    got = defaultdict(int)
    known = defaultdict(list)
    for d, ids in docs:
        known[d].append(np.array(ids, "<u4"))
    for r in rows:
        got[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and r.start + r.length <= len(x) and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in known[r.doc_id])
    assert got == want


@pytest.mark.parametrize("capacity", [1024, 64, 8])
def test_awkward_rows(spark, capacity):
    docs = awkward(spark)
    rows = pack_windows(docs, capacity=capacity).collect()
    check(rows, [(r.doc_id, [*whole(r.text), 0]) for r in docs.collect()], capacity)


def test_copies_that_leave_windows_open(spark):
    texts = ["one two three four five six seven eight nine ten"] * 50 + ["short"] * 3
    rows = pack_windows(documents(spark, texts), capacity=16).collect()
    check(rows, [(i, [*whole(x), 0]) for i, x in enumerate(texts)], 16)


def test_shuffled_way_beyond_the_bound(spark):
    texts = ["one two three four five six seven eight nine ten"] * 20
    cols = ["doc_id", "start", "length", "ids_crc32"]
    small, none = (sorted(map(tuple, pack_windows(documents(spark, texts), capacity=16, broadcast_bytes=b).select(*cols).collect())) for b in (16_000_000, -1))
    assert len(small) == len(none) and sum(r[2] for r in small) == sum(r[2] for r in none)


def test_empty_table(spark):
    assert pack_windows(empty(spark)).count() == 0


def test_only_open_windows_are_cut():
    rnd = random.Random(5)
    for capacity in (8, 16, 64):
        for _ in range(30):
            counts = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(1, 6))}
            made = plan(counts, capacity)
            pouring = Pouring.of(counts, made, capacity)
            length = np.concatenate([np.full(n, x) for x, n in counts.items()])
            rank = np.concatenate([np.arange(n) for n in counts.values()])
            window, offset = made.place(length, rank)
            fill = np.bincount(window, weights=length, minlength=made.bins).astype(int)
            at = np.searchsorted(pouring.first, np.arange(made.bins), side="right") - 1
            assert (pouring.fill[at] == fill).all()
            piece, start, part, sequence, place = pouring.parts(window, offset, length)
            assert (np.bincount(piece, weights=part).astype(int) == length).all()
            kept = (fill == capacity) | (fill & (fill - 1) == 0)
            whole_pieces = kept[window]
            assert (sequence[whole_pieces[piece]] == window[piece][whole_pieces[piece]]).all()
            for s in np.unique(sequence):
                own = np.flatnonzero(sequence == s)
                own = own[np.argsort(place[own])]
                total = part[own].sum()
                assert (place[own] == np.cumsum(part[own]) - part[own]).all() and (total == capacity or total & (total - 1) == 0) and total <= capacity
            cut = np.bincount(piece) > 1
            assert cut.sum() <= pouring.total // capacity + capacity.bit_length()
