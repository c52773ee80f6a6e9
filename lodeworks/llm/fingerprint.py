"""Whole-text SimHash fingerprints: XXH64 of word shingles, one majority bit per hash bit.

Works on one text at a time, in NumPy; the caller streams Arrow batches through it.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Rows added per step in 8-bit sums; must stay below 256.
_STEP = 128


def shingle_digests(text: str, width: int = 3) -> bytes:
    """Big-endian XXH64 digests, end to end, of every ``width``-word shingle.

    Only A-Z is lower-cased and only ASCII white space separates words (``bytes.lower`` and
    ``bytes.split`` do exactly that on UTF-8).  Fewer words than ``width``: the whole sequence is
    the one shingle.  No word: no digest.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    if len(words) <= width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = (ends[width - 1 :] - 1).tolist()
    return b"".join([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), last)])


def majority(digests: bytes) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half of the digests; 0 for none."""
    n = len(digests) // 8
    if not n:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    whole = n // _STEP * _STEP
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, _STEP, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a whole text (null: as empty, zero)."""
    return majority(shingle_digests(text or "", width))
