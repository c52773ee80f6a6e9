"""Terms of whole texts: maximal runs of bytes of a class, found and coded a batch at a time.

Every byte of a character beyond ASCII belongs to a term here, so runs can be told from the UTF-8
bytes alone, by a table of 256 entries; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one step.
STEP_BYTES = 8_000_000

_ASCII_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
LETTERS = np.zeros(256, bool)
LETTERS[[*_ASCII_LETTERS, *range(0x80, 256)]] = True
ALPHANUMERIC = LETTERS.copy()
ALPHANUMERIC[0x30:0x3A] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Terms:
    """``distinct``: the terms met; ``codes``: which one each occurrence is, text after text;
    ``bounds``: where each text's occurrences begin (and the end)."""

    distinct: pa.Array
    codes: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        """The number of the text that each occurrence is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, occurrences) of every text and term that meet, by text and code."""
        keys, n = np.unique(self.text_of() * max(1, len(self.distinct)) + self.codes, return_counts=True)
        return *np.divmod(keys, max(1, len(self.distinct))), n


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, (at - at[0]).astype(np.int64)


def terms(texts: pa.Array, kind: np.ndarray) -> Terms:
    """Terms of a column of texts; ``kind``: which bytes they are made of."""
    data, offsets = raw(texts)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    place = np.cumsum(inside, dtype=np.int32)
    ends = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]]))
    coded = words.dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets))


def steps(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_BYTES of text each; a longer text is a slice alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy().astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // STEP_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)
