"""Token ids of whole texts by a byte-level BPE file, computed once for every distinct word of a batch.

The tokenizer's own pattern cuts a text before any white space that follows something else, before a
single space that leads a word, behind a line end that stands alone, and between a letter and a
punctuation mark.  So a text's bytes can be cut there beforehand
and its ids are those of the parts, end to end.  Places are taken only where the neighbouring bytes
leave no doubt; whatever lies between two of them goes through the tokenizer as it is.  The parts of
an Arrow batch are dictionary-encoded and only new ones are tokenised.  A bounded cache of parts lives
as long as its Python worker.  The file's path is a parameter; it is read where it is installed.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .terms import raw


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Distinct parts kept by a worker before it starts afresh (about 200 bytes each), and the longest kept.
CACHE_PARTS, _LONG = 500_000, 64

_SPACE, _LINE_END = 0x20, 0x0A
#: Bytes that are no white space and no part of any, and lead bytes that begin no white space.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x21, 0x80)]] = True
_BEGINS = _PLAIN.copy()
_BEGINS[0xC3:0xF5] = True
_BEGINS[0xE1:0xE4] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class ByteTokenizer:
    """Ids by a ``tokenizers`` file with a byte-level pre-tokenizer."""

    _open: dict[str, ByteTokenizer] = {}

    # a part that is one word, of Latin letters
    _word = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level tokenizer with the usual pattern")
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {"": b""}
        # byte-level spelling: printable Latin-1 characters stand for themselves, other bytes follow 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelt = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
        tries = [" the", "Straße", " niño", "été", " Übung", "Haus"]
        self.quick = [self._word_ids(x) for x in tries] == self._full(tries)

    @classmethod
    def opened(cls, path: str) -> ByteTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _full(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(parts, add_special_tokens=False)]

    def _word_ids(self, word: str) -> bytes:
        spelt = "".join(map(self.spelt.__getitem__, word.encode()))
        return struct.pack(f"<{len(found := self.whole.model.tokenize(spelt))}I", *[t.id for t in found])

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each part."""
        get = self.cache.get
        out = [get(x) for x in parts]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            if len(self.cache) > CACHE_PARTS:
                self.cache.clear()
                self.cache[""] = b""
            rest = []
            for i in missing:
                if self.quick and self._word.fullmatch(parts[i]):
                    out[i] = self._word_ids(parts[i])
                else:
                    rest.append(i)
            for i, ids in zip(rest, self._full([parts[i] for i in rest])):
                out[i] = ids
            self.cache.update((parts[i], out[i]) for i in missing if len(parts[i]) <= _LONG)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts end to end (uint32), and where each text's begin."""
        data, offsets = raw(texts)
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            here, before = data[1:], data[:-1]
            cut[1:-1] = ((here == _SPACE) | (here == _LINE_END)) & _PLAIN[before]  # white space behind something
            cut[1:-2] |= (here[:-1] == _SPACE) & _BEGINS[data[2:]]  # a space that leads a word
            cut[2:-1] |= _PLAIN[data[:-2]] & (before[1:] == _LINE_END) & _BEGINS[here[1:]]  # a line end alone
            letter = _LETTER[data]
            letter[1:] |= (before == 0xC3) & (here >= 0x80) & (here != 0x97) & (here != 0xB7)
            cut[1:-1] |= letter[:-1] & _MARK[here]
        cut[offsets] = False
        for i in np.flatnonzero(self._has_special(texts)):  # found before the pattern is: such texts stay whole
            cut[offsets[i] : offsets[i + 1]] = False
        # every text begins a part, an empty one too: parts may be empty
        starts = np.sort(np.concatenate((np.flatnonzero(cut), offsets[:-1])))
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
        bounds = np.searchsorted(starts, offsets, side="left")
        bounds[-1] = len(starts)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        coded = words.dictionary_encode()
        blobs = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        firsts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(firsts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        # empty texts share a place with the next one: count the parts before each text one by one
        return ids, ends[self._first_parts(starts, offsets)]

    @staticmethod
    def _first_parts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's first part, and the number of parts.  Of parts that begin at one place, those of
        empty texts come first."""
        texts = offsets[:-1]
        same = np.arange(len(texts)) - np.searchsorted(texts, texts, side="left")
        return np.append(np.searchsorted(starts, texts, side="left") + same, len(starts))

    def _has_special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for content in self.special:
            found |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        return found
