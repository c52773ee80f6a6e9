"""Token ids of whole texts, computed once per distinct word of a batch.

A tokenizer that drops white space gives a text the ids of its white-space-separated chunks, end to
end.  So the chunks of an Arrow batch are dictionary-encoded, only new distinct chunks are
tokenised, and the ids are gathered with NumPy.  A bounded cache of chunks lives as long as its
Python worker.  The vocabulary file's path is a parameter; the file is read where it is installed.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks kept by a worker before it starts afresh (about 150 bytes each).
CACHE_CHUNKS = 200_000
#: Longest chunk that is kept in the cache.
_LONG = 64
#: Characters of text handled in one step.
STEP_CHARS = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of chunks by a ``tokenizers`` file whose pre-tokenizer drops white space."""

    _open: dict[str, WordTokenizer] = {}

    # letters whose lower case, composed form and byte spelling follow the rules below
    _plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        # byte-level spelling: printable Latin-1 characters stand for themselves, other bytes follow 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelt = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
        self.quick = self._agrees()

    @classmethod
    def opened(cls, path: str) -> WordTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _agrees(self) -> bool:
        """The short way is used only for a file whose own steps are the ones it stands for."""
        tries = ["The", "don't", "it's,", "été", "Straße", "naïve", "a1b2-3.c", "(ÑANDÚ)", "xyz''s", "['re]", "Ünïcödé's"]
        return all(self._short(x) == self._full([x])[0] for x in tries)

    def _full(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(chunks, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelt = part if part.isascii() else "".join(self.spelt[b] for b in part.encode())
            ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            if len(part) <= _LONG:
                if len(self.parts) > CACHE_CHUNKS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _short(self, chunk: str) -> bytes | None:
        if not self._plain.fullmatch(chunk) or "<|" in chunk:
            return None
        return b"".join(map(self._part, self._parts.findall(chunk.lower())))

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        get = self.cache.get
        out = [get(x) for x in chunks]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing and self.quick:  # a word alone is its own part
            part, plain, rest = self._part, self._plain.fullmatch, []
            for i in missing:
                x = chunks[i]
                if x.isalpha() and plain(x):
                    out[i] = part(x.lower())
                else:
                    rest.append(i)
            missing = rest
        if missing:
            if len(self.cache) > CACHE_CHUNKS:
                self.cache.clear()
                self.cache[""] = b""
            rest = []
            for i in missing:
                x = chunks[i]
                ids = self._short(x) if self.quick else None
                if ids is None:
                    rest.append(i)
                    continue
                out[i] = ids
                if len(x) <= _LONG:
                    self.cache[x] = ids
            for i, ids in zip(rest, self._full([chunks[i] for i in rest])):
                out[i] = ids
                if len(chunks[i]) <= _LONG:
                    self.cache[chunks[i]] = ids
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts end to end (uint32), and where each text's begin."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        coded = words.dictionary_encode()
        blobs = self.chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        firsts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(firsts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[bounds]


def steps(batch: pa.RecordBatch, text_at: int):
    """Slices of a batch with about STEP_CHARS bytes of text each; a longer text is a slice alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // STEP_CHARS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)

