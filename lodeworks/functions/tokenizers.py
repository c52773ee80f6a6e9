"""Tokenizers: a small protocol, two built-in ones, and files of the ``tokenizers`` library.

A tokenizer gives ids on the driver (``encode``/``decode``) and as a column (``ids``).  The built-in
ones stay inside generated code; a file's ids come from an Arrow-batched UDF, opened once a worker.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    vocab_size: int
    bos_token_id: int | None
    eos_token_id: int | None

    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int], skip_special: bool = False) -> str: ...
    def ids(self, text: Column) -> Column: ...
    def length(self, text: Column) -> Column: ...


class ByteTokenizer:
    """UTF-8 bytes, shifted by three: 0 pads, 1 begins, 2 ends.  Reversible, no clash of ids."""

    vocab_size, bos_token_id, eos_token_id, pad_token_id = 259, 1, 2, 0

    def encode(self, text: str) -> list[int]:
        return [b + 3 for b in text.encode("utf-8")]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return bytes(i - 3 for i in ids if i >= 3).decode("utf-8", "replace")

    def ids(self, text: Column) -> Column:
        def bytes_of(column: pa.Array) -> pa.Array:
            held = pc.fill_null(column.cast(pa.string()), "")
            _, offsets, data = held.buffers()
            at = np.frombuffer(offsets, np.int32)[held.offset : held.offset + len(held) + 1]
            values = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].astype(np.int32) + 3
            made = pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(values))
            return pc.if_else(column.is_valid(), made, pa.scalar(None, made.type)) if column.null_count else made

        return F.arrow_udf(bytes_of, "array<int>")(text)

    def length(self, text: Column) -> Column:
        return F.octet_length(text)


class CodepointTokenizer:
    """Code points modulo 256; a code point of 2 modulo 256 is indistinguishable from the end."""

    vocab_size, bos_token_id, eos_token_id, pad_token_id = 256, 1, 2, 2

    def encode(self, text: str) -> list[int]:
        return [ord(c) % 256 for c in text]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return "".join(chr(i) for i in ids if not (skip_special and i in (self.bos_token_id, self.eos_token_id)))

    def ids(self, text: Column) -> Column:
        letters = F.filter(F.split(text, ""), lambda c: c != "")
        return F.transform(letters, lambda c: F.ascii(c) % 256)

    def length(self, text: Column) -> Column:
        return F.char_length(text)


#: Bytes of text that a file's tokenizer encodes together: what it says of each token is many times its id.
TOGETHER = 250_000


def _together(sizes: np.ndarray, most: int):
    """Stretches of values that hold about ``most`` together; a larger one is alone with few others."""
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(sizes)]) if b > a]


def _lists(ids: list[np.ndarray], sizes: list[int], like: pa.Array) -> pa.Array:
    """Arrays of ids from their values end to end; null where ``like`` is."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    return pc.if_else(like.is_valid(), made, pa.scalar(None, made.type)) if like.null_count else made


class FileTokenizer:
    """A JSON file of the ``tokenizers`` library; its path must be readable on every worker."""

    _open: dict[str, object] = {}

    def __init__(self, path: str, bos_token_id: int | None = None, eos_token_id: int | None = None):
        self.path, self.bos_token_id, self.eos_token_id = path, bos_token_id, eos_token_id

    @staticmethod
    def _file(path: str):
        from tokenizers import Tokenizer as File

        if path not in FileTokenizer._open:
            FileTokenizer._open[path] = File.from_file(path)
        return FileTokenizer._open[path]

    def located(self) -> str:
        """Where the file is on this machine."""
        return self.path

    @property
    def vocab_size(self) -> int:
        return self._file(self.path).get_vocab_size(with_added_tokens=True)

    def encode(self, text: str, add_special: bool = False) -> list[int]:
        return self._file(self.path).encode(text, add_special_tokens=add_special).ids

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return self._file(self.path).decode(ids, skip_special_tokens=skip_special)

    def save(self, path: str) -> None:
        """The tokenizer as a file of its own."""
        self._file(self.path).save(path)

    def ids(self, text: Column, add_special: bool = False) -> Column:
        path, opened = self.path, type(self)._file

        def encoded(column: pa.Array) -> pa.Array:
            held, ids, sizes = pc.fill_null(column.cast(pa.string()), ""), [], []
            for a, b in _together(pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64), TOGETHER):
                got = [np.array(e.ids, np.int32) for e in opened(path).encode_batch(held.slice(a, b - a).to_pylist(), add_special_tokens=add_special)]
                ids.append(np.concatenate(got))
                sizes += map(len, got)
            return _lists(ids, sizes, column)

        return F.arrow_udf(encoded, "array<int>")(text)

    def length(self, text: Column) -> Column:
        return F.size(self.ids(text))


def with_end(ids: Column, tokenizer: Tokenizer) -> Column:
    """A document's tokens: its ids and the end token."""
    return F.array_append(ids, F.lit(end_of(tokenizer)))


def end_of(tokenizer: Tokenizer) -> int:
    if tokenizer.eos_token_id is None:
        raise ValueError("the tokenizer has no end token")
    return int(tokenizer.eos_token_id)


def narrowed(ids: Column, end: int) -> Column:
    """Arrays of ids, each with the id ``end`` behind it, as the bytes that shards hold (unsigned 16-bit, binary).

    A column of them is half as large as one of arrays, and is stored and moved without a look at each id.
    """

    def bytes_of(column: pa.Array) -> pa.Array:
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        if len(values) and (values.min() < 0 or values.max() > 0xFFFF):
            raise OverflowError("a token id does not fit 16 bits")
        at = (offsets - offsets[0]).astype(np.int64)
        packed = np.insert(values.astype("<u2"), at[1:], end)
        bounds = 2 * (at + np.arange(len(at)))
        made = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).cast(pa.binary())
        return pc.if_else(column.is_valid(), made, pa.scalar(None, made.type)) if column.null_count else made

    return F.arrow_udf(bytes_of, "binary")(ids)


def check_narrow(tokenizer: Tokenizer) -> None:
    """Shards hold unsigned 16-bit ids."""
    if tokenizer.vocab_size >= 1 << 16:
        raise ValueError(f"a vocabulary of {tokenizer.vocab_size} ids does not fit 16 bits")


def decoded(tokenizer: Tokenizer, ids: Column, skip_special: bool = False) -> Column:
    """The texts of arrays of ids (Arrow-batched UDF); null stays null."""

    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else tokenizer.decode([int(i) for i in x], skip_special))

    return F.pandas_udf(texts, "string")(ids)
