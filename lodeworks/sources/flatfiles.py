"""Flat tuning artifacts as a Spark data source (``flat_examples``): tokens, masks, offsets, metadata.

Writing: rows (example_index, start, token_ids, loss_mask), where ``start`` is the number of tokens before
an example.  As that says where each example's bytes belong, every task writes its own rows in place, into
files below a temporary folder on the file system that driver and executors share; a task that runs again
writes the same bytes to the same places.  The commit checks that all examples are there and publishes the
four files, the metadata last.  Reading: a partition for every range of examples of some megabytes.

The files are made to be mapped into memory, so they are ordinary files: a folder that needs another
protocol is refused, as such stores cannot write in the middle of an object.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

TOKENS, MASKS, OFFSETS, METADATA = FILES = ("tokens.bin", "loss_mask.bin", "offsets.npy", "metadata.json")
SCHEMA = "example_index long, start long, token_ids array<int>, loss_mask array<int>"
#: Tokens of a partition, about; examples of a batch.
RANGE_TOKENS, BATCH_EXAMPLES = 16_000_000, 1_000


def local(folder: str) -> str:
    """The folder as a plain path."""
    plain = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"flat files need a shared file system, not {folder}")
    return plain


def _header(examples: int) -> bytes:
    """The head of a NumPy file of ``examples`` + 1 offsets."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<i8", "fortran_order": False, "shape": (examples + 1,)})
    return out.getvalue()


def require_free(folder: str) -> None:
    if there := [f for f in FILES if os.path.exists(os.path.join(folder, f))]:
        raise FileExistsError(f"{folder} holds {', '.join(there)}")


def agreed(folder: str) -> np.ndarray:
    """The offsets of an artifact (mapped, not read), if its files agree in their lengths."""
    with open(os.path.join(folder, METADATA), encoding="utf-8") as f:
        retained = json.load(f)["retained"]
    ends = np.load(os.path.join(folder, OFFSETS), mmap_mode="r")
    n_tokens = os.path.getsize(os.path.join(folder, TOKENS)) // 2
    if n_tokens != os.path.getsize(os.path.join(folder, MASKS)) or len(ends) != retained + 1 or int(ends[-1]) != n_tokens:
        raise ValueError("the artifact's lengths do not agree")
    return ends


@dataclass
class _Done(WriterCommitMessage):
    examples: int
    tokens: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = local(options["path"])
        self.examples, self.tokens, self.metadata = int(options["retained"]), int(options["total_tokens"]), options["metadata"]
        require_free(self.folder)
        self.work = os.path.join(self.folder, f"{uuid.uuid4().hex}.tmp")
        self.head = _header(self.examples)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.work, exist_ok=True)
        files = [os.open(os.path.join(self.work, f), os.O_WRONLY | os.O_CREAT, 0o644) for f in FILES[:3]]
        done = _Done(0, 0)
        try:
            for batch in batches:
                index, start = (batch.column(i).to_numpy() for i in (0, 1))
                ids, masks = batch.column(2), batch.column(3)
                at, mask_at = ids.offsets.to_numpy(), masks.offsets.to_numpy()
                if (np.diff(at) != np.diff(mask_at)).any():
                    raise ValueError("an example's tokens and mask differ in length")
                values = ids.values.to_numpy(zero_copy_only=False)
                own = values[at[0] : at[-1]]
                if len(own) and (own.min() < 0 or own.max() > 0xFFFF):
                    raise OverflowError("a token id does not fit 16 bits")
                marks = masks.values.to_numpy(zero_copy_only=False)
                # runs of neighbours are written at once
                ends = start + np.diff(at)
                breaks = np.flatnonzero((start[1:] != ends[:-1]) | (index[1:] != index[:-1] + 1)) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), batch.num_rows]):
                    if a == b:
                        continue
                    os.pwrite(files[0], values[at[a] : at[b]].astype("<u2").tobytes(), 2 * int(start[a]))
                    os.pwrite(files[1], marks[mask_at[a] : mask_at[b]].astype(np.uint8).tobytes(), int(start[a]))
                    os.pwrite(files[2], ends[a:b].astype("<i8").tobytes(), len(self.head) + 8 * (int(index[a]) + 1))
                done.examples += batch.num_rows
                done.tokens += len(own)
        finally:
            for f in files:
                os.close(f)
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        examples, tokens = (sum(getattr(m, c) for m in messages if m) for c in ("examples", "tokens"))
        if (examples, tokens) != (self.examples, self.tokens):
            self.abort(messages)
            raise ValueError(f"{examples} examples of {tokens} tokens were written, not {self.examples} of {self.tokens}")
        os.makedirs(self.work, exist_ok=True)
        for name, size in zip(FILES[:3], (2 * tokens, tokens, len(self.head) + 8 * (examples + 1))):
            with open(os.path.join(self.work, name), "ab") as f:
                f.truncate(size)
        with open(os.path.join(self.work, OFFSETS), "r+b") as f:
            f.write(self.head + bytes(8))
        with open(os.path.join(self.work, METADATA), "w", encoding="utf-8") as f:
            f.write(self.metadata)
        for name in FILES:
            os.replace(os.path.join(self.work, name), os.path.join(self.folder, name))
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


@dataclass
class ExampleRange(InputPartition):
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = local(options["path"])
        self.range = int(options.get("range_tokens", RANGE_TOKENS))

    def partitions(self) -> list[InputPartition]:
        ends = agreed(self.folder)
        n_tokens, retained = int(ends[-1]), len(ends) - 1
        parts = max(1, -(-n_tokens // self.range))
        cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(1, parts) * self.range), [retained])))
        return [ExampleRange(int(a), int(b)) for a, b in zip(cuts, cuts[1:])] or [ExampleRange(0, 0)]

    def read(self, part: ExampleRange) -> Iterator[pa.RecordBatch]:
        ends = np.load(os.path.join(self.folder, OFFSETS), mmap_mode="r")
        with open(os.path.join(self.folder, TOKENS), "rb") as tokens, open(os.path.join(self.folder, MASKS), "rb") as masks:
            for a in range(part.first, part.end, BATCH_EXAMPLES):
                at = np.asarray(ends[a : min(a + BATCH_EXAMPLES, part.end) + 1])
                n = int(at[-1] - at[0])
                tokens.seek(2 * int(at[0]))
                masks.seek(int(at[0]))
                places = pa.array((at - at[0]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(places, pa.array(x.astype(np.int32))) for x in (np.frombuffer(tokens.read(2 * n), "<u2"), np.frombuffer(masks.read(n), np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(at) - 1)), pa.array(at[:-1]), *lists], ["example_index", "start", "token_ids", "loss_mask"])


class FlatExamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_examples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("artifacts are never overwritten; remove the old one first")
        return _Writer(self.options)
