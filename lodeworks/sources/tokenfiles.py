"""Headerless files of unsigned 16-bit token ids as a Spark data source (``token_files``).

Reading: rows are (path, position, tokens) with at most ``batch_tokens`` ids.  Partitions are made by
bytes: small files share one, up to ``PARTITION_BYTES`` or the table's part for each core, and only larger
files are split, so a shard of any size is read in parallel and in bounded memory.  Filters on path and
position are pushed to the files: those that cannot match are not opened, runs before or behind are not read.
With the option ``ends`` (the end token) rows say where documents end, found as they are read; with
``outline`` they say only that, and no token leaves the reader.
Empty files and files of odd size appear in ``listing`` and are an error to read, unless the option
``bad`` is ``skip``.

Writing: rows (split, source, shard_index, position, tokens); a file for each shard, written by one
task under a temporary name and renamed when the job commits, so a lost or repeated task leaves no
half-written shard.  Files are opened through pyarrow, local or remote.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

#: Most bytes of a partition, fewest (a core is not kept for less), and what opening a file counts as.
PARTITION_BYTES, LEAST_BYTES, OPEN_BYTES = 256_000_000, 4_000_000, 500_000
BATCH_TOKENS = 65_536
READ_SCHEMA = "path string, position long, tokens array<int>"
#: file_order: the file's place among all by path; ends: places behind end tokens, in the row's run.
ENDS_SCHEMA = READ_SCHEMA + ", file_order long, ends array<int>"
OUTLINE_SCHEMA = "path string, position long, n_tokens long, low int, high int, file_order long, ends array<int>"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def list_files(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of every ``.bin`` file below a folder, empty ones too, in order of path parts."""
    files, base = _filesystem(root)
    if files.get_file_info(base).type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = files.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted(((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(".bin")), key=lambda p: p[0].split("/"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, error): what is there, with the files that hold no whole tokens."""
    df = spark.createDataFrame(list_files(root) or [], "path string, bytes long")
    return df.withColumn("error", F.when(F.col("bytes") == 0, "empty file").when(F.col("bytes") % 2 != 0, "file size is not a multiple of two bytes"))


#: How pushed filters compare a row's value with theirs.
_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


@dataclass
class TokenRanges(InputPartition):
    """(path, file_order, first token, end) of runs that one task reads."""

    runs: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.batch = int(options.get("batch_tokens", BATCH_TOKENS))
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.cores = int(options.get("parallelism", 1))
        self.skip = options.get("bad", "fail") == "skip"
        self.end = int(options["ends"]) if "ends" in options else None
        self.outline = options.get("outline", "false") == "true"
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("position",)):
                self.wanted.append((f.attribute[0], type(f), f.value))
            yield f  # Spark looks again at what is read

    def _fits(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, v) for c, kind, v in self.wanted if c == column)

    def partitions(self) -> list[InputPartition]:
        found = []
        for i, (path, size) in enumerate(list_files(self.root)):
            if not self._fits("path", path):
                continue
            if size == 0 or size % 2:
                if self.skip:
                    continue
                raise ValueError(f"{path}: {'empty file' if not size else 'odd size'}")
            found.append((path, i, size // 2))
        whole = sum(2 * n + OPEN_BYTES for _, _, n in found)
        target = min(self.most, max(LEAST_BYTES, whole // self.cores))
        longest = max(1, target // 2 // self.batch) * self.batch  # a row never spans partitions
        out, now, held = [], [], 0
        for path, i, n in found:
            for a in range(0, n, longest):
                end = min(a + longest, n)
                cost = 2 * (end - a) + OPEN_BYTES
                if now and held + cost > target + OPEN_BYTES:
                    out.append(TokenRanges(now))
                    now, held = [], 0
                now.append((path, i, a, end))
                held += cost
        return [*out, TokenRanges(now)]

    def read(self, part: TokenRanges) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.root)
        for path, order, start, end in part.runs:
            starts = [a for a in range(start, end, self.batch) if self._fits("position", a)]
            if not starts:
                continue
            with files.open_input_file(path) as f:
                for a in starts:
                    n = min(self.batch, end - a)
                    yield self._row(path, order, a, np.frombuffer(f.read_at(2 * n, 2 * a), np.uint16))

    def _row(self, path: str, order: int, at: int, ids: np.ndarray) -> pa.RecordBatch:
        def one(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))

        place = {"path": pa.array([path]), "position": pa.array([at], pa.int64())}
        ends = {} if self.end is None else {"file_order": pa.array([order], pa.int64()), "ends": one(np.flatnonzero(ids == self.end) + 1)}
        if self.outline:
            low, high = (pa.array([int(x)], pa.int32()) for x in (ids.min(), ids.max()))
            return pa.RecordBatch.from_pydict(place | {"n_tokens": pa.array([len(ids)], pa.int64()), "low": low, "high": high} | ends)
        return pa.RecordBatch.from_pydict(place | {"tokens": one(ids)} | ends)


def read_run(path: str, start: int, end: int, batch_tokens: int = BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    """(path, position, tokens) of tokens start .. end - 1 of a file, named as Spark names it."""
    files, at = _filesystem(path.removeprefix("file:") if "://" not in path else path)
    with files.open_input_file(at) as f:
        for a in range(start, end, batch_tokens):
            n = min(batch_tokens, end - a)
            ids = np.frombuffer(f.read_at(2 * n, 2 * a), np.uint16).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([a], pa.int64()), lists], ["path", "position", "tokens"])


def _runs(column: pa.Array) -> Callable[[int], bytes | memoryview]:
    """The bytes of a row's tokens, which are arrays of ids or such bytes already."""
    if not pa.types.is_list(column.type):
        return lambda i: memoryview(column[i].as_buffer())
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    def run(i: int) -> bytes:
        ids = values[bounds[i] : bounds[i + 1]]
        if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
            raise OverflowError("a token id does not fit 16 bits")
        return ids.astype("<u2").tobytes()

    return run


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root = options["path"].rstrip("/")
        if overwrite:
            raise ValueError("token files are never overwritten; remove the old ones first")
        try:
            there = list_files(self.root)
        except FileNotFoundError:
            there = []
        if there:
            raise FileExistsError(f"{self.root} holds token files already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        files, base = _filesystem(self.root)
        done, out, now, end = [], None, None, 0
        for batch in batches:  # rows sorted by shard and position
            split, source, shard, position = (batch.column(i).to_pylist() for i in range(4))
            runs = _runs(batch.column(4))
            for i in range(batch.num_rows):
                key = split[i], source[i], shard[i]
                if key != now:
                    if out:
                        out.close()
                    folder = posixpath.join(base, *[x for x in key[:2] if x])
                    files.create_dir(folder, recursive=True)
                    final = posixpath.join(folder, f"{source[i]}_{shard[i]:04d}.bin")
                    part = f"{final}.{uuid.uuid4().hex}.tmp"
                    out, now, end = files.open_output_stream(part), key, 0
                    done.append((part, final))
                if position[i] != end:
                    raise ValueError(f"{now}: tokens are missing before position {position[i]}")
                try:
                    held = runs(i)
                except OverflowError as wide:
                    raise OverflowError(f"{now}: {wide}") from None
                end += len(held) // 2
                out.write(held)
        if out:
            out.close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _filesystem(self.root)
        for m in messages:
            for part, final in m.files if m else []:
                files.move(part, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _filesystem(self.root)
        for m in messages:
            for part, _final in m.files if m else []:
                files.delete_file(part)


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        if "ends" not in self.options:
            return READ_SCHEMA
        return OUTLINE_SCHEMA if self.options.get("outline") == "true" else ENDS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_shards(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, position, tokens) of all shards below a folder.  Filters on path and position are pushed down,
    for which Spark's own setting for Python sources is switched on."""
    spark.dataSource.register(TokenFiles)
    spark.conf.set(_PUSHDOWN, "true")
    return spark.read.format("token_files").options(path=root, parallelism=spark.sparkContext.defaultParallelism, **options).load()


def read_ends(spark: SparkSession, root: str, eos_id: int, **options) -> DataFrame:
    """The same with file_order and the ends of documents in each row."""
    return read_shards(spark, root, ends=eos_id, **options)


def read_outline(spark: SparkSession, root: str, eos_id: int, **options) -> DataFrame:
    """(path, position, n_tokens, low, high, file_order, ends) of the rows that ``read_shards`` gives: their
    sizes, least and largest ids and ends, without the tokens."""
    return read_shards(spark, root, ends=eos_id, outline="true", **options)


def write_shards(pieces: DataFrame, root: str) -> None:
    """``pieces``: split (may be null: no such folder), source, shard_index, position in the shard
    and tokens (arrays of ids, or their bytes as ``functions.tokenizers.narrowed`` makes them)."""
    pieces.sparkSession.dataSource.register(TokenFiles)
    keys = ["split", "source", "shard_index"]
    dealt = pieces.select(*keys, "position", "tokens").repartition(*keys).sortWithinPartitions(*keys, "position")
    dealt.write.format("token_files").mode("append").options(path=root).save()
