"""Files of named tensors as a Spark data source (``tensor_files``).

The format (``.safetensors``): a 64-bit length, a JSON header (name: dtype, shape, place of its bytes), the
bytes.  Partitions are byte ranges of files, made from their sizes alone; a task reads its file's header and
those elements whose first byte is in its range, so a tensor of any size is read in parallel and in bounded
memory, and no header passes the driver.  Rows are runs of a tensor's elements:

* by default (path, name, dtype, shape, elements, start, values, error),
* with the option ``outline`` what inspection needs, found as it is read: n, nonfinite, low, high (of the
  finite ones) in place of values,
* with ``headers`` one row for each tensor, and nothing behind the headers is read.

Whole numbers come as doubles, exact up to 2^53.  A file that does not hold what its header says gives one
row with an ``error`` and no name.

Writing: rows (name, shape, values); a task fills files of about ``file_bytes`` under temporary names, which the
commit renames, so a lost or repeated task leaves nothing behind.  A folder with such files is refused.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .tokenfiles import _filesystem

SUFFIX = ".safetensors"
#: Bytes of a range and elements of a row; bytes of a written file, about; the longest header that is read.
RANGE_BYTES, ROW_ELEMENTS, FILE_BYTES, MOST_HEADER = 64_000_000, 65_536, 256_000_000, 100_000_000
_HEAD = "path string, name string, dtype string, shape array<long>, elements long"
HEADER_SCHEMA = f"{_HEAD}, error string"
VALUE_SCHEMA = f"{_HEAD}, start long, values array<double>, error string"
OUTLINE_SCHEMA = f"{_HEAD}, start long, n long, nonfinite long, low double, high double, error string"
#: Fixed values of the format: its names of types, as NumPy has them (BF16 is read as the upper half of F32).
DTYPES = {
    "BOOL": "|b1", "U8": "|u1", "I8": "|i1", "U16": "<u2", "I16": "<i2", "F16": "<f2", "BF16": "<u2",
    "U32": "<u4", "I32": "<i4", "F32": "<f4", "U64": "<u8", "I64": "<i8", "F64": "<f8",
}


class Unreadable(ValueError):
    """A file does not hold what its header says."""


@dataclass
class Tensor:
    name: str
    dtype: str
    shape: list[int]
    position: int  # of its first byte in the file

    @property
    def elements(self) -> int:
        return math.prod(self.shape)

    @property
    def width(self) -> int:
        return np.dtype(DTYPES[self.dtype]).itemsize


def list_files(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of every tensor file below a folder, by path."""
    files, base = _filesystem(root)
    if files.get_file_info(base).type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = files.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIX))


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def read_header(f, size: int) -> list[Tensor]:
    """The tensors of an open file, by place; they must fill the file without gaps or overlaps."""
    length = int.from_bytes(f.read(8), "little")
    if size < 8 or length > min(size - 8, MOST_HEADER):
        raise Unreadable("the header is cut off or too long")
    try:
        told = json.loads(f.read(length).decode("utf-8"))
        own = [(k, v["dtype"], v["shape"], *v["data_offsets"]) for k, v in told.items() if k != "__metadata__"]
    except (ValueError, KeyError, TypeError, AttributeError):
        raise Unreadable("the header is not readable") from None
    for name, dtype, shape, *place in own:
        if dtype not in DTYPES:
            raise Unreadable(f"tensor {name} has the unknown type {dtype}")
        if not isinstance(shape, list) or len(place) != 2 or not all(map(_whole, [*shape, *place])):
            raise Unreadable(f"tensor {name} has no proper shape or place")
    at, out = 0, []
    for name, dtype, shape, begin, end in sorted(own, key=lambda x: x[3:]):
        t = Tensor(name, dtype, shape, 8 + length + begin)
        if begin != at or end - begin != t.elements * t.width:
            raise Unreadable(f"tensor {name} does not lie where its shape and its neighbours say")
        out.append(t)
        at = end
    if 8 + length + at != size:
        raise Unreadable("the file is longer or shorter than its header says")
    return out


def _decoded(raw: bytes, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, DTYPES[dtype])
    if dtype == "BF16":
        x = (x.astype(np.uint32) << 16).view(np.float32)
    return x.astype(np.float64)


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.range, self.most = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("row_elements", ROW_ELEMENTS))
        self.headers, self.outline = (options.get(o, "false") == "true" for o in ("headers", "outline"))

    def partitions(self) -> list[InputPartition]:
        step = (lambda size: max(size, 1)) if self.headers else (lambda size: self.range)
        return [ByteRange(p, n, a, min(a + step(n), max(n, 1))) for p, n in list_files(self.root) for a in range(0, max(n, 1), step(n))] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if not part.path:
            return
        rest = {HEADER_SCHEMA: 0, VALUE_SCHEMA: 2, OUTLINE_SCHEMA: 5}[self.schema()]
        with _filesystem(self.root)[0].open_input_file(part.path) as f:
            try:
                tensors = read_header(f, part.size)
            except Unreadable as why:
                if part.low == 0:
                    yield (part.path, None, None, None, None, *[None] * rest, str(why))
                return
            for t in tensors:
                head = (part.path, t.name, t.dtype, t.shape, t.elements)
                if self.headers:
                    yield (*head, None)
                    continue
                first, end = (min(max(-(-(at - t.position) // t.width), 0), t.elements) for at in (part.low, part.high))
                if not t.elements and part.low == 0:
                    yield (*head, 0, *((0, 0, None, None) if self.outline else ([],)), None)
                for a in range(first, end, self.most):
                    f.seek(t.position + a * t.width)
                    x = _decoded(f.read((min(a + self.most, end) - a) * t.width), t.dtype)
                    if self.outline:
                        good = x[np.isfinite(x)]
                        low, high = (float(good.min()), float(good.max())) if len(good) else (None, None)
                        yield (*head, a, len(x), len(x) - len(good), low, high, None)
                    else:
                        yield (*head, a, x.tolist(), None)

    def schema(self) -> str:
        return HEADER_SCHEMA if self.headers else OUTLINE_SCHEMA if self.outline else VALUE_SCHEMA


@dataclass
class _Done(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.dtype = options["path"], options.get("dtype", "F32")
        self.most = int(options.get("file_bytes", FILE_BYTES))
        if self.dtype not in ("F16", "F32", "F64"):
            raise ValueError(f"tensors are written as F16, F32 or F64, not {self.dtype}")
        files, base = _filesystem(self.root)
        files.create_dir(base, recursive=True)
        if list_files(self.root):
            raise FileExistsError(f"{self.root} holds tensor files")
        self.work = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = _filesystem(self.root)
        done, held, size = _Done([]), {}, 0

        def flush() -> None:
            at, told = 0, {}
            for name, (shape, raw) in held.items():
                told[name] = {"dtype": self.dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
                at += len(raw)
            head = json.dumps(told, separators=(",", ":")).encode()
            head += b" " * (-len(head) % 8)
            path = posixpath.join(base, f"{self.work}.tmp", uuid.uuid4().hex)
            files.create_dir(posixpath.dirname(path), recursive=True)
            with files.open_output_stream(path) as f:
                f.write(len(head).to_bytes(8, "little") + head)
                for _, raw in held.values():
                    f.write(raw)
            done.paths.append(path)

        for batch in batches:
            for name, shape, values in zip(*(batch.column(i) for i in range(3))):
                name, shape = name.as_py(), shape.as_py()
                x = values.values
                if name in held or x is None or x.null_count or math.prod(shape) != len(x):
                    raise ValueError(f"tensor {name} is there twice, holds nulls or does not have the shape {shape}")
                held[name] = (shape, x.to_numpy(zero_copy_only=False).astype(DTYPES[self.dtype]).tobytes())
                size += len(held[name][1])
                if size >= self.most:
                    flush()
                    held, size = {}, 0
        if held:
            flush()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _filesystem(self.root)
        paths = [p for m in messages if m for p in m.paths]
        for i, path in enumerate(paths):
            files.move(path, posixpath.join(base, f"part-{i + 1:05d}-of-{len(paths):05d}{SUFFIX}"))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _filesystem(self.root)
        work = posixpath.join(base, f"{self.work}.tmp")
        if files.get_file_info(work).type != pafs.FileType.NotFound:
            files.delete_dir(work)


class TensorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        return _Reader(self.options).schema()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tensor files are never overwritten; remove the old ones first")
        return _Writer(self.options)


def read_tensors(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The tensors below a folder; options ``outline``, ``headers``, ``range_bytes``, ``row_elements``."""
    spark.dataSource.register(TensorFiles)
    told = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    return spark.read.format("tensor_files").options(path=folder, **told).load()


def write_tensors(tensors: DataFrame, folder: str, **options) -> None:
    """Rows (name, shape, values) as tensor files; options ``dtype`` and ``file_bytes``."""
    tensors.sparkSession.dataSource.register(TensorFiles)
    rows = tensors.selectExpr("name", "cast(shape as array<bigint>) as shape", "cast(values as array<double>) as values")
    rows.write.format("tensor_files").mode("append").options(path=folder, **options).save()
