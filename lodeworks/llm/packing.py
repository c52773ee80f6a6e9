"""Best-fit decreasing packing of pieces into fixed-capacity sequences.

Lengths are whole numbers from 1 to the capacity, so all that best-fit decreasing needs to know is
how many pieces have each length: at most ``capacity`` rows, whatever the corpus.  The driver packs
that histogram with a segment tree over remaining capacities (``plan``): the tightest open bin is
found in logarithmic time and bins that are alike are handled as one range, which gives exactly the
bins that best-fit decreasing gives piece by piece.  Executors then rank the pieces within each
length and read their place off the plan.  A length that a third of all pieces share is ranked in
hashed buckets, so no task holds it alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written
from .wordtokens import WordTokenizer, default_vocabulary, steps

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks, on average; and the fewest buckets of a length.
_RANKED, _BUCKETS = 50_000, 128


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which are held by an open bin?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, r: int, held: bool) -> None:
        i = r + self.size
        self.any[i] = held
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, least: int) -> int | None:
        """The smallest held capacity that is at least ``least``."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass
class Plan:
    """Places by length and rank: rank r of a run goes to bin first + (r - low) // each, at offset
    start + (r - low) % each * length."""

    length: np.ndarray
    low: np.ndarray
    first: np.ndarray
    each: np.ndarray
    start: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # runs are sorted by (length, low); ranks stay below 2^48
        key = (self.length.astype(np.int64) << 48) + self.low
        i = np.searchsorted(key, (length.astype(np.int64) << 48) + rank, side="right") - 1
        within = rank - self.low[i]
        return self.first[i] + within // self.each[i], self.start[i] + within % self.each[i] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over a histogram of lengths."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, low = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            whole, some = divmod(min(left, n * each), each)
            runs.append((length, low, first, each, capacity - room))
            put(room - each * length, first, whole)
            if some:
                put(room - some * length, first + whole, 1)
            put(room, first + whole + bool(some), n - whole - bool(some))
            low += whole * each + some
            left -= whole * each + some
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*cols, bins)


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset (long): every piece in a sequence of ``capacity``.

    ``keys`` tell pieces apart, spread those of one length over buckets and order them there; pieces
    alike in all keys share a bucket, in any order.  Lengths must be 1 to ``capacity``.  ``pieces`` is read twice and must give the same
    rows each time: pass a written table.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    todo = plan(counts, capacity)
    buckets = max(_BUCKETS, -(-max(counts.values(), default=0) // _RANKED))
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy(length, "_bucket").orderBy(*keys)
    ranked = (
        spread.withColumn("_row", F.row_number().over(order) - 1)
        .join(bases, [length, "_bucket"])
        .withColumn("_rank", F.col("_base") + F.col("_row"))
        .select(*pieces.columns, "_rank")
    )
    at = pieces.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, offset = todo.place(b.column(at).to_numpy().astype(np.int64), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Cut each whole text's token ids, and ``end_id`` after them, into pieces of ``capacity``.

    Returns id, piece (int, from 0), start, length, ids_crc32 (long: unsigned CRC-32 of the
    little-endian unsigned 32-bit ids) and, if asked for, ids (array of long).  A null or empty text
    is the end id alone, so every row has a piece.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.opened(path)
        for whole in batches:
            for batch in steps(whole, 1):
                ids, bounds = tok.encode_column(batch.column(1))
                row, piece, start, length, crc, held = [], [], [], [], [], []
                cuts = bounds.tolist()
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    total = b - a + 1
                    for k, s in enumerate(range(0, total, capacity)):
                        own = ids[a + s : min(a + s + capacity, b)]
                        c = zlib.crc32(own.tobytes())
                        if s + capacity >= total:
                            c = zlib.crc32(end.tobytes(), c)
                            own = np.concatenate([own, end]) if with_ids else own
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(min(capacity, total - s))
                        crc.append(c)
                        if with_ids:
                            held.append(own.astype(np.int64))
                cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **how) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``token_pieces`` and ``pack``.

    An empty table gives no rows.  Rows with null or repeated ids are packed like any other.  Other
    columns are ignored.
    """
    pieces = token_pieces(docs, id_col, text_col, capacity=capacity, **how).withColumn("_place", F.monotonically_increasing_id())
    return pack(written(pieces, "pieces"), ["_place"], capacity=capacity).drop("_place")  # equal rows are told apart too


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces packed with their ids.

    A group holds one sequence, at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
