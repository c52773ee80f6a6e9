"""Best-fit decreasing packing into windows without padding.

A document's ids are first cut into full windows; what is left of it, shorter than a window, is one
piece.  Pieces go to windows by best-fit decreasing: a segment tree indexed by remaining capacity
finds the tightest open window.  As in ``packing``, all that this needs is how many pieces have each
length, at most ``capacity`` numbers whatever the corpus, and executors read each piece's place off the
plan.

Windows that are left open would be padded.  They are few when lengths are mixed and many when they
are not (a third of all documents may be copies of one).  Their pieces are poured, in order, into
fresh windows that they fill to the end: a piece that meets the end of a window is cut there, and only
such pieces are cut.  What the last window lacks is avoided by powers of two, as a sequence whose length
is one is not padded: its rest is dealt to sequences of falling powers.  An open window whose length
happens to be one stays as it is.  So no sequence is padded at all, and documents are cut only where
best fit alone would have padded.

Where a piece of an open window lies in that stream follows from the plan by arithmetic, so pouring is
no step of its own: executors work out each piece's parts alone.  Only the checksums of cut pieces need
their ids again, for which just those documents are tokenised once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetokens import ByteTokenizer, default_vocabulary
from .common import lean, row_keyed, small_batches, written
from .packing import Plan, plan
from .terms import steps

CAPACITY, END_ID = 1024, 0
#: Bytes of cut pieces' keys that may be broadcast; a key and its place take about so many.
BROADCAST_BYTES, _CUT_BYTES = 16_000_000, 64


@dataclass
class Pouring:
    """Which windows of a plan are poured out, and where their contents lie in the stream.

    Windows first[i]..first[i+1]-1 are alike: each holds fill[i] ids; a poured one's contents begin at
    base[i], those of the next at base[i] + fill[i], and so on.
    """

    first: np.ndarray
    fill: np.ndarray
    poured: np.ndarray
    base: np.ndarray
    total: int
    capacity: int
    windows: int

    @classmethod
    def of(cls, counts: dict[int, int], made: Plan, capacity: int) -> Pouring:
        of_length = np.array([counts[int(x)] for x in made.length], np.int64)
        same = np.append(made.length[1:] == made.length[:-1], False) if len(made.length) else np.zeros(0, bool)
        stop = np.where(same, np.append(made.low[1:], 0), of_length)
        n = stop - made.low  # pieces of each run
        whole, some = np.divmod(n, made.each)
        # every run fills some windows up to a place: full runs of a window, and the last one perhaps less
        a = np.concatenate((made.first, made.first + whole))
        b = np.concatenate((made.first + whole, made.first + whole + (some > 0)))
        upto = np.concatenate((made.start + made.each * made.length, made.start + some * made.length))
        first = np.unique(np.concatenate((a, b, [0])))
        first = first[first < max(1, made.bins)]
        fill = np.zeros(len(first), np.int64)
        for i, j, x in zip(np.searchsorted(first, a), np.searchsorted(first, b), upto):
            np.maximum(fill[i:j], x, out=fill[i:j])
        width = np.diff(np.append(first, made.bins))
        poured = (fill < capacity) & (fill & (fill - 1) != 0)
        ids = np.where(poured, fill * width, 0)
        return cls(first, fill, poured, np.cumsum(ids) - ids, int(ids.sum()), capacity, made.bins)

    def ends(self) -> np.ndarray:
        """Where the sequences of the stream's last, unfilled window end: falling powers of two."""
        rest, at, out = self.total % self.capacity, self.total - self.total % self.capacity, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                out.append(at)
        return np.array(out, np.int64)

    def parts(self, window: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, start, length, sequence, offset) of the parts of pieces placed by the plan, in order;
        start: the piece's ids before a part."""
        i = np.searchsorted(self.first, window, side="right") - 1
        poured = self.poured[i]
        low = np.where(poured, self.base[i] + (window - self.first[i]) * self.fill[i] + offset, 0)
        high = low + length
        full = self.total // self.capacity * self.capacity
        tail = self.ends()
        # borders of sequences inside a piece: multiples of the capacity up to the last full one, then the tail's
        crossed = np.where(poured, np.maximum(0, np.minimum(high - 1, full) // self.capacity - np.minimum(low, full) // self.capacity), 0)
        inner = tail[:-1]
        crossed += np.where(poured, np.searchsorted(inner, high, side="left") - np.searchsorted(inner, low, side="right"), 0)
        piece = np.repeat(np.arange(len(window)), crossed + 1)
        k = np.arange(len(piece)) - np.repeat(np.cumsum(crossed + 1) - crossed - 1, crossed + 1)
        start = low[piece] + 0
        for step in range(1, int(crossed.max(initial=0)) + 1):
            own = np.flatnonzero(k == step)
            start[own] = self._next(start[own - 1], full, tail)
        stop = high[piece]
        later = k < crossed[piece]
        stop[later] = start[np.flatnonzero(later) + 1]
        in_full = start < full
        inside = np.searchsorted(tail, start, side="right")
        begins = np.where(in_full, start // self.capacity * self.capacity, np.concatenate(([full], tail))[np.minimum(inside, len(tail))])
        number = self.windows + np.where(in_full, start // self.capacity, full // self.capacity + inside)
        moved = poured[piece]
        return piece, start - low[piece], stop - start, np.where(moved, number, window[piece]), np.where(moved, start - begins, offset[piece])

    def _next(self, at: np.ndarray, full: int, tail: np.ndarray) -> np.ndarray:
        """The border of sequences behind a place in the stream."""
        after = (at // self.capacity + 1) * self.capacity
        if not len(tail):
            return after
        return np.where(at < full, after, tail[np.minimum(np.searchsorted(tail, at, side="right"), len(tail) - 1)])


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(id, _file, _row, text) into id, _file, _row, start, length, ids_crc32, doc_tokens, ``_task`` and ``_nth``: which piece of its length
    it is among those that its task has cut."""
    end = np.array([end_id], "<u4")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = ByteTokenizer.opened(vocabulary), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in steps(whole, 3):
                ids, bounds = tok.encode_column(batch.column(3))
                total = np.diff(bounds) + 1
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[row] - start)
                crc = []
                for a, b, last in zip((bounds[row] + start).tolist(), (bounds[row] + start + length).tolist(), (start + length == total[row]).tolist()):
                    crc.append(zlib.crc32(end, zlib.crc32(ids[a : b - 1])) if last else zlib.crc32(ids[a:b]))
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(row), np.int64)
                each = np.bincount(length, minlength=capacity + 1)
                nth[order] = np.arange(len(row)) - np.repeat(np.cumsum(each) - each - met, each)
                met += each
                cols = [*(batch.column(i).take(pa.array(row)) for i in range(3)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)], names)

    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "_file", "_row", "start", "length", "ids_crc32", "doc_tokens", "_task", "_nth"]
    fields = f"id {kind}, _file long, _row long, start long, length long, ids_crc32 long, doc_tokens long, _task int, _nth long"
    return docs.mapInArrow(run, fields)


def _placed(pieces: DataFrame, made: Plan, pouring: Pouring) -> DataFrame:
    """The parts of all pieces; ``_cut``: the part is not its whole piece, its checksum is not known."""
    per_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["length", "_task"]).select("id", "_file", "_row", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_nth")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(4).to_numpy()
            window, offset = made.place(length, b.column(7).to_numpy())
            piece, start, part, sequence, place = pouring.parts(window, offset, length)
            cut = part != length[piece]
            at = pa.array(piece)
            numbers = [pa.array(b.column(3).to_numpy()[piece] + start), pa.array(part), b.column(5).take(at), b.column(6).take(at), pa.array(sequence), pa.array(place), pa.array(cut)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), *numbers], names)

    kind = pieces.schema["id"].dataType.simpleString()
    names = ["id", "_file", "_row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "_cut"]
    fields = f"id {kind}, _file long, _row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, _cut boolean"
    return ranked.mapInArrow(run, fields)


def _checksums(docs: DataFrame, cut: DataFrame, vocabulary: str, end_id: int, broadcast_bytes: int) -> DataFrame:
    """(_file, _row, start, ids_crc32) of the parts of cut pieces, from their documents' ids."""
    parts = cut.groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_parts"))  # of one piece, shorter than a window
    few = parts.count() * _CUT_BYTES <= broadcast_bytes
    met = docs.join(F.broadcast(parts) if few else parts, ["_file", "_row"]).select("_file", "_row", "_parts.start", "_parts.length", "text")
    end = np.array([end_id], "<u4")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteTokenizer.opened(vocabulary)
        for whole in batches:
            for batch in steps(whole, 4):
                ids, bounds = tok.encode_column(batch.column(4))
                row, start, crc = [], [], []
                for i, (a, b, starts, lengths) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    own = np.concatenate((ids[a:b], end))
                    row += [i] * len(starts)
                    start += starts
                    crc += [zlib.crc32(own[s : s + n]) for s, n in zip(starts, lengths)]
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(crc, pa.int64())], ["_file", "_row", "start", "_crc"])

    return met.mapInArrow(run, "_file long, _row long, start long, _crc long")


def pack_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every document's ids, and ``end_id``
    behind them, in pieces, and the place of each piece in a sequence of at most ``capacity`` ids.

    A null or empty text is its end id alone.  Sequences are filled without gaps, and no sequence is left
    to be padded: each holds ``capacity`` ids or a power of two.  Documents are rows: null, repeated and
    equal ids change nothing.  A very long text is cut into windows of its own, its rest is packed like any
    other.  Other columns are ignored; an empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    docs, key = row_keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows")
    docs = docs.select("id", key[0].alias("_file"), key[1].alias("_row"), "text")
    pieces = written(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    placed = written(_placed(pieces, made, Pouring.of(counts, made, capacity)), "placed")
    cut = placed.filter("_cut")
    sums = _checksums(docs, cut, vocabulary, end_id, broadcast_bytes)
    result = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    mended = cut.drop("ids_crc32").join(sums.withColumnRenamed("_crc", "ids_crc32"), ["_file", "_row", "start"])
    return placed.filter("not _cut").select(*result).unionByName(mended.select(*result)).withColumnRenamed("id", id_col)
