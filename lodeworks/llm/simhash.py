"""SimHash near-dedup: bit-sliced Hamming comparison of whole-text fingerprints.

1. ``fingerprints``: one 64-bit majority fingerprint per document (``fingerprint.py``).
2. Equal fingerprints collapse to one row.  A distinct fingerprint is filed under ten keys: any two
   of five bit blocks.  Three differing bits leave two blocks alike, so linked fingerprints share a
   key: no link is lost, at any size.
3. Rows of a key come together.  A key with more than ``BLOCK`` rows is dealt out as pairs of
   blocks, so no task ever holds an unbounded group.
4. A block is compared bit-sliced: its fingerprints become 64 vertical bit planes, 64 candidates to
   a machine word.  A carry-save counter of two bits and an overflow plane takes the planes one by
   one; a word whose candidates all exceed the radius is abandoned.
5. Each block sends a spanning forest of the links found (never all pairs); connected components
   join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, written
from .components import connected_components
from .fingerprint import fingerprint

BLOCK = 256
#: Rows compared in one go; groups are not cut.
_CHUNK = 1024
_WIDTHS = (13, 13, 13, 13, 12)
_OFFSETS = tuple(sum(_WIDTHS[:i]) for i in range(5))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes after which abandoned words are dropped.
_CHECK = 8


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): signed 64-bit SimHash of each whole text; null and word-less texts have 0."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit plane p holds bit p of every fingerprint, 64 fingerprints to a word."""
    n = -(-len(fps) // 64) * 64
    full = np.zeros(n, np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, candidate) that differ in at most ``radius`` (0 to 3) bits, bit-sliced."""
    if not len(queries) or not len(fps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    vertical = planes(fps)
    words = vertical.shape[1]
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(words), indexing="ij"))
    one = np.zeros(len(q), np.uint64)
    two, over = one.copy(), one.copy()
    tail = np.full(words, _ONES)
    if len(fps) % 64:
        tail[-1] = np.uint64((1 << (len(fps) % 64)) - 1)
    over |= ~tail[w]
    for p in range(64):
        wanted = (queries >> np.uint64(p) & np.uint64(1)) * _ONES  # the query's bit, in every lane
        differs = vertical[p][w] ^ wanted[q]
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if p % _CHECK == _CHECK - 1 or p == 63:
            live = over != _ONES
            if p < 63 and live.mean() < 0.75:
                q, w, one, two, over = q[live], w[live], one[live], two[live], over[live]
    # counts are exact up to three: drop those above the radius
    above = {3: over, 2: over | (two & one), 1: over | two, 0: over | two | one}[radius]
    within = ~above
    hit = np.flatnonzero(within)
    lanes = np.unpackbits(within[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return q[hit][row], w[hit][row] * 64 + lane


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (child, root) of the links, with the smallest index as each tree's root."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, t) for x in range(n) if (t := top(x)) != x]


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); whole groups are gathered into chunks and compared."""

    def compare(fps: np.ndarray) -> pa.RecordBatch:
        fps = np.unique(fps)
        a, b = close_pairs(fps, fps)
        keep = a < b
        tree = np.array(forest(len(fps), a[keep], b[keep]), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[tree[:, 0]].view(np.int64)), pa.array(fps[tree[:, 1]].view(np.int64))], ["a", "b"])

    held_fp, held_key = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
    for batch in batches:
        key = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
        held_key = np.concatenate([held_key, key])
        held_fp = np.concatenate([held_fp, batch.column(3).to_numpy().view(np.uint64)])
        starts = np.flatnonzero((held_key[1:] != held_key[:-1]).any(axis=1)) + 1
        at = 0
        while True:  # cut at the last group start that keeps the chunk small, or else at the next
            fit = starts[(starts > at) & (starts <= at + _CHUNK)]
            cut = fit[-1] if len(fit) else next(iter(starts[starts > at]), None)
            if cut is None or len(held_fp) - at <= _CHUNK:
                break
            yield compare(held_fp[at:cut])
            at = int(cut)
        held_fp, held_key = held_fp[at:], held_key[at:]
    if len(held_fp):
        yield compare(held_fp)


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): forests whose components are those of all pairs of ``fp`` within three bits."""
    keys = []
    for n, pair in enumerate(combinations(range(5), 2)):
        i, j = pair
        parts = [F.shiftrightunsigned("fp", _OFFSETS[k]).bitwiseAND(F.lit((1 << _WIDTHS[k]) - 1)) for k in (i, j)]
        keys.append(F.lit(n << 26).cast("long") + F.shiftleft(parts[0], 13) + parts[1])
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cuts = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    together = (
        filed.join(sizes, "key")
        .withColumn("cuts", cuts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = together.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_block_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component): documents whose fingerprints link, directly or not, share the component.

    Links are fingerprints at three or fewer differing bits.  component: the smallest id reachable,
    itself included; a document without links is its own component.  Null, empty and word-less
    texts have fingerprint zero and are linked like any other.  Rows with a null id are kept, with
    the smallest non-null id of their component (null if there is none).  Other columns of ``docs``
    are ignored.
    """
    made = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", width), "simhash")
    distinct = made.groupBy("fp").agg(F.min("id").alias("least"))
    comps = connected_components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = named.join(smallest, "root").select("fp", "component")
    return made.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")


def hex_digits(fp):
    """A signed 64-bit column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
