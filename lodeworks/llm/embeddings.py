"""Embedding near-dedup with randomised-rotation binary codes.

1. Equal vectors collapse.  Each distinct unit vector is padded, rotated by a seeded random rotation
   and stored as its sign bits with a correction factor f, the inner product of the rotated vector
   and its code.  For a rotated query q, <q, code> / f estimates the inner product without bias, and
   its error is known: about sqrt((1 - c^2)(1 - f^2) / (f^2 (D - 1))) at cosine c.  Queries are
   rounded at random to four bit planes, so an estimate is a handful of bit counts.
2. Candidates share a cell: a few signs of random hyperplanes, in so many tables that a pair at the
   threshold shares a cell with probability ``RECALL`` (closer pairs nearly always).  Cells hold about
   ``CELL`` vectors; the number of tables follows from the number of vectors, with no cap.
3. In a cell, pairs whose upper confidence bound is below the threshold are dropped.  Only vectors
   that are left with some pair send for their components.
4. What is left is recomputed exactly, in double precision.  A pair counts in the first table that
   it shares, so it counts once.  Tasks send counts and spanning forests, never all pairs; cells of
   more than ``BLOCK`` vectors are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, written
from .components import connected_components
from .simhash import forest

THRESHOLD, RECALL, CELL, BLOCK = 0.9, 0.9999, 256, 512
#: Bits of a code: the dimension padded to a multiple of 64, so many times.  Standard errors allowed.
PADDING, ERRORS = 1, 4.0
_PLANES = 4


def rotation(dimension: int, bits: int, seed: int = 7) -> np.ndarray:
    """The first ``dimension`` rows of a random rotation of ``bits`` dimensions (padding is zero)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension]


def tables_for(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL) -> tuple[int, int]:
    """(bits of a cell, tables) for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(1, vectors / cell))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - alike))


def cells(unit: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """n x tables: each table's sign pattern (int32)."""
    planes = np.random.default_rng([seed, unit.shape[1], bits, tables]).standard_normal((unit.shape[1], tables * bits))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


class Codes:
    """Codes, correction factors and rounded queries of unit vectors."""

    def __init__(self, code: np.ndarray, factor: np.ndarray, query: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray):
        self.code, self.factor, self.query, self.low, self.step, self.total = code, factor, query, low, step, total
        self.bits = code.shape[1] * 64

    @classmethod
    def of(cls, unit: np.ndarray, rotated_by: np.ndarray, seed: int = 5) -> Codes:
        turned = unit @ rotated_by
        n, bits = turned.shape
        code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        factor = np.abs(turned).sum(axis=1) / math.sqrt(bits)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << _PLANES) - 1), 1e-12)
        # the rounding of a vector depends on nothing but the vector
        coin = np.random.default_rng(seed).random(bits)
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + coin), 0, (1 << _PLANES) - 1).astype(np.uint8)
        planes = np.stack([np.packbits(level >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(_PLANES)], axis=1)
        return cls(code, factor, planes, low, step, turned.sum(axis=1))

    def estimates(self, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, standard error at the threshold's angle) of rows a as queries and b as data."""
        weighted = np.zeros((len(a), len(b)))
        ones = np.bitwise_count(self.code[b]).sum(axis=1, dtype=np.int64)
        for p in range(_PLANES):
            both = np.zeros((len(a), len(b)), np.int64)
            for w in range(self.code.shape[1]):
                both += np.bitwise_count(self.query[a, p, w][:, None] & self.code[b, w][None, :])
            weighted += both * (1 << p)
        dot = 2 * (self.low[a][:, None] * ones[None, :] + self.step[a][:, None] * weighted) - self.total[a][:, None]
        f = self.factor[b][None, :]
        estimate = dot / math.sqrt(self.bits) / f
        spread = np.sqrt((1 - f**2).clip(0) / f**2 / (self.bits - 1))
        rounding = self.step[a][:, None] / 2 / f
        return estimate, np.sqrt((spread * math.sqrt(max(0.0, 1 - threshold**2))) ** 2 + rounding**2)


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group."""
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _group(t: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return t.astype(np.int64) << 32 | cell


def _count(dimension: int, bits: int, tables: int):
    """(g, n): how many vectors of a batch are in each cell of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = cells(_unit(batch.column(0), dimension), bits, tables)
                g, n = np.unique(_group(np.arange(tables)[None, :], key), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])

    return run


def _file(dimension: int, bits: int, tables: int, code_bits: int):
    """For every vector and table a row (g: table and cell) with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimension, code_bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(1), dimension)
            c, key = Codes.of(unit, turn), cells(unit, bits, tables)
            packed = [np.concatenate([c.code[k].view(np.uint8), c.query[k].reshape(-1).view(np.uint8), np.array([c.factor[k], c.low[k], c.step[k], c.total[k]], np.float32).view(np.uint8)]).tobytes() for k in range(len(unit))]
            row = pa.array(np.repeat(np.arange(len(unit)), tables))
            cols = [pa.array(_group(np.arange(tables)[None, :], key).ravel()), batch.column(0).take(row), pa.array(packed, pa.binary()).take(row)]
            yield pa.RecordBatch.from_arrays(cols, ["g", "id", "code"])

    return run


def _unpack(column: pa.Array, code_bits: int) -> Codes:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    words = code_bits // 64
    code = np.ascontiguousarray(raw[:, : words * 8]).view(np.uint64)
    query = np.ascontiguousarray(raw[:, words * 8 : words * 8 * (1 + _PLANES)]).view(np.uint64).reshape(-1, _PLANES, words)
    return Codes(code, *(lambda r: (r[:, 0], query, r[:, 1], r[:, 2], r[:, 3]))(np.ascontiguousarray(raw[:, words * 8 * (1 + _PLANES) :]).view(np.float32).astype(np.float64)))


def _screen(code_bits: int, threshold: float, errors: float):
    """Of each group (g, p: blocks i and j) the rows that have a pair which may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p), rows in grouped(batches, 2):
            c, own, i, j = _unpack(rows.column(4), code_bits), rows.column(2).to_numpy(), p >> 32, p & 0xFFFFFFFF
            a, b = _pairs(own, i, j)
            if not len(a) or not len(b) or rows.num_rows < 2:
                continue
            estimate, error = c.estimates(a, b, threshold)
            may = estimate + errors * error >= threshold
            if i == j:
                np.fill_diagonal(may, False)
                may |= may.T  # a pair is left if either direction leaves it
            keep = np.zeros(rows.num_rows, bool)
            keep[a[may.any(axis=1)]] = True
            keep[b[may.any(axis=0)]] = True
            if keep.any():
                kept = rows.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(4)], ["g", "p", "own", "id"])

    return run


def _confirm(dimension: int, bits: int, tables: int, threshold: float):
    """Exact cosines of each group: forests (kind 0: id, other id) and counts (kind 1: id, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, p), rows in grouped(batches, 2):
            own, ids, t, i, j = rows.column(2).to_numpy(), rows.column(3).to_numpy(), g >> 32, p >> 32, p & 0xFFFFFFFF
            unit, times = _unit(rows.column(4), dimension), rows.column(5).to_numpy()
            a, b = _pairs(own, i, j)
            linked = unit[a] @ unit[b].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            key = cells(unit, bits, tables)[:, :t]
            for k in range(t):  # not the first table that the pair shares
                linked &= key[a, k][:, None] != key[b, k][None, :]
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, a, linked @ times[b])
            if i != j:
                np.add.at(count, b, linked.T @ times[a])
            x, y = np.nonzero(linked)
            tree = np.array(forest(len(ids), a[x], b[y]), dtype=np.int64).reshape(-1, 2)
            some = np.flatnonzero(count)
            kind = np.concatenate([np.zeros(len(tree), np.int32), np.ones(len(some), np.int32)])
            first = np.concatenate([ids[tree[:, 0]], ids[some]])
            second = np.concatenate([ids[tree[:, 1]], count[some]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first), pa.array(second)], ["kind", "x", "y"])

    return run


def usable(column: str):
    """Vectors that can link: not null, some component not zero, none null or non-finite."""
    c = F.col(column)
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(c.isNotNull() & ~odd & F.exists(c, lambda v: v != 0), F.lit(False))


def embedding_links(distinct: DataFrame, dimension: int, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(kind, x, y) of distinct vectors (id long, v array, times long); see ``_confirm``."""
    bits, tables = tables_for(distinct.count(), threshold, recall)
    code_bits = -(-dimension // 64) * 64 * PADDING
    sizes = distinct.select("v").mapInArrow(_count(dimension, bits, tables), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1")
    filed = distinct.select("id", "v").mapInArrow(_file(dimension, bits, tables, code_bits), "g long, id long, code binary")
    cuts = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    dealt = (
        filed.join(sizes.withColumn("cuts", cuts), "g")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("g", (F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")).alias("p"), "own", "id", "code")
    )
    # groups (i, i) hold one block's rows; groups of two blocks hold both
    screened = written(dealt.repartition("g", "p").sortWithinPartitions("g", "p").mapInArrow(_screen(code_bits, threshold, ERRORS), "g long, p long, own int, id long"), "screened")
    full = screened.join(distinct, "id").select("g", "p", "own", "id", "v", "times")
    return written(full.repartition("g", "p").sortWithinPartitions("g", "p").mapInArrow(_confirm(dimension, bits, tables, threshold), "kind int, x long, y long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    n_links: other rows with cosine of at least ``threshold``, copies counted singly; component_id:
    the smallest id reachable, itself included; kept: it is that one.  Vectors that are null, zero or
    hold null or non-finite components link with nothing.  Vectors of different dimension do not
    link.  Ids may have any type that can be ordered.  Rows with a null id have no links and a null
    component.  Rows that repeat an id are vectors like any other.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    able = rows.filter(usable("v") & F.col("id").isNotNull())
    # keys of the distinct vectors hold once they are written
    distinct = written(able.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]  # dimensions, not vectors
    found = None
    for dimension in sorted(sizes):
        own = embedding_links(distinct.filter(F.size("v") == dimension).select("id", "v", "times"), dimension, threshold, recall)
        found = own if found is None else found.unionAll(own)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    comps = connected_components(found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
    counts = found.filter("kind = 1").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("c"))
    named = (
        distinct.join(counts, "id", "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select("v", "least", (F.coalesce("c", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "id").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = able.join(named.join(smallest, "root"), "v").select("id", "n", "component")
    rest = rows.filter(~(usable("v") & F.col("id").isNotNull())).select("id", F.lit(0).cast("long"), "id")
    return linked.unionAll(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
