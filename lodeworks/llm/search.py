"""Ranked lexical search: the best documents for every item, by block-skipping over posting shards.

Documents are read once.  Every task turns its documents into index shards of bounded size (the
items' terms only): postings in document order, occurrences, document lengths.  A shard is a row of a
written table, so the search that follows needs no shuffle.  Once the corpus' counts are known, each
shard cuts its posting lists into blocks of variable size, by dynamic programming over where the
blocks end (``blocks``), so that the best posting of a block says as much as it can about the others.

An item's search is WAND, many documents at a time with NumPy.  Its terms are ordered by what they can add at
most.  The documents of the first few set the score to reach; with it the pivot is found, the place from which on the
remaining terms cannot reach it together, so documents that hold none of the terms before it are never
looked at.  Of the terms before it, a block is skipped if it lies only over runs of documents that the best
scores of all blocks there do not bring to that score.  The terms behind the pivot are looked up for the
documents that they can still bring there, fewer with each term.  What is found is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import lean, small_batches, written
from .terms import ALPHANUMERIC, steps, terms

BEST = 50
#: An index shard ends after so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 2_000_000
#: Longest block, and what a block costs in units of bound error (a posting scores up to 10^6).
LONGEST_BLOCK, BLOCK_COST = 64, 1_000_000
#: Bytes of items that one pass over the shards carries.
PASS_BYTES = 8_000_000
#: The first terms of a search have so many postings for each of the best that are wanted.
_FIRST_POSTINGS = 2
#: Posting lists that are cut side by side; buckets in which the shards' best meet first.
_ABREAST, _MERGE = 4096, 64


@dataclass
class Items:
    """Items of one pass: a column of their ids, their distinct terms, and each one's terms by number."""

    ids: pa.Array
    words: pa.Array
    of: list[np.ndarray]

    @classmethod
    def read(cls, ids: pa.Array, texts: pa.Array) -> Items:
        found = terms(texts, ALPHANUMERIC)
        b = found.bounds
        return cls(ids, found.distinct, [np.unique(found.codes[b[i] : b[i + 1]]) for i in range(len(ids))])


@dataclass
class Counts:
    """Documents with a term, all their terms, and the weight of each of the items' terms."""

    docs: int
    words: int
    weight: np.ndarray

    def norms(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms each."""
        sizes, at = np.unique(n, return_inverse=True)
        return np.array([50 + 50 * int(x) * self.docs // self.words for x in sizes], np.int64)[at]


def weight(docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self, names: list[str], schema: pa.Schema):
        self.names, self.schema = names, schema
        self.clear()

    def clear(self) -> None:
        self.ids, self.n, self.doc, self.term, self.tf, self.docs, self.postings = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(ids)
        self.n.append(n)
        self.doc.append(doc + self.docs)
        self.term.append(term)
        self.tf.append(tf)
        self.docs += len(ids)
        self.postings += len(doc)

    def full(self) -> bool:
        return self.docs >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        """The shard, its documents in order of their ids (equal scores are told apart by them)."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.concatenate(self.n)[order]
        doc, term, tf = place[np.concatenate(self.doc)], np.concatenate(self.term), np.concatenate(self.tf)
        by = np.lexsort((doc, term))
        own, first = np.unique(term[by], return_index=True)
        values = [[ids.take(pa.array(order))], [n.astype("<i8").tobytes()], [own.astype("<i4").tobytes()], [np.append(first, len(by)).astype("<i8").tobytes()], [doc[by].astype("<i4").tobytes()], [tf[by].astype("<i8").tobytes()]]
        cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), values[0][0])] + [pa.array(v, pa.binary()) for v in values[1:]]
        self.clear()
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, self.schema)], self.names)


def index(docs: DataFrame, words: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """Rows of index shards: ids (array), n, terms, ends, docs, tf (packed numbers).  A task's documents
    make one shard or more; texts without a term are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"ids array<{kind}>, n binary, terms binary, ends binary, docs binary, tf binary"
    schema = to_arrow_schema(_parse_datatype_string(fields))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Shard(schema.names, schema)
        for whole in batches:
            for batch in steps(whole, 1):
                found = terms(batch.column(1), ALPHANUMERIC)
                n = np.diff(found.bounds)
                some = np.flatnonzero(n)
                known = pc.index_in(found.distinct, words)
                number = pc.fill_null(known, -1).to_numpy()[found.codes] if len(found.codes) else np.zeros(0, np.int64)
                at = number >= 0
                keys, tf = np.unique(found.text_of()[at] * max(1, len(words)) + number[at], return_counts=True)
                doc, term = np.divmod(keys, max(1, len(words)))
                held.add(batch.column(0).take(pa.array(some)), n[some], np.searchsorted(some, doc), term, tf)
                if held.full():
                    yield held.row()
        if held.docs:
            yield held.row()

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, fields)


def block_ends(scores: np.ndarray, firsts: np.ndarray, longest: int = LONGEST_BLOCK, cost: int = BLOCK_COST) -> np.ndarray:
    """Where the blocks of posting lists end (positions in ``scores``, ascending).

    ``firsts``: where each list begins, and the end.  Of all cuts of a list into blocks of at most
    ``longest`` postings, the one whose bound error (the sum over postings of their block's best score
    less their own) and ``cost`` for each block come to the least.  Lists are cut side by side, one
    posting of each at a time.
    """
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    ends = [np.zeros(0, np.int64)]
    for a in range(0, len(order), _ABREAST):
        group = order[a : a + _ABREAST]
        ends.append(_cut(scores, firsts[:-1][group], lengths[group], longest, cost))
    return np.sort(np.concatenate(ends))


def _cut(scores: np.ndarray, begin: np.ndarray, lengths: np.ndarray, longest: int, cost: int) -> np.ndarray:
    """``block_ends`` of some lists, the longest first, in any order of ends."""
    lists, most = len(lengths), int(lengths[0])
    if most == 1:
        return begin + 1
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    cut_before = np.zeros(int(lengths.sum()), np.int64)  # of the best cut that ends here: where its last block begins
    top = np.zeros((lists, longest), np.int64)  # best score since each of the last starts
    spent = np.zeros((lists, longest), np.int64)  # the least cost up to each of them
    started = np.zeros(longest, np.int64)
    least = np.zeros(lists, np.int64)
    live = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # lists that have a j-th posting
    for j in range(most):
        k, slot, width = live[j], j % longest, min(j + 1, longest)
        s = scores[begin[:k] + j]
        top[:k, slot], spent[:k, slot], started[slot] = s, least[:k] + cost, j
        np.maximum(top[:k, :width], s[:, None], out=top[:k, :width])
        total = spent[:k, :width] + (j + 1 - started[:width]) * top[:k, :width]
        best = total.argmin(axis=1)
        least[:k] = total[np.arange(k), best]
        cut_before[base[:k] + j] = started[best]
    ends, at, todo = [], lengths.copy(), np.flatnonzero(lengths)
    while len(todo):  # walk back
        ends.append(begin[todo] + at[todo])
        at[todo] = cut_before[base[todo] + at[todo] - 1]
        todo = todo[at[todo] > 0]
    return np.concatenate(ends)


class Postings:
    """A shard ready for search."""

    def __init__(self, row: dict, counts: Counts):
        self.terms = np.frombuffer(row["terms"], "<i4").astype(np.int64)
        self.firsts = np.frombuffer(row["ends"], "<i8")
        self.docs = np.frombuffer(row["docs"], "<i4").astype(np.int64)
        m = counts.norms(np.frombuffer(row["n"], "<i8"))
        self.scores = impacts(np.frombuffer(row["tf"], "<i8"), m[self.docs])
        self.weights = counts.weight[self.terms]
        ends = block_ends(self.scores, self.firsts)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.starts, self.ends, self.looked_at = starts, ends, 0
        self.block_first = np.searchsorted(starts, self.firsts)  # a list's blocks
        self.low, self.high = (self.docs[starts], self.docs[ends - 1]) if len(ends) else (ends, ends)
        self.best = np.maximum.reduceat(self.scores, starts) if len(ends) else ends
        self.list_best = np.maximum.reduceat(self.scores, self.firsts[:-1]) if len(ends) else ends

    def search(self, wanted: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best for an item's terms, best first, equal ones by document."""
        lists = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True) & (self.weights > 0))
        most = self.weights[lists] * self.list_best[lists]
        order = np.argsort(-most, kind="stable")
        lists, most = lists[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the lists from here on can add
        size = np.cumsum(self.firsts[lists + 1] - self.firsts[lists])
        # the documents of the most telling terms set what the others must reach
        some = min(len(lists), int(np.searchsorted(size, _FIRST_POSTINGS * best)) + 1)
        docs, scores = self._best_of(lists, some, rest, 1, None, best)
        least = int(scores[best - 1]) if len(scores) >= best else 1
        # a document of none of the first lists, up to the pivot, cannot reach it
        pivot = int(np.searchsorted(-rest, -least, side="right"))
        if pivot <= some:
            return docs, scores
        return self._best_of(lists, pivot, rest, least, self._runs(lists, least), best)

    def _runs(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(borders, open): runs of documents between the ends of blocks, and whether the best scores of the
        blocks that lie over a run come to ``least``."""
        blocks, n = self._blocks(lists)
        worth = np.repeat(self.weights[lists], n) * self.best[blocks]
        borders, at = np.unique(np.concatenate((self.low[blocks], self.high[blocks] + 1)), return_inverse=True)
        change = np.zeros(len(borders), np.int64)
        np.add.at(change, at[: len(blocks)], worth)
        np.add.at(change, at[len(blocks) :], -worth)
        return borders, np.cumsum(change) >= least

    def _blocks(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, n = self.block_first[lists], self.block_first[lists + 1] - self.block_first[lists]
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n

    def _best_of(self, lists: np.ndarray, pivot: int, rest: np.ndarray, least: int, runs: tuple[np.ndarray, np.ndarray] | None, best: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents that hold one of the first ``pivot`` terms and score ``least`` or more.

        Of these terms, blocks that lie over no open run are skipped.  The other terms are looked up only
        for documents that they can still bring to ``least``.
        """
        found, worth = [], []
        for i in lists[:pivot]:
            at = self._postings_in(i, runs)
            found.append(self.docs[at])
            worth.append(self.weights[i] * self.scores[at])
            self.looked_at += len(at)
        docs, of = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        total = np.zeros(len(docs), np.int64)
        if found:
            np.add.at(total, of, np.concatenate(worth))
        for k in range(pivot, len(lists)):
            able = total + rest[k] >= least
            docs, total = docs[able], total[able]
            a, b = self.firsts[lists[k]], self.firsts[lists[k] + 1]
            at = a + np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1)
            hit = self.docs[at] == docs
            total[hit] += self.weights[lists[k]] * self.scores[at[hit]]
            self.looked_at += int(hit.sum())
        docs, total = docs[total >= least], total[total >= least]
        keep = np.lexsort((docs, -total))[:best]
        return docs[keep], total[keep]

    def _postings_in(self, i: int, runs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """A list's postings in blocks that lie over an open run."""
        a, b = self.block_first[i], self.block_first[i + 1]
        if runs is None:
            return np.arange(self.firsts[i], self.firsts[i + 1])
        borders, is_open = runs
        opened = np.concatenate(([0], np.cumsum(is_open)))
        over = opened[np.searchsorted(borders, self.high[a:b] + 1)] > opened[np.searchsorted(borders, self.low[a:b])]
        starts, n = self.starts[a:b][over], (self.ends[a:b] - self.starts[a:b])[over]
        return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _counts(spark: SparkSession, shards: DataFrame, words: int) -> Counts:
    """Added up where the shards are; what comes back is a number for each of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, docs, total = np.zeros(words, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], "<i8")
                docs, total = docs + len(n), total + int(n.sum())
                frequency[np.frombuffer(row["terms"], "<i4")] += np.diff(np.frombuffer(row["ends"], "<i8"))
        used = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()], pa.int32()), pa.array([docs, total, *frequency[used].tolist()], pa.int64())], ["term", "n"])

    sums = dict(shards.select("n", "terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    docs = sums.get(-2, 0)
    return Counts(docs, sums.get(-1, 0), np.array([weight(docs, sums.get(t, 0)) for t in range(words)], np.int64))


def _found(shards: DataFrame, items: Items, counts: Counts, best: int, fields: str) -> DataFrame:
    names = [f.name for f in _parse_datatype_string(fields).fields]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % _MERGE
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard = Postings({c: row.column(c)[0].as_py() for c in ("n", "terms", "ends", "docs", "tf")}, counts)
                got = [shard.search(wanted, best) for wanted in items.of]
                item = np.repeat(np.arange(len(got)), [len(d) for d, _ in got])
                docs, scores = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
                cols = [pa.array(item, pa.int32()), items.ids.take(pa.array(item)), row.column("ids").flatten().take(pa.array(docs)), pa.array(scores, pa.int64()), pa.array(np.full(len(item), part), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return shards.mapInArrow(run, fields)


def _best(rows: DataFrame, by: list[str], id_col: str, best: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's ``best`` documents with a score above 0.

    Equal scores are ranked by ascending id (null first; rows alike in both in any order, each with a
    rank of its own).  A null or empty text has no terms: such documents are not counted or found, such
    items find nothing.  Every row is a document, and every row an item, also where ids are repeated.
    Other columns are not looked at.  Whole texts are read, once for every ``PASS_BYTES`` of items, as an
    item's terms travel with the search; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = size // PASS_BYTES + 1
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    fields = f"_item int, `{item_col}` {item_kind}, `{id_col}` {doc_kind}, score long, _part int"
    out = None
    for k in range(passes):
        own = items.select(F.col(item_col), F.col(item_text).alias("_text")).filter(F.pmod(F.xxhash64("_text"), F.lit(passes)) == k).toArrow()
        read = Items.read(*(own.column(i).combine_chunks() for i in (0, 1)))
        shards = written(index(docs, read.words, id_col, text_col), "shards")
        rows = _found(shards, read, _counts(spark, shards, len(read.words)), best, fields)
        rows = _best(_best(rows, ["_item", "_part"], id_col, best), ["_item"], id_col, best).select(item_col, "rank", id_col, "score")
        out = rows if out is None else out.unionByName(rows)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
     total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
     tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
     weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, docs),
     norms AS (SELECT row, doc_id, 100 - 50 + (50 * len(w) * docs) // words AS m FROM d, total WHERE len(w) > 0),
     worth AS (SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS worth FROM tf JOIN weights USING (term) JOIN norms USING (row)),
     scored AS (SELECT item_id, row, doc_id, CAST(sum(worth) AS BIGINT) AS score FROM worth JOIN q USING (term) GROUP BY ALL HAVING sum(worth) > 0)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50
"""
