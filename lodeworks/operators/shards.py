"""Shards: greedy packing of documents, shard scans, and the corpus check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import stored
from .ordered import BLOCK, block_column, null_safe_join, with_prefix_sums

AFTER, BEFORE = "after", "before"
#: Documents of a stretch, about: a task holds two numbers for each.  Jumps that are joined to one.
STRETCH, _FAN = 4_000_000, 64


def _cut_from(total: np.ndarray, start, cap: int, rule: str):
    """Where the shards that begin at ``start`` (with nothing in them) close: the index of the next
    shard's first document.  ``total``: running sums of lengths, from 0."""
    if rule == AFTER:
        return np.searchsorted(total, total[start] + cap, side="left")
    # the next document would pass the cap, and the shard holds something
    return np.maximum(np.searchsorted(total[1:], total[start] + cap, side="right"), np.searchsorted(total, total[start], side="right"))


def _first_cut(total: np.ndarray, held: int, cap: int, rule: str) -> int:
    """The same for the open shard, which holds ``held`` tokens already."""
    if rule == AFTER:
        return int(np.searchsorted(total, cap - held, side="left"))
    return int(np.searchsorted(total[1:], cap - held, side="right") if held else _cut_from(total, 0, cap, rule))


def cut_points(lengths: np.ndarray, cap: int, rule: str, held: int = 0) -> tuple[np.ndarray, int]:
    """(new, held): which documents begin a new shard, given the tokens already in the open one.

    after: a shard closes once it has reached the cap, so it may pass it by one document.
    before: a shard closes if the next document would pass the cap, so only a single long document
    can.  A greedy walk: one binary search over running totals for every shard, not a step a row.
    """
    return _walk(lengths, cap, rule, held)[:2]


def _walk(lengths: np.ndarray, cap: int, rule: str, held: int) -> tuple[np.ndarray, int, bool]:
    """``cut_points``, and whether the last document closed its shard."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    new, last = np.zeros(len(lengths), bool), None
    at = _first_cut(total, held, cap, rule)
    while at < len(lengths):
        new[at], last = True, at
        at = int(_cut_from(total, at, cap, rule))
    if rule == AFTER and at == len(lengths):  # closed by the last document
        return new, 0, True
    return new, int(total[-1] - total[last]) if last is not None else held + int(total[-1]), False


@dataclass
class Jump:
    """What a stretch of documents does to the shard that is open when it begins.

    The open shard is known by its target: the running total at which the next one may begin, i.e. that
    of its first document and the cap.  A target up to ``edges[k]`` (and beyond the edge before) makes
    ``starts[k]`` shards begin here and leaves ``targets[k]``; one beyond all edges passes through.  Only
    documents at which the first of these shards can begin have an edge, a cap's worth of tokens however
    long the stretch, and those that lead to the same last shard share one.
    """

    edges: np.ndarray
    targets: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, before: np.ndarray, lengths: np.ndarray, begin: int, cap: int, rule: str) -> Jump:
        """``before``: running totals of documents whose stretch is from ``begin`` on, ascending."""
        after = before + lengths
        key, side = _entry(before, after, rule)
        first = np.arange(min(len(key), int(np.searchsorted(key, begin + cap, side)) + 1))
        at, starts, moving = first.copy(), np.ones(len(first), np.int64), first
        while len(moving):  # all entries at once, a shard at a time
            following = _next_start(before, after, at[moving], cap, rule)
            moving, following = moving[following < len(key)], following[following < len(key)]
            at[moving] = following
            starts[moving] += 1
        return cls(key[first], before[at] + cap, starts).joined()

    def joined(self) -> Jump:
        last = np.append((self.targets[1:] != self.targets[:-1]) | (self.starts[1:] != self.starts[:-1]), True)[: len(self.edges)]
        return Jump(self.edges[last], self.targets[last], self.starts[last])

    def apply(self, target: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
        """(targets, starts) behind the stretch."""
        k = np.searchsorted(self.edges, target, _SIDE[rule])
        inside = np.minimum(k, len(self.edges) - 1)
        here = k < len(self.edges)
        return np.where(here, self.targets[inside], target), np.where(here, self.starts[inside], 0)

    def then(self, rest: Jump, until: int, rule: str) -> Jump:
        """This stretch and the next: twice as far, no more edges.  ``until``: no target is beyond it."""
        targets, more = rest.apply(self.targets, rule)
        passing = rest.edges > self.edges[-1]  # of targets that pass through this stretch
        passing &= np.concatenate(([True], rest.edges[:-1] < until))
        return Jump(np.concatenate((self.edges, rest.edges[passing])), np.concatenate((targets, rest.targets[passing])), np.concatenate((self.starts + more, rest.starts[passing]))).joined()


#: A shard may begin with the first document whose running total is at least the target (after), or
#: whose end is beyond it (before).
_SIDE = {AFTER: "left", BEFORE: "right"}
#: The target of the first shard.
_FIRST = {AFTER: 0, BEFORE: -1}


def _entry(before: np.ndarray, after: np.ndarray, rule: str) -> tuple[np.ndarray, str]:
    return (before if rule == AFTER else after), _SIDE[rule]


def _next_start(before: np.ndarray, after: np.ndarray, at: np.ndarray, cap: int, rule: str) -> np.ndarray:
    """Where the shards behind those that begin at ``at`` begin."""
    key, side = _entry(before, after, rule)
    found = np.searchsorted(key, before[at] + cap, side)
    # a shard that may not pass its cap holds something all the same
    return found if rule == AFTER else np.maximum(found, np.searchsorted(before, before[at], "right"))


def _group_edges(batch: pa.RecordBatch, keys: int) -> list[int]:
    """Where rows differ from the one before in their first ``keys`` columns; 0 and the end, too."""
    differs = np.zeros(max(0, batch.num_rows - 1), bool)
    for i in range(keys):
        code = pa.compute.fill_null(batch.column(i).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        differs |= code[1:] != code[:-1]
    return [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]


def _gathered(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each group of sorted rows."""
    now, held = None, []
    for batch in batches:
        edges = _group_edges(batch, keys)
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(batch.column(i)[a].as_py() for i in range(keys))
            if held and key != now:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_JUMP = "edges array<bigint>, targets array<bigint>, starts array<bigint>"


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def _jumps_in(rows: pa.RecordBatch) -> list[Jump]:
    """The jumps of a batch, by its last three columns."""
    lists = rows.columns[-3:]
    cuts = [x.offsets.to_numpy() for x in lists]
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    return [Jump(*(f[c[i] : c[i + 1]] for f, c in zip(flat, cuts))) for i in range(rows.num_rows)]


def _jump_row(key: list, jump: Jump, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, jump.edges, jump.targets, jump.starts], schema)], schema=schema)


def jumps(summed: DataFrame, cap: int, rule: str, by: list[str], length: str, span: int) -> DataFrame:
    """(by..., _stretch, edges, targets, starts): the ``Jump`` of every stretch of ``span`` tokens; each is
    made where its documents' lengths are."""
    kinds, n = _kinds(summed, [*by, "_stretch"]), len(by) + 1
    schema = to_arrow_schema(_parse_datatype_string(kinds + _JUMP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _gathered(batches, n):
            yield _jump_row(list(key), Jump.of(rows.column(n).to_numpy(), rows.column(n + 1).to_numpy(), key[-1] * span, cap, rule), schema)

    slim = summed.select(*by, "_stretch", "_before", length).repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", "_before", length)
    return slim.mapInArrow(run, kinds + _JUMP)


def _lifted(made: DataFrame, cap: int, rule: str, by: list[str], span: int) -> DataFrame:
    """Jumps over ``_FAN`` stretches at a time."""
    kinds, n = _kinds(made, [*by, "_stretch"]), len(by) + 1
    schema = to_arrow_schema(_parse_datatype_string(kinds + _JUMP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _gathered(batches, n):
            own, begins = _jumps_in(rows), rows.column(n).to_numpy() * span
            whole = own[-1]
            for jump, begin in zip(own[-2::-1], begins[-2::-1]):
                whole = jump.then(whole, int(begin) + cap, rule)
            yield _jump_row(list(key), whole, schema)

    group = F.floor(F.col("_stretch") / _FAN).cast("long")
    dealt = made.select(*by, group.alias("_group"), "_stretch", *("edges", "targets", "starts")).repartition(*by, "_group").sortWithinPartitions(*by, "_group", "_stretch")
    return dealt.mapInArrow(run, kinds + _JUMP)


def _entries(made: DataFrame, cap: int, rule: str, by: list[str], span: int) -> DataFrame:
    """(by..., _stretch, _target, _shards): the open shard's target on entry to each stretch, and the shards
    begun before it.

    Jumps are lifted until a group has few; from there the chain is walked down again, level by level,
    all stretches of a level in parallel.
    """
    most = made.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    names, n = [*by, "_stretch"], len(by)
    if most > _FAN * _FAN:
        above = _entries(stored(_lifted(made, cap, rule, by, span), "jumps"), cap, rule, by, span * _FAN).withColumnRenamed("_stretch", "_group")
        grouped = null_safe_join(made.withColumn("_group", F.floor(F.col("_stretch") / _FAN).cast("long")), above, [*by, "_group"])
    else:
        grouped = made.withColumns({"_group": F.lit(0).cast("long"), "_target": F.lit(_FIRST[rule]).cast("long"), "_shards": F.lit(0).cast("long")})
    kinds = _kinds(made, names) + "_target bigint, _shards bigint"
    schema = to_arrow_schema(_parse_datatype_string(kinds))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, target, shards = None, 0, 0
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n + 4))))
            for key, jump in zip(keys, _jumps_in(batch)):
                if key[: n + 1] != now:
                    now, target, shards = key[: n + 1], key[n + 2], key[n + 3]
                out.append((*key[:n], key[n + 1], target, shards))
                a, b = jump.apply(np.array([target]), rule)
                target, shards = int(a[0]), shards + int(b[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    dealt = grouped.select(*by, "_group", "_stretch", "_target", "_shards", "edges", "targets", "starts").repartition(*by, "_group").sortWithinPartitions(*by, "_group", "_stretch")
    return dealt.mapInArrow(walk, kinds)


def assign_shards(
    docs: DataFrame, cap: int, rule: str, by: list[str], order: str, length: str = "n_tokens", keep: list[str] | None = None, width: int = BLOCK, stretch: int = STRETCH, ties: list[str] | None = None
) -> DataFrame:
    """(by..., order, ties..., keep..., length, shard_index, position): greedy packing of each group's
    documents in order; position: the tokens before a document in its shard.

    The rule is sequential, but a group is not.  Running totals are summed in blocks of about ``width``
    documents.  Stretches of about ``stretch`` documents (two shards at least) say in parallel where a
    shard that is open when they begin leads to (``Jump``); only the chain of these jumps is followed, and
    then all stretches are placed in parallel.  Only lengths are moved.  Null groups are groups; ``order``
    and ``ties`` must tell a group's documents apart, or alike ones come in any order.
    """
    if cap <= 0:
        raise ValueError("a shard must hold some tokens")
    keep, ties = keep or [], ties or []
    slim = docs.select(*by, order, *ties, *keep, F.col(length).cast("long").alias(length))
    names = [*by, order, *ties, *keep, length, "shard_index", "position"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + ", shard_index long, position long"
    block = block_column(slim, order, width)
    if block is None:
        dealt = slim.repartition(*by) if by else slim.coalesce(1)
        return dealt.sortWithinPartitions(*by, order, *ties).mapInArrow(_place_whole(len(by), cap, rule, names), fields)
    n, total = slim.agg(F.count("*"), F.sum(length)).first()
    caps = max(2, stretch * max(1, total) // max(1, n * cap))
    span = caps * cap
    summed = with_prefix_sums(slim, {"_before": F.col(length)}, [order, *ties], by, block).withColumn("_stretch", F.call_function("div", F.col("_before"), F.lit(span).cast("long")))
    summed = stored(summed, "running_totals")
    entered = _entries(stored(jumps(summed, cap, rule, by, length, span), "jumps"), cap, rule, by, span)
    met = null_safe_join(summed, entered, [*by, "_stretch"]).select(*by, "_stretch", "_target", "_shards", "_before", order, *ties, *keep, length)
    k = len(by)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _gathered(batches, k + 1):
            before, lengths = rows.column(k + 3).to_numpy(), rows.column(rows.num_columns - 1).to_numpy()
            shard, position = _along(before, lengths, rows.column(k + 1)[0].as_py(), rows.column(k + 2)[0].as_py(), cap, rule)
            yield pa.RecordBatch.from_arrays([*rows.columns[:k], *rows.columns[k + 4 :], pa.array(shard), pa.array(position)], names)

    return met.repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", "_before", length).mapInArrow(place, fields)


def _along(before: np.ndarray, lengths: np.ndarray, target: int, shards: int, cap: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(shard, position) of a stretch's documents, given the open shard's target and the shards so far."""
    after = before + lengths
    key, side = _entry(before, after, rule)
    new = np.zeros(len(key), bool)
    at = int(np.searchsorted(key, target, side))
    while at < len(key):
        new[at] = True
        at = int(_next_start(before, after, np.array([at]), cap, rule)[0])
    last = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
    return shards - 1 + np.cumsum(new), before - np.where(last < 0, target - cap, before[last])


def _place_whole(n: int, cap: int, rule: str, names: list[str]):
    """Places groups that are small enough to be followed row by row."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, 0, 0
        for batch in batches:
            edges = _group_edges(batch, n)
            lengths, out, at = batch.column(batch.num_columns - 1).to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = tuple(batch.column(i)[a].as_py() for i in range(n))
                if key != now:
                    now, shard, held = key, 0, 0
                out[a:b], at[a:b], shard, held = placed(lengths[a:b], cap, rule, shard, held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(at)], names)

    return place


def placed(lengths: np.ndarray, cap: int, rule: str, shard: int, held: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(shards, positions, shard, held): places of the next documents, and the open shard after them."""
    new, left, closed = _walk(lengths, cap, rule, held)
    before = np.concatenate(([0], np.cumsum(lengths)))
    last = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    shards = shard + np.cumsum(new)
    positions = np.where(last < 0, held + before[:-1], before[:-1] - before[last])
    return shards, positions, int(shards[-1]) + closed if len(shards) else shard, left


def shard_path(source: Column, index: Column) -> Column:
    """{source}_{index, four digits at least}.bin"""
    digits = index.cast("string")
    return F.concat(source, F.lit("_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".bin"))


_NAME = r"^(.+)_(\d+)\.bin$"


def name_parts(path: Column, root: str | None = None) -> tuple[Column, Column]:
    """(source, index) of a shard path.

    A name that does not parse has a null index; its source is the parent folder, relative to
    ``root`` if one is given (``<root>`` at the root itself), else just the folder's own name.
    """
    name = F.element_at(F.split(path, "/"), -1)
    parent = F.regexp_replace(path, "/?[^/]*$", "")
    if root is None:
        other = F.element_at(F.split(parent, "/"), -1)
    else:
        inner = F.regexp_replace(parent, "^" + root.rstrip("/") + "/?", "")
        other = F.when(inner == "", "<root>").otherwise(inner)
    fits = name.rlike(_NAME)
    index = F.when(fits, F.regexp_extract(name, _NAME, 2).cast("long"))
    return F.when(fits, F.regexp_extract(name, _NAME, 1)).otherwise(other), index


def scan(pieces: DataFrame, by: list[str], tokens: str, position: str, eos_id: int, vocab_size: int) -> DataFrame:
    """Per shard: bytes, tokens, eos_tokens, min and max id, ends_with_eos, error, warning.

    ``pieces``: arrays of tokens with their position in the shard; each is summed up where it is, so no
    token becomes a row, and a shard is a few numbers for every piece.
    """
    t = F.col(tokens)
    ends = F.size(F.filter(t, lambda x: x == eos_id)).cast("long")
    return _summed(pieces.filter(F.size(t) > 0), by, F.col(position), F.size(t).cast("long"), ends, F.array_min(t), F.array_max(t), F.element_at(t, -1) == eos_id, vocab_size)


def scan_outline(outlines: DataFrame, by: list[str], vocab_size: int) -> DataFrame:
    """``scan`` of shards whose reader has looked at the tokens (``sources.tokenfiles.read_outline``)."""
    n = F.col("n_tokens")
    return _summed(outlines, by, F.col("position"), n, F.size("ends").cast("long"), F.col("low"), F.col("high"), F.coalesce(F.try_element_at(F.col("ends"), F.lit(-1)) == n, F.lit(False)), vocab_size)


def _summed(pieces: DataFrame, by: list[str], position: Column, n: Column, ends: Column, low: Column, high: Column, ended: Column, vocab_size: int) -> DataFrame:
    each = pieces.select(*by, position.alias("_p"), n.alias("_n"), ends.alias("_e"), low.alias("_low"), high.alias("_high"), ended.alias("_ended"))
    made = each.groupBy(*by).agg(
        (F.sum("_n") * 2).alias("bytes"),
        F.sum("_n").alias("tokens"),
        F.sum("_e").alias("eos_tokens"),
        F.min("_low").alias("min_token_id"),
        F.max("_high").alias("max_token_id"),
        F.max_by("_ended", "_p").alias("ends_with_eos"),
    )
    out = F.concat(F.lit("ids "), F.col("min_token_id"), F.lit(" to "), F.col("max_token_id"), F.lit(f" do not fit vocabulary size {vocab_size}"))
    return made.withColumn("error", F.when((F.col("min_token_id") < 0) | (F.col("max_token_id") >= vocab_size), out)).withColumn(
        "warning", F.when(F.col("eos_tokens") == 0, F.lit("no end token in it"))
    )


def missing_ranges(shards: DataFrame, source: str = "source", index: str = "shard_index") -> DataFrame:
    """(source, first, last): the gaps between a source's shard indices, as ranges, so that one stray
    index costs a row and not a row for each that is missing."""
    known = shards.filter(F.col(index).isNotNull()).select(source, F.col(index).cast("long").alias("_i")).distinct()
    after = F.lead("_i").over(Window.partitionBy(source).orderBy("_i"))
    return known.withColumn("_j", after).filter(F.col("_j") > F.col("_i") + 1).select(source, (F.col("_i") + 1).alias("first"), (F.col("_j") - 1).alias("last"))


def listed(missing: Column, separator: str) -> Column:
    """An array of ranges in words: one or two indices singly, more as first-last."""

    def words(r: Column) -> Column:
        first, last = r["first"].cast("string"), r["last"].cast("string")
        return F.when(r["last"] == r["first"], first).when(r["last"] == r["first"] + 1, F.concat(first, F.lit(separator), last)).otherwise(F.concat(first, F.lit("-"), last))

    return F.array_join(F.transform(missing, words), separator)


def source_report(scanned: DataFrame, source: str = "source", index: str = "shard_index") -> DataFrame:
    """Per source: shards, tokens, eos_tokens, missing (ranges of indices) and the messages that follow."""
    made = scanned.groupBy(source).agg(
        F.count("*").alias("shards"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.sum("eos_tokens").cast("long").alias("eos_tokens"),
        F.count(index).alias("_named"),
    )
    gaps = missing_ranges(scanned, source, index).groupBy(source).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("missing"))
    met = null_safe_join(made, gaps, [source], "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    met = met.withColumn("missing", F.coalesce("missing", none))
    return (
        met.withColumn("error", F.when(F.size("missing") > 0, F.concat(F.lit("missing shard indices "), listed(F.col("missing"), ", "))))
        .withColumn("warning", F.when(F.col("_named") == 0, F.lit("no name has a shard index")))
        .drop("_named")
    )


def messages(scanned: DataFrame, sources: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(level, place, subject, message): shard messages in path order, then those of sources."""
    rows = []
    for place, df, subject in ((0, scanned, path), (1, sources, source)):
        for level in ("error", "warning"):
            rows.append(df.filter(F.col(level).isNotNull()).select(F.lit(level).alias("level"), F.lit(place).alias("place"), F.col(subject).alias("subject"), F.concat(F.col(subject), F.lit(": "), F.col(level)).alias("message")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def report_text(root: str, files: int, vocab_size: int, eos_id: int, sources: list[dict], notes: dict[str, list[str]], counts: dict[str, int] | None = None, most: int = 20) -> str:
    """The check's report for people, with the first messages of each level and the verdict.

    ``notes``: messages by level, the first ones at least; ``counts``: how many there are in all.
    """
    counts = {level: len(own) for level, own in notes.items()} | (counts or {})
    lines = [f"shards below {root}: {files:,} files, vocabulary {vocab_size:,}, end token {eos_id}"]
    for s in sources:
        lines.append(f"{s['source']:<24}{s['shards']:>8,} shards{s['tokens']:>18,} tokens{s['eos_tokens']:>14,} ends")
    for level, own in sorted(notes.items()):
        lines.append(f"{counts[level]} {level}")
        lines += [f"    {m}" for m in own[:most]]
        if counts[level] > most:
            lines.append(f"    and {counts[level] - most} more")
    lines.append("RESULT: FAILED" if counts.get("errors") else "RESULT: PASSED")
    return "\n".join(lines)
