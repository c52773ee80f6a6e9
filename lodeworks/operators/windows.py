"""Training windows: fixed-size tiles of shards, and the samples made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import within_ranges


def window_counts(shards: DataFrame, block_size: int, by: list[str], index: str = "shard_index", tokens: str = "tokens") -> DataFrame:
    """Per shard: its whole windows of ``block_size`` + 1 tokens, and the windows before it in its
    group.  Shards too short for one have none; ``has_any`` is false only for groups without any."""
    own = Window.partitionBy(*by)
    before = own.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    n = F.floor(F.col(tokens) / F.lit(block_size + 1)).cast("long")
    return (
        shards.withColumn("windows", n)
        .withColumn("first_window", F.coalesce(F.sum("windows").over(before), F.lit(0)).cast("long"))
        .withColumn("has_any", F.sum("windows").over(own) > 0)
    )


def source_bounds(counts: DataFrame, source: str = "source") -> DataFrame:
    """Alphabetical sources with their ordinal and the range of sample indices they take."""
    totals = counts.groupBy(source).agg(F.sum("windows").cast("long").alias("windows"))
    order = Window.orderBy(source)  # a row for each source
    end = F.sum("windows").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return totals.select(source, (F.row_number().over(order) - 1).alias("source_id"), (end - F.col("windows")).alias("first_sample"), end.alias("end_sample"))


def tile(pieces: DataFrame, block_size: int, by: list[str], start: str, tokens: str) -> DataFrame:
    """(by..., window_index, tokens): cut runs of tokens into windows of ``block_size`` + 1.

    ``pieces``: arrays of tokens with their 0-based start within the shard ``by``; a shard is never
    one row.  Each piece is sliced at window borders, slices of a window meet by its index, and the
    incomplete last window is dropped.  Windows may cross documents, never shards.
    """
    width = block_size + 1
    at, size = F.col(start).cast("long"), F.size(tokens)
    first, last = F.floor(at / F.lit(width)), F.floor((at + size - 1) / F.lit(width))
    cut = pieces.filter(size > 0).withColumn("window_index", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("window_index") * width - at, F.lit(0))
    high = F.least((F.col("window_index") + 1) * width - at, F.size(tokens).cast("long"))
    part = F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int"))
    met = cut.select(*by, "window_index", F.struct((at + low).alias("p"), part.alias("t")).alias("piece"))
    grouped = met.groupBy(*by, "window_index").agg(F.array_sort(F.collect_list("piece")).alias("ps"))  # one window
    return grouped.select(*by, "window_index", F.flatten(F.transform("ps", lambda p: p["t"])).alias("tokens")).filter(F.size("tokens") == width)


def samples(windows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Inputs and targets: ``x`` without the last token, ``y`` without the first."""
    n = F.size(tokens) - 1
    return windows.withColumn("x", F.slice(tokens, F.lit(1), n)).withColumn("y", F.slice(tokens, F.lit(2), n))


def full_split(windows: DataFrame, counts: DataFrame, batch_size: int, source: str = "source", index: str = "shard_index") -> DataFrame:
    """Every window once, sources in alphabetical order: sample_index, source_id, batch_id.  The last
    batch may be short.  ``counts``: see ``window_counts``, keyed by source and shard index."""
    bounds = source_bounds(counts, source)
    placed = windows.join(counts.select(source, index, "first_window"), [source, index]).join(F.broadcast(bounds), source)
    at = (F.col("first_sample") + F.col("first_window") + F.col("window_index")).cast("long")
    return placed.withColumn("sample_index", at).withColumn("batch_id", F.floor(at / F.lit(batch_size)).cast("long")).drop("first_window", "first_sample", "end_sample")


def scoring_windows(requests: DataFrame, ids: str, limit: int) -> DataFrame:
    """Rolling scoring: targets are disjoint and cover all tokens but the first; an input overlaps
    the one before by one token and is at most ``limit`` wide.  Fewer than two tokens: no window."""
    if limit < 2:
        raise ValueError("scoring windows need a limit of at least two tokens")
    n = F.size(ids)
    starts = F.sequence(F.lit(1), n - 1, F.lit(limit - 1))
    cut = requests.filter(n >= 2).withColumn("target_start", F.explode(starts))
    end = F.least(F.col("target_start") + (limit - 1), n)
    return cut.withColumn("target_end", end).withColumn("window", F.slice(ids, F.col("target_start"), end - F.col("target_start") + 1))


def locate_windows(asked: DataFrame, counts: DataFrame, block_size: int, index: str = "source_window", source: str = "source", shard: str = "shard_index") -> DataFrame:
    """``asked`` (a source and the number of a window in it) with the shard that holds the window, its
    window_index there and ``start``, the tokens before it in the shard.

    ``counts``: see ``window_counts``.  A number that is not one of the source's is an error.
    """
    ranges = counts.select(source, shard, "first_window", (F.col("first_window") + F.col("windows")).alias("_end"))
    met = within_ranges(_inside(asked, counts, index, source), ranges, index, "first_window", "_end", [source])
    at = F.col(index) - F.col("first_window")
    return met.withColumn("window_index", at).withColumn("start", at * (block_size + 1)).drop("first_window", "_end")


def locate_samples(asked: DataFrame, counts: DataFrame, block_size: int, index: str = "sample_index", source: str = "source", shard: str = "shard_index") -> DataFrame:
    """``asked`` (numbers of samples of the full split) with source_id, source, the shard that holds each,
    its window_index there and ``start``.  A number that is no sample's is an error."""
    bounds = source_bounds(counts, source)
    of = within_ranges(_inside(asked, counts, index, None), bounds, index, "first_sample", "end_sample").drop("end_sample")
    inner = of.withColumn("_inner", F.col(index) - F.col("first_sample")).drop("first_sample")
    return locate_windows(inner, counts, block_size, "_inner", source, shard).drop("_inner")


def _inside(asked: DataFrame, counts: DataFrame, index: str, source: str | None) -> DataFrame:
    """``asked``, or an error when it is read if some number is out of bounds."""
    totals = counts.groupBy(*[source] if source else []).agg(F.coalesce(F.sum("windows"), F.lit(0)).cast("long").alias("_all"))
    met = asked.join(totals, source, "left") if source else asked.withColumn("_all", F.lit(totals.first()[0]))
    n = F.coalesce("_all", F.lit(0).cast("long"))
    told = F.concat(F.lit("no window "), F.col(index), F.lit(" among "), n)
    checked = F.when((F.col(index) >= 0) & (F.col(index) < n), F.col(index)).otherwise(F.raise_error(told).cast("long"))
    return met.withColumn(index, checked).drop("_all")
