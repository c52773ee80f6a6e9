"""Weighted mixtures of sources: quotas, schedules, resumable draws.

All of it is a pure function of (seed, step): plan tables are made for the steps asked for, and the
heavy table of windows is joined to the plan at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from .ordered import with_index
from .permutation import place_of

#: Ranges of the hash in which the windows of a pass are ranked.
HASH_BLOCKS = 1024
#: Windows of a pass that are given out, or listed, together.
CHUNK = 65_536


def check_weights(weights: dict[str, float], exact: float = 1e-6) -> None:
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("source weights must be positive")
    if abs(sum(weights.values()) - 1.0) > exact:
        raise ValueError(f"source weights must sum to 1, not {sum(weights.values())}")


def quotas(size: int, weights: dict[str, float], ensure_all: bool = False) -> dict[str, int]:
    """Largest-remainder shares of ``size``; equal remainders go to the earlier source.

    ``ensure_all``: a source left with nothing takes one from the largest, one after another.
    """
    exact = {s: w * size for s, w in weights.items()}
    got = {s: math.floor(x) for s, x in exact.items()}
    spare = size - sum(got.values())
    for s in sorted(exact, key=lambda s: got[s] - exact[s])[:spare]:
        got[s] += 1
    if ensure_all and size >= len(got):
        for s in got:
            if not got[s]:
                got[max(got, key=got.get)] -= 1
                got[s] = 1
    return got


def unit_schedule(batch_size: int, weights: dict[str, float], tries: int = 100) -> list[str]:
    """The shortest whole number of batches whose quotas give every source a place by its weight."""
    names = sorted(weights)
    ordered = {s: float(weights[s]) for s in names}
    batches = math.ceil(math.ceil(len(names) / min(ordered.values())) / batch_size)
    for n in range(batches, batches + tries):
        got = quotas(n * batch_size, ordered)
        if all(got.values()):
            break
    else:
        got = quotas((batches + tries) * batch_size, ordered, ensure_all=True)
    return [s for s in names for _ in range(got[s])]


def label_plan(spark: SparkSession, batch_size: int, weights: dict[str, float], seed: int, first: int, end: int) -> DataFrame:
    """(step, slot, source, draw) for steps first .. end - 1; draw: how many windows its source has
    served before, counted from step 0 in closed form (whole cycles) and a prefix within the cycle."""
    check_weights(weights)
    if batch_size <= 0 or first < 0:
        raise ValueError("batch size must be positive and the first step not negative")
    unit = unit_schedule(batch_size, weights)
    per_cycle = {s: unit.count(s) for s in weights}
    length = len(unit)
    cycles = range(first * batch_size // length, -(-end * batch_size // length)) if end > first else range(0)

    def shuffled(frames):
        for frame in frames:
            out = []
            for cycle in frame["id"]:
                out += [(int(cycle) * length + i, *x) for i, x in enumerate(_cycle(unit, per_cycle, seed, int(cycle)))]
            yield pd.DataFrame(out, columns=["position", "source", "draw"])

    span = spark.range(cycles.start, cycles.stop) if len(cycles) else spark.range(0)
    made = span.mapInPandas(shuffled, "position long, source string, draw long")
    step = F.floor(F.col("position") / F.lit(batch_size)).cast("long")
    return made.select(step.alias("step"), (F.col("position") % batch_size).cast("int").alias("slot"), "source", "draw").filter((F.col("step") >= first) & (F.col("step") < end))


def step_labels(steps: DataFrame, batch_size: int, weights: dict[str, float], seed: int) -> DataFrame:
    """The label plan of the steps of a table or stream: (step, slot, source, draw), a batch for each step."""
    check_weights(weights)
    if batch_size <= 0:
        raise ValueError("a batch size must be positive")
    unit = unit_schedule(batch_size, weights)
    per_cycle, length = {s: unit.count(s) for s in weights}, len(unit)

    def labelled(frames):
        known: dict[int, list] = {}
        for frame in frames:
            out = []
            for step in frame["step"]:
                for slot in range(batch_size):
                    cycle, i = divmod(int(step) * batch_size + slot, length)
                    if cycle not in known:
                        if len(known) >= 1024:
                            known.clear()
                        known[cycle] = _cycle(unit, per_cycle, seed, cycle)
                    out.append((int(step), slot, *known[cycle][i]))
            yield pd.DataFrame(out, columns=["step", "slot", "source", "draw"])

    return steps.select("step").mapInPandas(labelled, "step long, slot int, source string, draw long")


def _cycle(unit: list[str], per_cycle: dict[str, int], seed: int, cycle: int) -> list[tuple[str, int]]:
    """(source, draw) of the labels of a cycle, in its seeded order."""
    labels = list(unit)
    np.random.default_rng(np.random.SeedSequence([seed, cycle])).shuffle(labels)
    served, out = {s: cycle * n for s, n in per_cycle.items()}, []
    for s in labels:
        out.append((s, served[s]))
        served[s] += 1
    return out


def draws(plan: DataFrame, windows_per_pass: DataFrame) -> DataFrame:
    """``plan`` with the pass and the rank within it of each draw; sources without windows fail."""
    met = plan.join(F.broadcast(windows_per_pass.select("source", F.col("windows").alias("_w"))), "source", "left")
    w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.raise_error(F.concat(F.lit("no full window for source "), F.col("source"))).cast("long"))
    return met.withColumn("pass", F.floor(F.col("draw") / w).cast("long")).withColumn("rank", F.col("draw") % w).drop("_w")


def resume_position(unit_counts: DataFrame, steps: int, batch_size: int) -> DataFrame:
    """Position of each source after ``steps`` whole cycles' worth of batches: served, pass, cursor.

    ``unit_counts``: source, per_unit, unit_size and windows; exact where steps fill whole units.
    """
    served = F.floor(F.lit(steps * batch_size) / F.col("unit_size")) * F.col("per_unit")
    return unit_counts.select("source", served.cast("long").alias("served"), F.floor(served / F.col("windows")).cast("long").alias("pass"), (served % F.col("windows")).cast("long").alias("cursor"))


def position_at(spark: SparkSession, batch_size: int, weights: dict[str, float], seed: int, step: int, windows_per_pass: DataFrame) -> DataFrame:
    """Position of each source before any ``step``: served, pass, cursor.

    Whole cycles count in closed form; of the cycle that the step falls in, only the labels before it
    are looked at (a unit of a few batches, whatever the step).
    """
    check_weights(weights)
    unit = unit_schedule(batch_size, weights)
    cycle, rest = divmod(step * batch_size, len(unit))
    labels = list(unit)
    np.random.default_rng(np.random.SeedSequence([seed, cycle])).shuffle(labels)
    served = spark.createDataFrame([(s, cycle * unit.count(s) + labels[:rest].count(s)) for s in sorted(weights)], "source string, served long")
    met = served.join(windows_per_pass.select("source", "windows"), "source")
    return met.select("source", "served", F.floor(F.col("served") / F.col("windows")).cast("long").alias("pass"), (F.col("served") % F.col("windows")).cast("long").alias("cursor"))


def pass_order(passes: DataFrame, seed: int) -> DataFrame:
    """(source, pass, rank, window_index): each pass's permutation of a source's windows.

    ``passes``: source, pass and windows, one row for each pass that the plan needs.  A pass is permuted by
    one task, which holds four bytes for each of its windows and gives them out ``CHUNK`` at a time.
    """

    def permuted(frames):
        for frame in frames:
            for source, number, windows in frame[["source", "pass", "windows"]].itertuples(index=False):
                rng = np.random.default_rng(np.random.SeedSequence([stable_seed("stream", seed, source), int(number)]))
                order = np.arange(int(windows), dtype=np.uint32 if windows < 1 << 32 else np.int64)
                rng.shuffle(order)  # as rng.permutation does
                for at in range(0, len(order), CHUNK):
                    part = order[at : at + CHUNK].astype(np.int64)
                    yield pd.DataFrame({"source": source, "pass": int(number), "rank": np.arange(at, at + len(part)), "window_index": part})

    return passes.select("source", "pass", "windows").mapInPandas(permuted, "source string, pass long, rank long, window_index long")


def listed_ranks(passes: DataFrame, rank: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """``passes`` (source, pass, windows) with a row for each rank 0 .. windows - 1; a pass of more than a
    chunk is dealt out before it is listed."""
    most = F.col("windows") - 1
    starts = passes.filter(most >= 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), most, F.lit(chunk).cast("long"))))
    dealt = starts.repartition(max(1, starts.count()), "source", "pass", "_from")
    return dealt.withColumn(rank, F.explode(F.sequence("_from", F.least(most, F.col("_from") + chunk - 1)))).drop("_from")


def hashed_order(passes: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """The same by hash, in generated code: windows of a pass in order of SHA-256.

    Two levels: windows are listed in chunks, and each finds its rank within a range of the hash, of
    which there are ``HASH_BLOCKS``; so no task lists or sorts a whole pass.
    """
    most = F.col("windows") - 1
    starts = passes.filter(most >= 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), most, F.lit(chunk).cast("long"))))
    # a pass of more than a chunk is dealt out before it is listed
    dealt = starts.repartition("source", "pass", "_from")
    each = dealt.withColumn("window_index", F.explode(F.sequence("_from", F.least(most, F.col("_from") + chunk - 1))))
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "source", F.col("pass").cast("string"), F.col("window_index").cast("string")), 256)
    hashed = each.select("source", "pass", "window_index", key.alias("_h"))
    block = F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") * HASH_BLOCKS / F.lit(1 << 24))
    return with_index(hashed, "rank", ["_h"], ["source", "pass"], block=block).select("source", "pass", "rank", "window_index")


def batches(
    spark: SparkSession, windows: DataFrame, weights: dict[str, float], batch_size: int, seed: int, first: int, end: int, per_pass: DataFrame | None = None, order: str = "permuted"
) -> DataFrame:
    """(step, slot, source, window_index, tokens) of the mixture's batches.

    ``windows``: source, window_index (0-based over the source's shards) and tokens; ``per_pass``:
    source and windows, where they are known already (``windows.window_counts``).  ``order``: permuted
    is a seeded permutation, which one worker makes for a whole pass (eight bytes a window); hashed, for
    sources too large for that, has two levels; keyed computes each window from its rank, so no pass is
    listed at all and only the rows of the steps asked for are planned (``permutation``).
    """
    if order not in ("permuted", "hashed", "keyed"):
        raise ValueError(f"an order is permuted, hashed or keyed, not {order!r}")
    per_pass = windows.groupBy("source").agg(F.count("*").alias("windows")) if per_pass is None else per_pass.select("source", "windows")
    plan = draws(label_plan(spark, batch_size, weights, seed, first, end), per_pass)
    if order == "keyed":
        return keyed_draws(plan, per_pass, seed).join(windows, ["source", "window_index"]).select("step", "slot", "source", "window_index", "tokens")
    passes = plan.select("source", "pass").distinct().join(F.broadcast(per_pass), "source")
    placed = plan.join((pass_order if order == "permuted" else hashed_order)(passes, seed), ["source", "pass", "rank"])
    return placed.join(windows, ["source", "window_index"]).select("step", "slot", "source", "window_index", "tokens")


def keyed_draws(plan: DataFrame, per_pass: DataFrame, seed: int) -> DataFrame:
    """Drawn ranks (``draws``) with the window that each is in its pass's keyed permutation."""
    met = plan.join(per_pass.select("source", F.col("windows").alias("_n")), "source")  # a row for each source
    return met.withColumn("window_index", place_of(F.col("rank"), F.col("_n"), F.lit(str(seed)), F.col("source"), F.col("pass"))).drop("_n")


def missing_sources(spark: SparkSession, weights: dict[str, float], present: DataFrame) -> DataFrame:
    """Weighted sources without shards."""
    return spark.createDataFrame([(s,) for s in sorted(weights)], "source string").join(present.select("source"), "source", "left_anti")
