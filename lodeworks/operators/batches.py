"""Small things around batches: epoch orders, limits, progress."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .ordered import with_index


def epoch_order(examples: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """``examples`` with their position in a seeded shuffle of the epoch: the order of a keyed hash,
    so every row finds its place without a global sort on one task."""
    shuffled = examples.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))).withColumn("_one", F.lit(0))
    block = F.shiftright("_h", 54)  # 1024 blocks of the hash's range
    return with_index(shuffled, "position", ["_h", key], ["_one"], block=block).drop("_h", "_one")


def first_batches(samples: DataFrame, n: int, batch: str = "batch_id") -> DataFrame:
    """The first ``n`` batches of a deliberately short diagnostic run."""
    return samples.filter(F.col(batch) < n)


def tokens_per_step(batch_size: int, block_size: int) -> int:
    return batch_size * block_size


def observed(df: DataFrame, name: str = "progress", **counts) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows (and ``counts``) as they pass, without another job."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), watch


@contextmanager
def progress(df: DataFrame, every: int, say: Callable[[int], None], pause: float = 0.2) -> Iterator[DataFrame]:
    """``df`` as it is, while ``say`` is told the rows so far each time that they pass a multiple of
    ``every``; rows count when their task ends, and once for every time that ``df`` is run."""
    if every <= 0:
        raise ValueError("progress is told every so many rows")
    seen, over = df.sparkSession.sparkContext.accumulator(0), threading.Event()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def watch() -> None:
        told = 0
        while True:
            last = over.wait(pause)
            if seen.value // every > told:
                told = seen.value // every
                say(seen.value)
            if last:
                return

    teller = threading.Thread(target=watch, daemon=True)
    teller.start()
    try:
        yield df.mapInArrow(count, df.schema)
    finally:
        over.set()
        teller.join()
