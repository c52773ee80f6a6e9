"""Streaming ingest: shard packing and budgets with per-source state, and streamed batch plans."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tokenizers import Tokenizer
from ..operators import mixture
from ..operators.conversations import classify
from ..operators.shards import AFTER, placed
from ..session import few_lookups
from ..sources.tokenfiles import BATCH_TOKENS, READ_SCHEMA, read_run

_OUT = "source string, doc_id long, n_tokens long, doc_index long, shard_index long, reached boolean"
_STATE = "documents long, shard long, held long, total long"
#: Bytes of a range of a streamed shard that one task reads.
RANGE_BYTES = 64_000_000
#: Tasks, for each core, that read them.
READERS = 4


def packed(docs: DataFrame, cap: int, budget: int | None = None, told: str | None = None) -> DataFrame:
    """A stream of (source, doc_id, n_tokens) with doc_index and shard_index.

    State of a source: documents, open shard and its tokens, total tokens.  A shard closes once it has
    reached ``cap``; the document that reaches ``budget`` is the last.  Rows of a micro-batch are
    taken in order of doc_id, and micro-batches in the order they come.  ``told``: the name under which
    each micro-batch reports (as an observed metric) which of the sources that it met have their budget.
    """
    if cap <= 0 or (budget is not None and budget <= 0):
        raise ValueError("cap and budget must be positive")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        documents, shard, held, total = state.get if state.exists else (0, 0, 0, 0)
        # two numbers a row; a micro-batch is bounded by its trigger
        ids, lengths = (np.concatenate(x) for x in zip(*[(f["doc_id"].to_numpy(), f["n_tokens"].to_numpy()) for f in frames]))
        order = np.argsort(ids, kind="stable")
        ids, lengths = ids[order], lengths[order]
        if budget is not None:
            before = total + np.cumsum(lengths) - lengths
            ids, lengths = ids[before < budget], lengths[before < budget]
        where, _, shard, held = placed(lengths, cap, AFTER, shard, held)
        total += int(lengths.sum())
        yield pd.DataFrame({"source": key[0], "doc_id": ids, "n_tokens": lengths, "doc_index": documents + np.arange(len(ids)), "shard_index": where, "reached": False})
        if budget is not None and total >= budget:  # a row that says so, in this and every later micro-batch
            yield pd.DataFrame({"source": [key[0]], "doc_id": [0], "n_tokens": [0], "doc_index": [-1], "shard_index": [-1], "reached": [True]})
        state.update((documents + len(ids), int(shard), int(held), total))

    made = docs.select("source", "doc_id", "n_tokens").groupBy("source").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    if told:
        made = made.observe(told, F.collect_set(F.when(F.col("reached"), F.col("source"))).alias("sources"))  # a name for each source
    return made.filter(~F.col("reached")).drop("reached")


class _Reached(StreamingQueryListener):
    """Notes the sources that have their budget; ``all`` is set once they are all that are wanted."""

    def __init__(self, name: str, wanted: set[str]):
        self.name, self.left, self.all = name, set(wanted), threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.left -= set(seen["sources"])
            if not self.left:
                self.all.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def pack_until_budget(docs: DataFrame, cap: int, budget: int, sources: list[str], folder: str, state: str) -> int:
    """A stream of documents packed into ``folder`` until every one of ``sources`` has its budget, or the
    stream has no more for now; returns the rows that were read.

    The query is ended, not only filtered: what lies behind the stop is not read, but for the micro-batch
    that may have begun meanwhile, whose rows are filtered.  A restart with the same ``state`` goes on where
    the query was ended; a source that has its budget says so again with its next row.
    """
    spark = docs.sparkSession
    watch = _Reached(f"budget-{uuid.uuid4().hex}", set(sources))
    spark.streams.addListener(watch)
    try:
        made = packed(docs, cap, budget, watch.name)
        job = made.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            while not job.awaitTermination(0.1):
                if watch.all.is_set():
                    break
        finally:
            job.stop()
        return sum(p.numInputRows for p in job.recentProgress)
    finally:
        spark.streams.removeListener(watch)


def shard_stream(spark: SparkSession, root: str, files_per_batch: int = 1_000, range_bytes: int = RANGE_BYTES, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """A stream of (path, position, tokens) of the shards below a folder, those that come later too.

    Spark's own file source keeps account of the files and is asked for their names and sizes alone; ranges
    of them are dealt out and read by tasks, so a shard of any size is read in parallel.  The number of these
    tasks is given, as a range's row is so small that Spark would join all of them to one task.  A micro-batch
    looks its files up by name: in a few tasks a core (``session.few_lookups``), not in one for each file.  A
    file of odd size is an error, an empty one has no rows.
    """
    few_lookups(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", files_per_batch).load(root)
    step = max(1, range_bytes // 2 // batch_tokens) * batch_tokens
    whole = F.when(F.col("length") % 2 == 0, F.call_function("div", F.col("length"), F.lit(2).cast("long"))).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": odd size"))).cast("long"))
    sized = files.select("path", whole.alias("n")).filter("n > 0")
    ranges = sized.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # a few numbers for each range
                yield from read_run(row["path"], row["start"], min(row["start"] + step, row["n"]), batch_tokens)

    return ranges.repartition(READERS * spark.sparkContext.defaultParallelism, "path", "start").mapInArrow(read, READ_SCHEMA)


def file_stream(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def totals(docs: DataFrame) -> DataFrame:
    """Running documents and tokens of each source (complete output mode)."""
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))


def write_examples(conversations: DataFrame, tokenizer: Tokenizer, max_length: int, folder: str, state: str) -> None:
    """A stream of conversations (conv_id, messages: turn, role, content) into classified examples.

    Each micro-batch is one pass over its conversations and writes a folder of its own, which a
    repeated batch replaces, so nothing is written twice.  Offsets are a matter of reading.
    """

    def write(batch: DataFrame, number: int) -> None:
        turns = batch.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.turn", "m.role", F.col("m.content").alias("text"))
        classify(turns, tokenizer, max_length).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conversations.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def mixture_stream(spark: SparkSession, windows: DataFrame, weights: dict[str, float], batch_size: int, seed: int, per_pass: DataFrame, steps: int, first: int = 0) -> DataFrame:
    """The endless mixture as a stream: (step, slot, source, window_index, tokens), ``steps`` steps for each
    micro-batch, from step ``first`` on.

    The stream's offset is the step, which Spark's checkpoint keeps: a restart goes on with the next one.
    All else is a pure function of seed and step (``mixture.batches`` in keyed order), so no state is held
    and no pass is listed.  ``per_pass``: source and windows; see ``mixture.batches``.
    """
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", steps).load()
    plan = mixture.draws(mixture.step_labels(numbers.select((F.col("value") + first).alias("step")), batch_size, weights, seed), per_pass)
    return mixture.keyed_draws(plan, per_pass, seed).join(windows, ["source", "window_index"]).select("step", "slot", "source", "window_index", "tokens")


def serve(stream: DataFrame, folder: str, state: str) -> None:
    """One micro-batch of an endless stream into Parquet files; call it again to go on."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
