"""Tuning artifacts: examples as Parquet with a metadata row, and the flat binary export.

The export (tokens, masks, offsets, metadata) is for readers that map files into memory; see ``flatfiles``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.conversations import audit, offsets
from .flatfiles import FlatExamples, agreed, local, require_free

FORMATTER = "role_lines_v1"


def metadata(examples: DataFrame, **more) -> dict:
    """Counts of a classified table, with what else is to be recorded."""
    row = audit(examples).first().asDict()
    kept = {k: row[k] for k in ("scanned", "retained", "dropped", "invalid", "total_tokens")}
    return {"formatter": FORMATTER, **more, **kept, "assistant_tokens": row["total_assistant_tokens"]}


def write_table(examples: DataFrame, folder: str, **more) -> None:
    """Retained examples and metadata as Parquet and JSON tables; an existing folder is an error."""
    spark = examples.sparkSession
    offsets(examples).select("example_index", "token_ids", "loss_mask", "start", "end").write.mode("errorifexists").parquet(f"{folder}/examples")
    spark.createDataFrame([(json.dumps(metadata(examples, **more)),)], "value string").coalesce(1).write.text(f"{folder}/metadata")


def export(examples: DataFrame, folder: str, **more) -> None:
    """The four files, written by the tasks that hold the examples; refuses if any is there."""
    require_free(local(folder))
    examples.sparkSession.dataSource.register(FlatExamples)
    meta = metadata(examples, **more)
    rows = offsets(examples).select("example_index", "start", "token_ids", "loss_mask")
    told = {"path": folder, "retained": meta["retained"], "total_tokens": meta["total_tokens"], "metadata": json.dumps(meta, indent=2)}
    rows.write.format("flat_examples").mode("append").options(**told).save()


def read_export(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(example_index, start, token_ids, loss_mask) of exported files, in ranges of examples."""
    agreed(local(folder))
    spark.dataSource.register(FlatExamples)
    return spark.read.format("flat_examples").options(path=folder, **options).load()


def check_fits(meta: dict, tokenizer: str, block_size: int, formatter: str = FORMATTER) -> None:
    """An artifact must have been made for this formatter, tokenizer and block size, with targets."""
    wrong = [
        (meta.get("formatter") != formatter, f"formatter is {meta.get('formatter')!r}, not {formatter!r}"),
        (meta.get("tokenizer") != tokenizer, f"tokenizer is {meta.get('tokenizer')!r}, not {tokenizer!r}"),
        (int(meta.get("max_length", 0)) > block_size, f"max_length {meta.get('max_length')} exceeds the block size {block_size}"),
        (int(meta.get("assistant_tokens", 0)) <= 0, "there are no supervised tokens"),
    ]
    for bad, why in wrong:
        if bad:
            raise ValueError(why)
