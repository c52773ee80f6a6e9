"""Token counts: additive rollups that signed change batches keep up to date.

A change is an insert (+1 document, +tokens), a delete (-1, -tokens) or a revised count (0, new - old).
A batch is summed by source, language and tokenizer version (pre-aggregated, so a source that holds
a third of all rows is no hot group) and committed under its id: the sums are written to the batch's
own folder, then a marker makes them count.  A batch that is sent again, after a failure or by
mistake, finds its marker and changes nothing; one that failed before its marker is written anew.
Totals are the sums over the committed batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .wordtokens import WordTokenizer, default_vocabulary, steps

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch: (source, lang, tokenizer, documents, tokens), signed.

    ``changes``: op, source, lang, tokenizer, tokens and old_tokens (for revisions).  Null sources
    and languages are groups of their own; null counts are zero; unknown ops are an error.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == INSERT, 1).when(op == DELETE, -1).when(op == REVISE, 0).otherwise(unknown.cast("int"))
    tokens = F.when(op == INSERT, new).when(op == DELETE, -new).when(op == REVISE, new - old)
    named = changes.select(*KEYS, docs.cast("long").alias("d"), tokens.cast("long").alias("t"))
    return named.groupBy(*KEYS).agg(F.sum("d").alias("documents"), F.sum("t").alias("tokens"))


class Rollup:
    """A rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, batch: str):
        return self._path(f"{self.folder}/commits/{quote(batch, safe='')}")

    def batches(self) -> list[str]:
        """Names of the committed batch folders."""
        at = self._path(f"{self.folder}/commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._marker(batch))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if self.committed(batch):
            return False
        signed(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/deltas/{quote(batch, safe='')}")
        return self._fs.createNewFile(self._marker(batch))

    def _read(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/deltas/{n}" for n in names])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of all committed batches; groups with
        neither documents nor tokens left are gone."""
        summed = self._read().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 or tokens <> 0")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns ``keep`` with bpe_tokens and word_tokens (long) of each whole text; null has none."""
    path = vocabulary or default_vocabulary()
    width = len(keep)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.opened(path)
        for whole in batches:
            for batch in steps(whole, width):
                _, bounds = tok.encode_column(batch.column(width))
                n_words = [len((x.as_py() or "").encode("utf-8", "surrogatepass").split()) for x in batch.column(width)]
                cols = [*batch.columns[:width], pa.array(bounds[1:] - bounds[:-1]), pa.array(n_words, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "bpe_tokens", "word_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, bpe_tokens long, word_tokens long")


def changes(rows: DataFrame, op: str, tokenizer: str, tokens, old=None) -> DataFrame:
    """A batch's rows: every row of ``rows`` (source, lang, ...) as one change."""
    old = F.lit(None) if old is None else old
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"), old.cast("long").alias("old_tokens"))
