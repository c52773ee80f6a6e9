"""A corpus pipeline of five of the operators in ``lodeworks.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents`` (n_chars: code points of the text as the stage leaves it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import decontam, language, linededup, packing, simhash
from lodeworks.llm.common import row_keyed, table, written

#: A language named by a row gives way to the predicted one if that leads by so much.
SURE = 0.2
#: A list of rows of at most this many is broadcast.
BROADCAST_ROWS = 1_000_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows whose columns ``on`` are in ``gone``."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language, and name the language of the others.

    Prototypes are learnt from rows that name a language, as far as they are not held out.  Rejected
    are null and letterless texts, and texts less like every language than all but one in a thousand
    of the held-out rows that name one (if there are enough to tell).  ``lang`` becomes the prediction where it is null, or where the
    prediction differs and leads the next language by ``SURE``.

    Each row is judged by its text alone: null and repeated ids and repeated rows make no difference.
    If no language can be learnt (an empty table, or no row names one), nothing can be said to have
    one, and every row is rejected.
    """
    prototypes = language.learn(docs.filter(~language.held_out()))
    least = language.least_score(docs.filter(language.held_out()), prototypes)
    found = language.identify(docs, prototypes, keep=COLUMNS)
    wrong = F.col("lang").isNull() | (F.col("lead") >= SURE)
    named = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    return named.withColumn("lang", F.when(wrong, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; every document stays, with the lines it keeps.

    Each row counts as a document.  A line goes to the largest id that holds it, and stays in every
    row with that id; rows without an id keep it only if no row with one holds it.  A null text
    becomes an empty one.  An empty table gives no rows.
    """
    kept = linededup.dedup_lines(docs, keep=["doc_id", "lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, one row only.

    Rows count singly, also where they repeat an id or are alike in all columns; a row with a null id
    stays only if no row of its group has one, and then one of them.  Null and empty texts are alike.
    An empty table gives no rows.
    """
    keyed, row = row_keyed(docs.select(*COLUMNS), "keyed")
    mine = keyed.select(*COLUMNS, row[0].alias("_file"), row[1].alias("_row"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_file").alias("file"), F.col("_row").alias("row"))
    found = written(simhash.near_duplicates(mine.select(key.alias("key"), "text"), "key").select("key.file", "key.row", F.col("component.file").alias("f"), F.col("component.row").alias("r")), "neardups")
    leave = found.filter("file <> f or row <> r").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    return _without(mine, leave, ["_file", "_row"]).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by its text alone: null and repeated ids and repeated rows make no difference.
    Null and short texts hold nothing and stay.  Without benchmark items every row stays.
    """
    digested = docs.select(*COLUMNS, F.md5(F.col("text").cast("binary")).alias("_digest"))
    hits = decontam.contaminated(digested.select("_digest", "text"), table(spark, sf_dir, "benchmark"), id_col="_digest")
    return _without(digested, written(hits.select("_digest").distinct(), "contaminated"), ["_digest"]).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in the training sequences.

    Rows count singly: those with null or repeated ids, and equal ones, are packed like any other.  A
    null or empty text is one piece, the end token.  An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizers, fingerprints and learnt prototypes are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
