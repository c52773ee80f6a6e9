"""The registered queries of this subpackage: thin, production parameters, whole tables."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam
from .common import shared_dir, table, written
from .oracles import ORACLE_SQL as ORACLE_SQL


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import count_of, joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents with an estimate for the BPE, its exact counts as revisions, all
    documents' words, and the removal of exact copies (all rows of a text go, its first comes back);
    the second batch is sent twice."""
    from .tokencounts import DELETE, INSERT, REVISE, Rollup, changes, count_tokens

    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("digest"))
    rows = docs.withColumn("guess", F.coalesce(F.floor(F.length("text") / 4), F.lit(0)))
    counted = written(count_tokens(rows, ["doc_id", "source", "lang", "digest", "guess"]), "counted")
    texts = counted.filter("digest is not null")
    first = F.min(F.struct("doc_id", "source", "lang", "bpe_tokens", "word_tokens")).alias("first")
    firsts = texts.groupBy("digest").agg(first).select("first.*")
    rollup = Rollup(spark, f"{shared_dir(spark)}/lodeworks/rollup-{uuid.uuid4().hex}")
    bpe, words = "word_bpe_49k/1", "ascii_words/1"
    revised = changes(counted, REVISE, bpe, F.col("bpe_tokens"), F.col("guess"))
    rollup.commit("load", changes(counted, INSERT, bpe, F.col("guess")))
    rollup.commit("recount", revised)
    rollup.commit("words", changes(counted, INSERT, words, F.col("word_tokens")))
    rollup.commit("recount", revised)
    moves = [changes(rows, op, name, F.col(n)) for name, n in ((bpe, "bpe_tokens"), (words, "word_tokens")) for rows, op in ((texts, DELETE), (firsts, INSERT))]
    rollup.commit("copies", functools.reduce(DataFrame.unionAll, moves))
    return rollup.totals()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    prototypes = learn(docs.filter(~F.col("held_out")))
    return identify(docs, prototypes, keep=["doc_id", "held_out"]).drop("lead")


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windowpack import pack_windows

    return pack_windows(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_window_packing": op11_window_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_ranked_search": op13_ranked_search,
}
