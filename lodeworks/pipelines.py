"""End-to-end corpus jobs: tokenize documents into shards, check shards, split them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import blake2b_share, split_name
from .functions.registry import copy_manifest, fingerprint, read_manifest, write_manifest
from .functions.text import is_nonblank
from .functions.tokenizers import Tokenizer, check_narrow, end_of, narrowed
from .operators import documents, shards
from .operators.ordered import null_safe_join, with_index, within_budget
from .session import small_batches, stored
from .sources.tokenfiles import list_files, listing, read_ends, read_outline, read_shards, write_shards

SHARD_TOKENS = 100_000_000
#: Places of documents are broadcast up to so many bytes; a document's place takes about so many.
BROADCAST_BYTES, _ROW_BYTES = 16_000_000, 64


def tokenize(docs: DataFrame, tokenizer: Tokenizer, output: str, shard_tokens: int = SHARD_TOKENS, max_tokens: int | None = None) -> dict:
    """Documents (doc_id, source, text) into shards; returns the run's report.

    Blank texts are filtered before the tokenizer sees them and counted as skipped, as far as they
    come before the stop.  The document that reaches the budget is the last of its source.  Documents are
    in order of their ids, null first; rows with one id, equal ones too, are documents of their own, in the
    order in which they were read.
    """
    check_narrow(tokenizer)
    small_batches(docs.sparkSession)
    usable = docs.select("source", "doc_id", "text").filter(is_nonblank(F.col("text")))
    ids = usable.select("source", "doc_id", narrowed(tokenizer.ids(F.col("text")), end_of(tokenizer)).alias("tokens"))
    made = stored(ids.withColumn("n_tokens", F.expr("octet_length(tokens) div 2")).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    lengths = made.select("source", "doc_id", "_row", "n_tokens")
    kept = within_budget(lengths, "n_tokens", max_tokens, ["doc_id", "_row"], ["source"]) if max_tokens else lengths
    placed = stored(shards.assign_shards(kept, shard_tokens, shards.AFTER, ["source"], "doc_id", ties=["_row"]), "placed")
    last = placed.groupBy("source").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("n"), (F.max("shard_index") + 1).alias("shards"))
    last = stored(last, "sources")  # a row for each source
    row = last.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "n", "shards")]).first()
    where = placed.select("_row", "shard_index", "position")
    pieces = made.select("_row", "source", "tokens").join(_small(where, row["documents"]), "_row")
    write_shards(pieces.withColumn("split", F.lit(None).cast("string")), output)
    write_manifest(output, tokenizer)
    stopped = F.lit(False) if max_tokens is None else F.coalesce(F.col("n") >= max_tokens, F.lit(False))
    before = F.when(F.col("doc_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") < F.col("last"), F.lit(False)))
    blank = null_safe_join(docs.select("source", "doc_id", "text").filter(~is_nonblank(F.col("text"))), last, ["source"], "left").filter(~stopped | before)
    return {"documents": row["documents"], "skipped": blank.count(), "total_tokens": row["n"], "shards": row["shards"]}


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if it is counted to be small."""
    return F.broadcast(df) if rows * _ROW_BYTES <= BROADCAST_BYTES else df


def scanned_shards(spark: SparkSession, root: str, vocab_size: int, eos_id: int) -> DataFrame:
    """A row for every file below a folder, unreadable ones too: its scan, source and shard index."""
    scanned = shards.scan_outline(read_outline(spark, root, eos_id, bad="skip"), ["path"], vocab_size)
    nothing = {"tokens": "long", "eos_tokens": "long", "min_token_id": "int", "max_token_id": "int"}
    bad = listing(spark, root).filter("error is not null").select("path", "bytes", *[F.lit(None if c.startswith("m") else 0).cast(t).alias(c) for c, t in nothing.items()], F.lit(False).alias("ends_with_eos"), "error", F.lit(None).cast("string").alias("warning"))
    source, index = shards.name_parts(F.col("path"), root)
    return scanned.unionByName(bad).withColumn("source", source).withColumn("shard_index", index)


def check(spark: SparkSession, root: str, vocab_size: int, eos_id: int, most: int = 20, tokenizer: Tokenizer | None = None) -> dict:
    """Scan every shard below a folder: per-shard and per-source figures, errors and warnings.

    ``tokenizer``: the one that the shards should have been made with.  If they say that it was another, that
    is the one error, and nothing is scanned.  ``tokenizer`` of the report: what they say (None: nothing).
    ``shard_table`` and ``message_table`` hold all rows and messages; of those the report itself carries
    the first ``most`` (shards by path, messages of each level in order) and their numbers.
    """
    try:
        files = list_files(root)
    except FileNotFoundError:
        files, gone = [], True
    else:
        gone = False
    base = {"root": root, "vocab_size": vocab_size, "eos_id": eos_id, "files_found": len(files)}
    if not files:
        why = "root directory does not exist" if gone else "no token files found"
        return base | {"errors": [f"{why}: {root}"], "warnings": [], "error_count": 1, "warning_count": 0, "sources": {}, "shards": [], "text": shards.report_text(root, 0, vocab_size, eos_id, [], {"errors": [why], "warnings": []})}
    base["tokenizer"] = said = read_manifest(root)
    if tokenizer and said and said["fingerprint"] != fingerprint(tokenizer):
        why = f"made with another tokenizer: {said['fingerprint']}, not {fingerprint(tokenizer)}"
        return base | {"errors": [f"{why}: {root}"], "warnings": [], "error_count": 1, "warning_count": 0, "sources": {}, "shards": [], "text": shards.report_text(root, len(files), vocab_size, eos_id, [], {"errors": [why], "warnings": []})}
    scanned = stored(scanned_shards(spark, root, vocab_size, eos_id), "scan")
    sources = shards.source_report(scanned)
    told = stored(shards.messages(scanned, sources), "messages")
    n = {r["level"]: r["count"] for r in told.groupBy("level").count().collect()}
    notes = {level + "s": [r["message"] for r in told.filter(F.col("level") == level).orderBy("place", "subject").limit(most).collect()] for level in ("error", "warning")}
    counts = {level + "s": n.get(level, 0) for level in ("error", "warning")}
    per = [r.asDict(recursive=True) for r in sources.orderBy("source").collect()]  # a row for each source
    rows = [r.asDict() for r in scanned.orderBy("path").limit(most).collect()]
    text = shards.report_text(root, len(files), vocab_size, eos_id, per, notes, counts, most)
    totals = {"total_tokens": sum(s["tokens"] for s in per), "total_eos_tokens": sum(s["eos_tokens"] for s in per)}
    tables = {"shard_table": scanned, "message_table": told}
    return base | notes | {"error_count": counts["errors"], "warning_count": counts["warnings"], "sources": {s["source"]: s for s in per}, "shards": rows, "text": text} | totals | tables


def samples(spark: SparkSession, root: str, tokenizer: Tokenizer, eos_id: int, max_characters: int = 1000) -> DataFrame:
    """(path, n_tokens, sample): the first document of every shard below a folder, decoded."""
    return documents.decoded_samples(read_shards(spark, root, bad="skip"), tokenizer, eos_id, ["path"], max_characters)


_PIECE = ["file_order", "position"]


def _outlined(spark: SparkSession, root: str, eos_id: int) -> tuple[DataFrame, int]:
    """The pieces of all shards with their places in their sources (``documents.placed_pieces``), from one
    read of the files, and their number."""
    source, _ = shards.name_parts(F.col("path"))
    lines = stored(read_outline(spark, root, eos_id).select(source.alias("source"), *_PIECE, "n_tokens", "ends"), "outline")
    return documents.placed_pieces(lines, _PIECE, ["source"], F.col("file_order")), lines.count()


def _cut(spark: SparkSession, root: str, eos_id: int, placed: DataFrame, count: int) -> DataFrame:
    source, _ = shards.name_parts(F.col("path"))
    pieces = read_ends(spark, root, eos_id).select(source.alias("source"), *_PIECE, "tokens", F.size("tokens").alias("n_tokens"), "ends")
    return documents.cut_pieces(documents.with_places(pieces, placed, ["source", *_PIECE], count), ["source"], "tokens")


def shard_fragments(spark: SparkSession, root: str, eos_id: int) -> DataFrame:
    """(source, doc_index, at, n_tokens, complete, tokens) of all shards, in order of their paths.

    Files are read twice: for the sizes and ends of their pieces, and to be cut.
    """
    return _cut(spark, root, eos_id, *_outlined(spark, root, eos_id))


def split(spark: SparkSession, root: str, output: str, eos_id: int, seed: int = 42, fraction: float = 0.01, shard_tokens: int = SHARD_TOKENS, share=blake2b_share) -> dict:
    """Shards into train and val shards by a keyed hash of each document's index in its source.

    Files are read twice: once for the sizes and ends of their pieces, from which documents are numbered,
    split and packed, and once to cut them and write the fragments where they belong.  So a document
    longer than a row, or a source without end tokens, is never gathered.  ``share``: the keyed hash, a
    column from 0 to 1 of source, index and seed.
    """
    pieces, count = _outlined(spark, root, eos_id)
    docs = documents.require_complete(documents.documents_of(documents.cut_pieces(pieces, ["source"]), ["source"])).filter("complete")
    docs = stored(docs.withColumn("split", split_name(share(F.col("source"), F.col("doc_index"), seed), fraction)), "documents")
    placed = stored(shards.assign_shards(docs, shard_tokens, shards.BEFORE, ["split", "source"], "doc_index", keep=["start"]), "placed")
    report = {r["source"]: r.asDict() for r in documents.split_report(placed, shard="shard_index").collect()}  # a row for each source
    found = _cut(spark, root, eos_id, pieces, count).select("source", "doc_index", "at", "tokens")
    met = null_safe_join(found, _small(placed.drop("n_tokens"), sum(r["documents"] for r in report.values())), ["source", "doc_index"])
    write_shards(met.withColumn("position", F.col("position") + F.col("at") - F.col("start")), output)
    copy_manifest(root, output)
    return {"seed": seed, "validation_fraction": fraction, "sources": report}


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with doc_index: the 0-based position in their source, in order of doc_id."""
    return with_index(docs, "doc_index", ["doc_id"], ["source"])
