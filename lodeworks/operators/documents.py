"""Documents inside token streams: end-token segmentation, and train/validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import Tokenizer, decoded
from .ordered import null_safe_join, with_prefix_sums

#: So many pieces at most have their places broadcast.
BROADCAST_PIECES = 1_000_000


def ends_in(tokens: Column, eos_id: int) -> Column:
    """Places behind the end tokens of an array."""
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == eos_id, i + 1)), lambda i: i.isNotNull())


def placed_pieces(outlines: DataFrame, order: list[str], by: list[str], block: Column | None = None) -> DataFrame:
    """(by..., order..., n_tokens, ends) with ``_doc`` and ``_at``: the end tokens and the tokens before each
    piece in its group.  Only these numbers are put in order."""
    sizes = outlines.select(*by, *order, "n_tokens", "ends")
    return with_prefix_sums(sizes, {"_doc": F.size("ends"), "_at": F.col("n_tokens")}, order, by, block)


def cut_pieces(placed: DataFrame, by: list[str], tokens: str | None = None) -> DataFrame:
    """(by..., doc_index, at, n_tokens, complete, and tokens if named): pieces with n_tokens, ends, ``_doc`` and
    ``_at`` cut behind their ends."""
    starts = F.concat(F.array(F.lit(0)), F.col("ends"))
    stops = F.concat(F.col("ends"), F.array(F.col("n_tokens").cast("int")))
    each = placed.withColumn("_n_ends", F.size("ends")).select("*", F.posexplode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("_k", "_cut")).filter("_cut.b > _cut.a")
    a, n = F.col("_cut.a"), F.col("_cut.b") - F.col("_cut.a")
    own = [F.slice(tokens, a + 1, n).alias("tokens")] if tokens else []
    numbers = [(F.col("_doc") + F.col("_k")).alias("doc_index"), (F.col("_at") + a).alias("at"), n.cast("long").alias("n_tokens"), (F.col("_k") < F.col("_n_ends")).alias("complete")]
    return each.select(*by, *numbers, *own)


def with_places(pieces: DataFrame, placed: DataFrame, places: list[str], count: int, broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """``pieces`` with ``_doc`` and ``_at``, which come by a broadcast if the pieces are few enough."""
    bases = placed.select(*places, "_doc", "_at")
    return null_safe_join(pieces, F.broadcast(bases) if count <= broadcast_pieces else bases, places)


def fragments(pieces: DataFrame, tokens: str, eos_id: int, order: list[str], by: list[str], block: Column | None = None, broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """(by..., doc_index, at, n_tokens, complete, tokens): pieces of shards cut behind their end tokens.

    A document ends with, and includes, its end token, and may span pieces and shards; doc_index counts
    the end tokens before it in its group, at: the tokens.  ``complete``: this fragment has the end.
    Ends are found inside the arrays; only their number for each piece is put in order, so no token becomes
    a row, and a document of any length stays in fragments of at most a piece.
    """
    places = [*by, *order]
    t = F.col(tokens)
    known = pieces.select(*places, t.alias("_t"), F.size(t).cast("long").alias("n_tokens"), ends_in(t, eos_id).alias("ends"))
    placed = placed_pieces(known, order, by, block)
    return cut_pieces(with_places(known, placed, places, pieces.select(F.lit(1)).count(), broadcast_pieces), by, "_t")


def segments(pieces: DataFrame, tokens: str, eos_id: int, order: list[str], by: list[str], block: Column | None = None) -> DataFrame:
    """Per document: start (tokens before it in its group), n_tokens, and whether it is complete."""
    return documents_of(fragments(pieces, tokens, eos_id, order, by, block), by)


def documents_of(found: DataFrame, by: list[str]) -> DataFrame:
    """The documents of ``fragments``, which come together as numbers, without their tokens."""
    return found.groupBy(*by, "doc_index").agg(F.min("at").alias("start"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.bool_or("complete").alias("complete"))


def require_complete(found: DataFrame) -> DataFrame:
    """``found``, or an error when it is read if some document has no end token."""
    message = F.concat(F.lit("the last document is incomplete: "), F.col("n_tokens"), F.lit(" tokens without an end token"))
    return found.withColumn("complete", F.when(F.col("complete"), True).otherwise(F.raise_error(message).cast("boolean")))


def first_document(pieces: DataFrame, tokens: str, eos_id: int, position: str, by: list[str], scan: int = 2_000_000, fallback: int = 256) -> DataFrame:
    """(by..., ids): the tokens before a shard's first end token, or its first ``fallback`` tokens if
    there is none among the first ``scan``.  ``pieces``: arrays with their 0-based position."""
    seen = pieces.filter(F.col(position) < scan).select(*by, F.col(position).cast("long").alias("_p"), F.col(tokens).alias("_t"))
    found = F.array_position("_t", eos_id)
    at = F.col("_p") + found - 1
    ends = seen.groupBy(*by).agg(F.min(F.when((found > 0) & (at < scan), at)).alias("_end")).withColumn("_end", F.coalesce("_end", F.lit(fallback)))
    kept = null_safe_join(seen, ends, by).filter(F.col("_p") < F.col("_end"))
    part = F.slice("_t", F.lit(1), F.least(F.size("_t").cast("long"), F.col("_end") - F.col("_p")).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("_p", part.alias("t"))))  # at most ``scan`` tokens
    ids = kept.groupBy(*by).agg(F.flatten(F.transform(parts, lambda x: x["t"])).alias("ids"))
    return null_safe_join(ends.select(*by), ids, by, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def decoded_samples(pieces: DataFrame, tokenizer: Tokenizer, eos_id: int, by: list[str], max_characters: int = 1000, tokens: str = "tokens", position: str = "position") -> DataFrame:
    """(by..., n_tokens, sample): each shard's first document, decoded, cut to ``max_characters``."""
    found = first_document(pieces, tokens, eos_id, position, by)
    return found.select(*by, F.size("ids").cast("long").alias("n_tokens"), F.substring(decoded(tokenizer, F.col("ids")), 1, max_characters).alias("sample"))


def split_report(docs: DataFrame, source: str = "source", split: str = "split", length: str = "n_tokens", shard: str | None = None) -> DataFrame:
    """Per source: documents and tokens of each split, and its shards if they are assigned."""
    aggs = [F.count("*").alias("documents")]
    for s in ("train", "val"):
        mine = F.col(split) == s
        aggs += [F.count_if(mine).alias(f"{s}_documents"), F.coalesce(F.sum(F.when(mine, F.col(length))), F.lit(0)).cast("long").alias(f"{s}_tokens")]
        if shard:
            aggs.append(F.coalesce(F.max(F.when(mine, F.col(shard))) + 1, F.lit(0)).cast("long").alias(f"{s}_shards"))
    return docs.groupBy(source).agg(*aggs)


def split_summary(report: DataFrame) -> DataFrame:
    """Totals, and the validation share of all tokens (null without tokens)."""
    train, val = F.sum("train_tokens").cast("long"), F.sum("val_tokens").cast("long")
    return report.agg(train.alias("train_tokens"), val.alias("val_tokens")).withColumn("val_share", F.try_divide(F.col("val_tokens").cast("double"), (F.col("train_tokens") + F.col("val_tokens")).cast("double")))
