"""Requests put into a model's batches by tokens, over the whole table.

Lengths are cut into bands, each reaching from a longest length down to that length over ``padding``, so a
batch from one band pads its tokens to at most ``padding`` times their number, whatever else is in the
table.  A band's batches hold as many rows as fit the budget at the band's longest length, and a row's
place in its band says its batch: a two-level index, no group is gathered, however many requests are alike
in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_index

PADDING = 1.1


def band_lengths(limit: int, padding: float = PADDING) -> list[int]:
    """The longest length of each band, from ``limit`` down to 1."""
    if limit <= 0 or padding <= 1:
        raise ValueError("a limit must be positive and a padding above 1")
    out = [limit]
    while (shorter := int(out[-1] / padding)) > 0:
        out.append(shorter)
    return out


def _band(n: Column, limit: int, padding: float) -> Column:
    held = F.array_min(F.filter(F.array(*map(F.lit, band_lengths(limit, padding))), lambda e: e >= n))
    return F.coalesce(held, F.raise_error(F.concat(F.lit("a request has "), n.cast("string"), F.lit(f" tokens, over the limit of {limit}"))).cast("int"))


def token_batches(requests: DataFrame, budget: int, limit: int, ids: str = "ids", order: list[str] | None = None, padding: float = PADDING) -> DataFrame:
    """``requests`` with n (its tokens), band (its band's longest length), batch (0-based in the band) and
    place (in the batch).

    ``order``: columns that order a band's rows; by default a hash of the ids, so that rows with equal ids may
    change places.  A band whose length is over the budget has one row a batch; a request without tokens,
    or with null, counts as one of one token.
    """
    if budget <= 0:
        raise ValueError("a token budget must be positive")
    n = F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0))
    sized = requests.withColumn("n", n).withColumn("band", _band(F.greatest("n", F.lit(1)), limit, padding))
    if order is None:
        sized, order = sized.withColumn("_order", F.xxhash64(ids)), ["_order"]
    placed = with_index(sized, "_at", order, ["band"])
    rows = F.greatest(F.call_function("div", F.lit(budget), F.col("band")), F.lit(1))
    return placed.withColumn("batch", F.call_function("div", F.col("_at"), rows)).withColumn("place", F.col("_at") % rows).drop("_at", "_order")


def padding_report(batched: DataFrame) -> DataFrame:
    """(band, batches, requests, tokens, padded_tokens, largest): ``padded_tokens`` with each row as long as its
    batch's longest, ``largest`` those of the band's largest batch."""
    each = batched.groupBy("band", "batch").agg(F.count("*").alias("r"), F.sum("n").alias("t"), (F.count("*") * F.max("n")).alias("p"))
    return each.groupBy("band").agg(F.count("*").alias("batches"), F.sum("r").alias("requests"), F.sum("t").alias("tokens"), F.sum("p").alias("padded_tokens"), F.max("p").alias("largest"))
