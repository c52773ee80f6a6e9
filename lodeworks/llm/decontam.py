"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

A document is contaminated by a test item if it holds at least ``threshold`` of the item's distinct
five-word shingles, wherever in the document they are.

* Items are partitioned by size (powers of two of their shingle count).  From each item the k
  smallest shingle hashes are indexed, k being one more than the shingles that a match may miss at
  the partition's upper size.  A document that lacks all k lacks more than it may, so the MinHash
  search has no false negatives, however long the document is.
* Documents stream once past the index, inside one generated stage: words, shingle hashes, lookup.
* A hit keeps the item whose hash it was.  Only documents that hit are read again, and only against
  the shingles of those items, as text: exact shingle containment decides each (document, item) pair.
  Of their shingles only those that some item has are shuffled.
  A passage that thousands of items share meets the items that hit, not all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WIDTH, THRESHOLD = 5, 0.8
#: A side of a join is broadcast only if it was counted to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
_WORD = r"[\p{L}\p{N}]+"


def words(text):
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _positions(width: int):
    return F.sequence(F.lit(0), F.size("w") - width)


def _shingled(df: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """(key, w, i): a row for every shingle start of texts that have one."""
    held = df.select(F.col(key).alias("key"), words(F.col(text_col)).alias("w")).filter(F.size("w") >= width)
    return held.select("key", "w", F.explode(_positions(width)).alias("i"))


def _parts(width: int):
    return [F.get("w", F.col("i") + k) for k in range(width)]


def item_index(items: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(minima, shingles): (h, item) of each item's k smallest hashes, and (item, shingle, n)."""
    each = _shingled(items, id_col, text_col, width).select("key", F.concat_ws(" ", *_parts(width)).alias("shingle"), F.xxhash64(*_parts(width)).alias("h")).distinct()
    sized = each.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    # the largest size of the item's partition, and what a match of that size may miss, plus one
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = top - F.ceil(top * threshold) + 1
    ranked = sized.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("h", "shingle")))
    minima = ranked.filter(F.col("r") <= k).select("h", F.col("key").alias("item"))
    return minima, sized.select(F.col("key").alias("item"), "shingle", "n")


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast if it is small enough in rows and in bytes."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) + 32 if f.dataType.simpleString() == "string" else F.lit(16) for f in df.schema), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= BROADCAST_BYTES else df


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, item_id, n_item_shingles, n_shared, containment): every contaminated document and item.

    Items of fewer than ``width`` words have no shingle and match nothing; null texts have no words.
    Rows with one id are taken together as one document; rows without id are not reported.  Repeated
    items are reported once for each item id.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    minima, shingles = item_index(items, item_id, item_text, width, threshold)
    minima, shingles = written(minima, "minima"), written(shingles, "shingles")
    hashes = _shingled(docs, "id", "text", width).select("key", F.xxhash64(*_parts(width)).alias("h"))
    hits = written(hashes.join(_small(minima, broadcast_rows), "h").select("key", "item").distinct(), "hits")
    ids = written(hits.select(F.col("key").alias("id")).distinct(), "hitids")
    wanted = written(hits.join(_small(shingles, broadcast_rows), "item"), "wanted")  # the shingles of each pair's item
    again = docs.join(_small(ids, broadcast_rows), "id", "left_semi")
    held = _shingled(again, "id", "text", width).select("key", F.concat_ws(" ", *_parts(width)).alias("shingle"))
    held = held.join(_small(shingles.select("shingle").distinct(), broadcast_rows), "shingle", "left_semi").distinct()  # others prove nothing
    shared = held.join(wanted, ["key", "shingle"])
    counted = shared.groupBy("key", "item", "n").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared").cast("double") / F.col("n").cast("double")
    return counted.filter(share >= threshold).select(
        F.col("key").alias(id_col), F.col("item").alias(item_id), F.col("n").alias("n_item_shingles"), "n_shared", share.alias("containment")
    )


#: The same in DuckDB SQL.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
     iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) AS u(i)),
     its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM iw, unnest(range(1, len(w) - 3)) AS u(i)),
     n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / n::DOUBLE AS containment
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*)::DOUBLE / n::DOUBLE >= 0.8
"""
