"""Source divergence audit: how far the sources of a language are apart in what words they use.

Every group (language, source) prices each kept term of its language: p = 1 + floor(SCALE * (count +
SMOOTHING) / (all counts + SMOOTHING * kept terms)).  Two groups differ by the sum of abs(p - p') over
*all* kept terms, of which a group uses few.  So nothing is summed term by term that need not be.  With
z a group's price of a term that it lacks, for two groups g and h:

* a term of g alone costs abs(p - z_h), which depends on the term's count only: g's histogram of
  counts prices all of g's terms at once.  As p >= z_h for most counts, that is sum(p) - terms * z_h
  for the group, and twice z_h - p again for the low counts where it is not;
* a term of both was priced by both, and is corrected by a join of the two groups' postings;
* a term of neither costs abs(z_g - z_h), a constant: it is counted by inclusion and exclusion.

All is whole-number arithmetic in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import null_safe_join
from .common import lean, small_batches, written
from .terms import LETTERS, steps, terms

#: Steps of a thousand that make up the scale of prices, 10^9.
_THOUSANDS = 3
SMOOTHING, LEAST_DOCS, TOP = 5, 30, 50
_COUNTS = "lang string, source string, term string, n long, docs long"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a few megabytes of text each."""
    for whole in batches:
        for batch in steps(whole, 2):
            group, group_of = _groups(batch.column(0), batch.column(1))
            found = terms(batch.column(2), LETTERS)
            text, code, n = found.counted()
            width = max(1, len(found.distinct))
            keys, at = np.unique(group_of[text] * width + code, return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)  # exact below 2^53
            docs = np.bincount(at, minlength=len(keys))
            g, c = np.divmod(keys, width)
            cols = [*(x.take(pa.array(g)) for x in group), found.distinct.take(pa.array(c)), pa.array(total), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def _groups(lang: pa.Array, source: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct (lang, source) of a batch as two columns, and which of them each row is in."""
    one, two = lang.dictionary_encode(), source.dictionary_encode()
    width = max(1, len(two.dictionary))
    keys, at = np.unique(one.indices.to_numpy().astype(np.int64) * width + two.indices.to_numpy(), return_inverse=True)
    a, b = np.divmod(keys, width)
    return [one.dictionary.take(pa.array(a)), two.dictionary.take(pa.array(b))], at


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term.

    Batches are counted where they are read; Spark adds their counts up before and after the shuffle,
    whose key names the source too, so a frequent term is not one row's key for all sources.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(_partial), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, kept: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(10^9 * (count + smoothing) / (total + smoothing * kept)): a long division in steps of a
    thousand, so nothing overflows below 9 * 10^15 words.  Some term must be kept."""
    whole = total + F.lit(smoothing) * kept
    share, rest = F.call_function("div", count + smoothing, whole), (count + smoothing) % whole
    for _ in range(_THOUSANDS):
        share, rest = share * 1000 + F.call_function("div", rest * 1000, whole), (rest * 1000) % whole
    return share + 1


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang) of the terms in at least ``least_docs`` documents of their language;
    n_lang: occurrences in the language.  A (lang, term) has a row for each source at most."""
    same = Window.partitionBy("lang", "term")
    seen = term_counts(docs).withColumns({"_docs": F.sum("docs").over(same), "n_lang": F.sum("n").over(same)})
    return seen.filter(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (long), rank (int, from 1 per group and part).

    Part ``pair``: item is another source of the language, value the sum of abs(p - p') over all kept
    terms (0 if none is kept), every other source ranked.  Part ``term``: item is a kept term that the
    group uses and prices above its language, value the difference, the first ``top`` ranked.  By value,
    descending, equal ones by item in the order of UTF-8 bytes.  Null language, source or text is ''; a
    group without terms has pairs; repeated rows and ids count as often as they are there; ids and other
    columns are not looked at; a very long text is counted whole; an empty table gives no rows.
    """
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = written(kept_terms(own, least_docs), "kept_terms")
    known = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("total_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = null_safe_join(null_safe_join(own.select("lang", "source").distinct(), known, ["lang"], "left"), sums, ["lang", "source"], "left").fillna(0, ["terms", "total_lang", "total", "used"])
    lacks = F.when(F.col("terms") > 0, price(F.lit(0).cast("long"), F.col("total"), F.col("terms"), smoothing)).otherwise(0)
    groups = written(groups.withColumn("z", lacks), "groups")  # a row for each language and source

    priced = kept.join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("terms"), smoothing))
    pairs = _pairs(priced, groups)
    usual = price(F.col("n_lang"), F.col("total_lang"), F.col("terms"), smoothing)
    over = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - usual).alias("value")).filter("value > 0")
    return _ranked(pairs, "pair").unionByName(_ranked(over, "term").filter(F.col("rank") <= top))


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of sources of a language."""
    all_of = priced.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
    g = null_safe_join(groups, all_of, ["lang", "source"], "left").select("lang", "source", "terms", "used", "z", F.coalesce("sum_p", F.lit(0)).alias("sum_p"))
    a = g.select("lang", *[F.col(c).alias(f"a_{c}") for c in g.columns[1:]])
    b = g.select("lang", *[F.col(c).alias(f"b_{c}") for c in g.columns[1:]])
    gap = F.abs(F.col("a_z") - F.col("b_z"))
    neither = (F.col("a_terms") - F.col("a_used") - F.col("b_used")) * gap
    alone = F.col("a_sum_p") - F.col("a_used") * F.col("b_z") + F.col("b_sum_p") - F.col("b_used") * F.col("a_z")
    ends = ["lang", "a_source", "b_source"]
    base = a.join(b, "lang").filter("a_source < b_source").select(*ends, (neither + alone).alias("value"))

    # counts that a group prices below what another one's missing terms cost: twice the difference again
    most = g.groupBy("lang").agg(F.max("z").alias("most"))
    histogram = priced.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("times"))
    low = histogram.join(most, "lang").filter("p < most").join(g.select("lang", F.col("source").alias("other"), F.col("z").alias("z")), "lang").filter("p < z and source <> other")
    again = low.select("lang", F.least("source", "other").alias("a_source"), F.greatest("source", "other").alias("b_source"), (2 * F.col("times") * (F.col("z") - F.col("p"))).alias("value"))

    # terms of both: what they cost, for what they were priced by either
    post = priced.select("lang", "term", "source", "p", "z")
    one = post.select("lang", "term", F.col("source").alias("a_source"), F.col("p").alias("a_p"), F.col("z").alias("a_z"))
    two = post.select("lang", "term", F.col("source").alias("b_source"), F.col("p").alias("b_p"), F.col("z").alias("b_z"))
    right = F.abs(F.col("a_p") - F.col("b_p")) - F.abs(F.col("a_p") - F.col("b_z")) - F.abs(F.col("b_p") - F.col("a_z")) + gap
    both = one.join(two, ["lang", "term"]).filter("a_source < b_source").select(*ends, right.alias("value"))

    made = base.unionByName(again).unionByName(both).groupBy(*ends).agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
    return made.select("lang", "value", F.explode(sides).alias("_s")).select("lang", "_s.source", "_s.item", "value")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
     kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
     counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
     grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
              FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON k.lang = g.lang
              LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     told AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
              sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang FROM grid),
     priced AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v)::HUGEINT AS q FROM told),
     pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
               FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
               UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM every
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""
