"""Connected components of a link table, as DataFrame rounds (large-star, small-star).

Both stars keep the components as they are and every round shrinks the depth of the trees, so the
number of rounds is about logarithmic.  Nothing is collected: each round is two aggregations and
two joins on a node id, and one aggregation tells whether only stars are left.  Minima are pre-aggregated before they are shuffled, and written, so that the
joins have plain exchanges on both sides and adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds after which something must be wrong (2^40 nodes in one path need about 40).
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    # every row has b < a here: b is a smaller neighbour of a
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))), least


def _round(links: DataFrame) -> DataFrame:
    """Both stars, written; the tables in between are deleted."""
    large, least = _large_star(links)
    between = written(large.distinct(), "links")
    small, lower = _small_star(between)
    out = written(small.distinct(), "links")
    for done in (links, least, between, lower):
        discard(done)
    return out


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which has none itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Nulls and self-links are ignored; nodes without links do not appear.  The links may be given
    in any direction and repeatedly.  Links that are stars already, or none, take no round.  More than
    ``rounds`` rounds are an error, never an unfinished result.
    """
    now = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "links",
    )
    done = _is_forest_of_stars(now)
    for _ in range(rounds):
        if done:
            break
        now = _round(now)
        done = _is_forest_of_stars(now)
    if not done:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    # a star's nodes have one link each, to its smallest node
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionAll(roots)
