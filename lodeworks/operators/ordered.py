"""Ordered prefix sums and indices at scale.

A window over a whole source is one task.  Here rows are cut into blocks of the order key; each
(source, block) is summed on its own, the block totals (a row for each) are summed once more, and
both are added.  The heavy window is spread over blocks, whatever share of rows a source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows of a block, about; the most blocks, by even steps of a dense key or by cuts from a sample.
BLOCK, MOST_STEPS, MOST_CUTS = 100_000, 4096, 1024
_SAMPLED, _GROUP = 32, 32


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are alike; the keys come from the left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    met = left.join(named, on, how)
    return met if how in ("left_semi", "left_anti") else met.drop(*[f"_r_{k}" for k in keys])


def block_column(df: DataFrame, key: str, width: int = BLOCK) -> Column | None:
    """Blocks of about ``width`` rows, ascending with ``key``; None if one block is enough.

    A dense whole-number key is cut in even steps, any other (sparse, hashed, text) at quantiles of a
    sample of at most a few ten thousand keys.  Rows of one key share a block; a null key is in the
    first one or in one of its own before it, as nulls sort.
    """
    n, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    if n <= width or low is None:
        return None
    blocks = -(-n // width)
    if isinstance(df.schema[key].dataType, IntegralType) and high - low < 4 * n:
        step = max(1, (high - low + 1) // min(blocks, MOST_STEPS))
        return F.floor((F.col(key) - F.lit(low)) / F.lit(step))
    blocks = min(blocks, MOST_CUTS)
    picked = df.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, _SAMPLED * blocks / n), seed=17)
    keys = [r[0] for r in picked.orderBy(key).collect()]
    cuts = sorted(set(keys[:: max(1, len(keys) // blocks)]))
    if not cuts:
        return None

    # two steps of at most ``_GROUP`` comparisons or so, not one for each cut
    def up_to(values: list) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, values)), lambda b: b <= F.col(key)))

    groups = [cuts[i : i + _GROUP] for i in range(0, len(cuts), _GROUP)]
    group = up_to([g[0] for g in groups])
    inner = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group - 1), lambda b: b <= F.col(key)))
    return F.when(group < 1, F.lit(0)).otherwise((group - 1) * _GROUP + inner)


def with_prefix_sums(df: DataFrame, sums: dict[str, Column], order: list[str], by: list[str], block: Column | None = None, width: int = BLOCK) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its value over all earlier rows (long; 0 for
    the first).

    ``order``: columns of any type that can be ordered; the first fixes the block (``block`` overrides
    it and must not decrease in that order).  Ties are broken by the remaining columns.
    """
    block = block_column(df, order[0], width) if block is None else block
    keyed = df.withColumn("_block", F.lit(0) if block is None else block)
    for name, value in sums.items():
        keyed = keyed.withColumn(f"_v_{name}", value.cast("long"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed
    for name in sums:
        local = local.withColumn(name, F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)).cast("long"))
    if block is None:
        return local.select(*df.columns, *sums)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*by, "_block").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    bases = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    met = null_safe_join(local, bases, [*by, "_block"])
    return met.select(*df.columns, *[(F.col(name) + F.col(f"_b_{name}")).cast("long").alias(name) for name in sums])


def with_prefix_sum(df: DataFrame, value: Column, name: str, order: list[str], by: list[str], block: Column | None = None, width: int = BLOCK) -> DataFrame:
    """``with_prefix_sums`` of one value."""
    return with_prefix_sums(df, {name: value}, order, by, block, width)


def with_index(df: DataFrame, name: str, order: list[str], by: list[str], **how) -> DataFrame:
    """``df`` with the 0-based position of each row in its group."""
    return with_prefix_sum(df, F.lit(1), name, order, by, **how)


def within_budget(df: DataFrame, length: str, budget: int, order: list[str], by: list[str], **how) -> DataFrame:
    """Rows up to and with the one that reaches the budget, in order."""
    if budget <= 0:
        raise ValueError("a token budget must be positive")
    return with_prefix_sum(df, F.col(length), "_before", order, by, **how).filter(F.col("_before") < budget).drop("_before")


def within_ranges(points: DataFrame, ranges: DataFrame, point: str, first: str, end: str, by: list[str] | None = None) -> DataFrame:
    """``points`` with the columns of the range (first <= point < end) that holds them; points in none are
    left out.  Ranges of a group ``by`` must not overlap; empty ones hold nothing.

    Every range is filed under the one or two bins that it meets of a width of its own size, the next power
    of two, and a point looks into the bin that it is in at each of the widths that there are.  So the
    join is on equal bins: a bin holds at most three ranges, however uneven they are.
    """
    by = by or []
    size = F.col(end) - F.col(first)
    level = F.ceil(F.log2(size.cast("double"))).cast("int")
    filed = ranges.filter(size > 0).withColumn("_level", level)
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())  # 63 at most
    wide = F.expr("shiftleft(1L, _level)")
    bins = filed.withColumn("_bin", F.explode(F.sequence(F.call_function("div", F.col(first), wide), F.call_function("div", F.col(end) - 1, wide))))
    named = bins.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_level", "_bin", *[c for c in ranges.columns if c not in by])
    at = F.array(*[F.struct(F.lit(n).alias("_level"), F.expr(f"shiftright(`{point}`, {n})").cast("long").alias("_bin")) for n in levels])
    looked = points.withColumn("_at", F.explode(at if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")))
    on = (F.col("_at._level") == F.col("_level")) & (F.col("_at._bin") == F.col("_bin"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    met = looked.join(named, on).filter((F.col(point) >= F.col(first)) & (F.col(point) < F.col(end)))
    return met.drop("_at", "_level", "_bin", *[f"_g_{c}" for c in by])
