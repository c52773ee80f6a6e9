"""Whether files of weights hold what a model expects, and finite numbers only.

A tensor's ranges are read in parallel and summed; only counts move.  What is wrong is a table, with a row
for each tensor and its errors, so a checkpoint of any size and any number of faults can be told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import null_safe_join


def _shown(shape: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ", "), F.lit("]"))


def inspect(outline: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(name, dtype, shape, elements, nonfinite, low, high, errors) of every tensor that is there or expected.

    ``outline``: rows of ``read_tensors(outline=True)``; ``expected``: name, shape (names must differ).  Errors are
    missing and unexpected tensors, other shapes, values that are not finite, names that several files
    hold, and files that cannot be read, which have rows of their own without a name.
    """
    whole, broken = outline.filter(F.col("error").isNull()), outline.filter(F.col("error").isNotNull())
    held = whole.groupBy("path", "name").agg(F.first("dtype").alias("dtype"), F.first("shape").alias("shape"), F.first("elements").alias("elements"), F.sum("n").alias("n"), F.sum("nonfinite").alias("nonfinite"), F.min("low").alias("low"), F.max("high").alias("high"))
    first = [F.min_by(c, "path").alias(c) for c in ("dtype", "shape", "elements")]
    found = held.groupBy("name").agg(*first, F.sum("nonfinite").alias("nonfinite"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("_files"), F.lit(True).alias("_here"))
    if expected is None:
        told = found.withColumns({"_want": F.lit(None).cast("array<bigint>"), "_expected": F.lit(True)})
    else:
        wanted = expected.select("name", F.col("shape").cast("array<bigint>").alias("_want"), F.lit(True).alias("_expected"))
        told = null_safe_join(found, wanted, ["name"], "left").unionByName(null_safe_join(wanted, found, ["name"], "left_anti"), allowMissingColumns=True)
    errors = F.array_compact(
        F.array(
            F.when(F.col("_here").isNull(), "missing"),
            F.when(F.col("_expected").isNull(), "unexpected"),
            F.when(F.col("_here") & (F.col("_want") != F.col("shape")), F.concat(F.lit("shape "), _shown(F.col("shape")), F.lit(", not "), _shown(F.col("_want")))),
            F.when(F.col("nonfinite") > 0, F.concat(F.col("nonfinite").cast("string"), F.lit(" values are not finite"))),
            F.when(F.col("_files") > 1, F.concat(F.lit("held by "), F.col("_files").cast("string"), F.lit(" files"))),
        )
    )
    out = told.select("name", "dtype", "shape", "elements", "nonfinite", "low", "high", errors.alias("errors"))
    files = broken.select(F.array(F.concat("path", F.lit(": "), "error")).alias("errors"))
    return out.unionByName(files, allowMissingColumns=True)


def summary(report: DataFrame) -> DataFrame:
    """One row of ``inspect``'s table: passed, tensors, parameters, weights_finite, errors."""
    there = F.col("dtype").isNotNull()
    finite = F.coalesce(F.bool_and(F.coalesce(F.col("nonfinite") == 0, F.lit(True))), F.lit(True))
    n = F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long")
    return report.agg((n == 0).alias("passed"), F.count_if(there).alias("tensors"), F.coalesce(F.sum("elements"), F.lit(0)).cast("long").alias("parameters"), finite.alias("weights_finite"), n.alias("errors"))
