"""Token-weighted metrics over per-token losses and per-request scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Losses above this are taken as this before they are exponentiated.
LOSS_CAP = 20.0


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(LOSS_CAP)))


def _summary(loss: Column, hits: Column, n: Column) -> list[Column]:
    over = F.greatest(n, F.lit(1)).cast("double")
    mean = F.coalesce(loss, F.lit(0.0)) / over
    return [mean.alias("loss"), perplexity(mean).alias("perplexity"), (F.coalesce(hits, F.lit(0)).cast("double") / over).alias("token_accuracy"), n.alias("tokens")]


def token_metrics(tokens: DataFrame, loss: str = "loss", correct: str = "correct") -> DataFrame:
    """One row: mean loss, perplexity and accuracy over all tokens (zeros and 1.0 without any)."""
    got = tokens.agg(F.sum(loss).alias("_l"), F.sum(F.col(correct).cast("long")).alias("_h"), F.count("*").alias("_n"))
    return got.select(*_summary(F.col("_l"), F.col("_h"), F.col("_n")))


def source_metrics(tokens: DataFrame, sources: DataFrame, key: str = "source_id", name: str = "source", loss: str = "loss", correct: str = "correct") -> DataFrame:
    """The same for every listed source, those without tokens too."""
    got = tokens.groupBy(key).agg(F.sum(loss).alias("_l"), F.sum(F.col(correct).cast("long")).alias("_h"), F.count("*").alias("_n"))
    met = sources.select(key, name).join(got, key, "left")
    return met.select(key, name, *_summary(F.col("_l"), F.col("_h"), F.coalesce("_n", F.lit(0))))


def supervised(examples: DataFrame, keys: list[str], values: list[str], mask: str = "loss_mask") -> DataFrame:
    """A row for every supervised target: position p (from 1) where the mask, past its first entry,
    is set; ``values`` are arrays aligned with the targets (one shorter than the mask)."""
    cells = F.arrays_zip(F.slice(mask, F.lit(2), F.size(mask) - 1).alias("on"), *[F.col(v).alias(v) for v in values])
    rows = examples.filter(F.size(mask) > 1).select(*keys, F.posexplode(cells).alias("p", "cell"))
    return rows.filter(F.col("cell.on") == 1).select(*keys, (F.col("p") + 1).alias("p"), *[F.col(f"cell.{v}").alias(v) for v in values])


def masked_loss(examples: DataFrame, loss: str = "loss", mask: str = "loss_mask", by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Mean loss over supervised targets and their number.

    ``strict``: no target at all is an error when the result is read, as in training; otherwise the
    mean is then null (or the group not there).
    """
    rows = supervised(examples, by or [], [loss], mask)
    mean = F.avg(loss)
    if strict:
        mean = F.when(F.count("*") > 0, mean).otherwise(F.raise_error(F.lit("no supervised target")).cast("double"))
    aggs = [mean.alias("mean_loss"), F.count("*").alias("targets")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def reweighted(batches: DataFrame, mean: str = "mean_loss", n: str = "targets", correct: str = "correct") -> DataFrame:
    """Batch means put together by their numbers of targets."""
    got = batches.agg(F.sum(F.col(mean) * F.col(n)).alias("_l"), F.sum(correct).alias("_h"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("_n"))
    return got.select(*_summary(F.col("_l"), F.col("_h"), F.col("_n")))


def logged_means(steps: DataFrame, interval: int, step: str = "step", loss: str = "loss", n: str = "tokens") -> DataFrame:
    """Token-weighted mean of each logging window; steps 0, k, 2k, ... close a window."""
    closes = (F.ceil(F.col(step) / F.lit(interval)) * interval).cast("long")
    return steps.groupBy(closes.alias("logged_step")).agg(F.sum(F.col(loss) * F.col(n)).alias("_l"), F.sum(n).cast("long").alias("tokens")).select("logged_step", "tokens", (F.col("_l") / F.greatest("tokens", F.lit(1)).cast("double")).alias("mean_loss"))


def best_so_far(evals: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """Whether each evaluation is strictly below all before it (a run's few evaluations)."""
    before = F.min(loss).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return evals.withColumn("best_before", before).withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def sequence_scores(tokens: DataFrame, request: str, logp: str = "logp", greedy: str = "greedy") -> DataFrame:
    """Per request: the sum of log-probabilities, and whether every token was the greedy choice."""
    return tokens.groupBy(request).agg(F.sum(logp).alias("log_likelihood"), F.bool_and(greedy).alias("is_greedy"))


def is_finite(values: Column) -> Column:
    """No component is NaN or infinite."""
    return ~F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def decays(name: Column, dimensions: Column) -> Column:
    """Whether a parameter takes weight decay: matrices do, but for biases, embeddings and the head."""
    exempt = name.endswith(".bias") | name.contains("embedding") | name.contains("lm_head")
    return (dimensions >= 2) & ~exempt


def parameter_count(parameters: DataFrame, elements: str = "elements", trainable: str = "trainable") -> DataFrame:
    n = F.col(elements)
    return parameters.agg(F.sum(n).cast("long").alias("parameters"), F.coalesce(F.sum(F.when(F.col(trainable), n)), F.lit(0)).cast("long").alias("trainable_parameters"))


def plain_names(parameters: DataFrame, name: str = "name", prefix: str = "module.") -> DataFrame:
    """``parameters`` without a prefix that all names have; if only some have it, names stay."""
    tables = parameters.agg(F.bool_and(F.startswith(F.col(name), F.lit(prefix))).alias("_all"))
    short = F.when(F.col("_all"), F.substring(F.col(name), F.lit(len(prefix) + 1), F.length(name))).otherwise(F.col(name))
    return parameters.crossJoin(F.broadcast(tables)).withColumn(name, short).drop("_all")  # one row on the right
