"""Decoding as relations: one row for a row's token and logit; filters, choices, request encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import Tokenizer


def top_k(logits: DataFrame, k: int, row: str, logit: str = "logit") -> DataFrame:
    """Rows at or above the k-th largest logit; ties with it are kept."""
    order = Window.partitionBy(row).orderBy(F.col(logit).desc())
    return logits.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, row: str, logit: str = "logit", temperature: float = 1.0, name: str = "prob") -> DataFrame:
    if temperature <= 0:
        raise ValueError("a temperature must be positive")
    own = Window.partitionBy(row)
    z = F.col(logit) / temperature
    shifted = F.exp(z - F.max(z).over(own))
    return logits.withColumn(name, shifted / F.sum(shifted).over(own))


def log_softmax(logits: DataFrame, row: str, logit: str = "logit", name: str = "logp") -> DataFrame:
    own = Window.partitionBy(row)
    top = F.max(logit).over(own)
    return logits.withColumn(name, F.col(logit) - top - F.log(F.sum(F.exp(F.col(logit) - top)).over(own)))


def top_p(logits: DataFrame, p: float, row: str, token: str = "token", logit: str = "logit") -> DataFrame:
    """The smallest set of most probable tokens whose probabilities before the last one do not pass
    ``p``; the most probable token always stays.  Equal logits: the smaller token first."""
    if p >= 1.0:
        return logits
    order = Window.partitionBy(row).orderBy(F.col(logit).desc(), token).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_p").over(order), F.lit(0.0))
    return softmax(logits, row, logit, name="_p").withColumn("_before", before).filter(F.col("_before") <= p).drop("_p", "_before")


def greedy(logits: DataFrame, row: str, token: str = "token", logit: str = "logit") -> DataFrame:
    """Each row's token of the largest logit, the smallest token among equals."""
    best = F.max(F.struct(F.col(logit), (-F.col(token)).alias("n")))
    return logits.groupBy(row).agg(best.alias("_b")).select(row, (-F.col("_b.n")).alias(token))


def left_truncated(context: Column, continuation: Column, limit: int) -> Column:
    """The last context tokens that fit before the continuation; one at least must."""
    room = F.lit(limit) - F.size(continuation)
    fits = F.when(room >= 1, room).otherwise(F.raise_error(F.lit("continuation leaves no room for context")).cast("int"))
    n = F.least(fits, F.size(context))
    return F.slice(context, F.size(context) - n + 1, n)


def encode_pairs(requests: DataFrame, tokenizer: Tokenizer, end_id: int, context: str = "context", continuation: str = "continuation") -> DataFrame:
    """``requests`` with context_ids and continuation_ids.

    White space at the end of a context is moved to the continuation, whose ids are what the whole
    has past the context's.  An empty or blank context is the end token.
    """

    def pairs(c: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for left, right in zip(c, t):
            head = (left or "").rstrip()
            tail = (left or "")[len(head) :] + (right or "")
            if not head:
                out.append(([end_id], tokenizer.encode(tail if left else right or "")))
            else:
                own = tokenizer.encode(head)
                out.append((own, tokenizer.encode(head + tail)[len(own) :]))
        return pd.DataFrame(out, columns=["context_ids", "continuation_ids"])

    encoded = F.pandas_udf(pairs, "context_ids array<int>, continuation_ids array<int>")
    return requests.withColumn("_e", encoded(context, continuation)).select(*requests.columns, "_e.context_ids", "_e.continuation_ids")


def rms_norm(values: Column, epsilon: float = 1e-6, weights: Column | None = None) -> Column:
    """Each component over the root mean square, times its weight (one, if none are given)."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    scale = F.sqrt(total / F.size(values) + epsilon)
    normed = F.transform(values, lambda x: x.cast("double") / scale)
    return normed if weights is None else F.zip_with(normed, weights, lambda x, w: x * w.cast("double"))


def rotated(values: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary position: pairs (even, odd) of components turned by position x base^(-pair/pairs)."""
    n = F.size(values)

    def angle(i: Column) -> Column:
        return position * F.pow(F.lit(base), -(i - i % 2).cast("double") / n)

    def turned(x: Column, i: Column) -> Column:
        other = F.get(values, F.when(i % 2 == 0, i + 1).otherwise(i - 1)).cast("double")
        sign = F.when(i % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return x.cast("double") * F.cos(angle(i)) + sign * other * F.sin(angle(i))

    return F.transform(values, turned)


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def swiglu(gate: Column, up: Column) -> Column:
    """The gated unit of two arrays, component by component."""
    return F.zip_with(gate, up, lambda g, u: silu(g.cast("double")) * u.cast("double"))
