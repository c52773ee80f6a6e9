"""Evaluation requests through a pluggable model: log-likelihoods, rolling scores, generation.

A scorer is made once in each worker.  Requests are encoded and cut by columns.  With a token ``budget``
they are put into batches of like lengths over the whole table (``requests``) and dealt to the workers by
batch; without one they stay where they are and each Arrow batch is sorted by length.  Results go back to
their request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from ..functions.text import cut_at_stops
from ..functions.tokenizers import Tokenizer
from ..session import shuffle_width, stored
from . import metrics
from .decoding import encode_pairs, left_truncated
from .requests import token_batches
from .windows import scoring_windows


class Scorer(Protocol):
    def logits(self, ids: list[list[int]]) -> list[np.ndarray]:
        """For each row of ids a matrix: a row of logits for the token after each position."""

    def generate(self, ids: list[list[int]], most: int) -> list[list[int]]:
        """Greedy continuations, up to ``most`` tokens or the end token."""


ScorerFactory = Callable[[], Scorer]


def _target_rows(scorer: Scorer, ids: list[list[int]], firsts: list[int]) -> Iterator[tuple[int, float, bool]]:
    """(row, log-probability, greedy) of every token from index ``first`` on."""
    for row, (own, first, z) in enumerate(zip(ids, firsts, scorer.logits(ids))):
        part = np.asarray(z, np.float64)[first - 1 : len(own) - 1]
        top = part.max(axis=1, keepdims=True)
        logp = part - top - np.log(np.exp(part - top).sum(axis=1, keepdims=True))
        for k, t in enumerate(own[first:]):
            yield row, float(logp[k, t]), int(part[k].argmax()) == t


def _in_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame for each run of rows that are alike in band and batch, across Arrow batches."""
    held: list[pd.DataFrame] = []
    now = None
    for frame in frames:
        for name, part in frame.groupby(["band", "batch"], sort=False):
            if held and name != now:
                yield pd.concat(held)
                held = []
            held.append(part)
            now = name
    if held:
        yield pd.concat(held)


def _by_length(batch: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(n=frame["ids"].map(len)).sort_values("n")
            for a in range(0, len(frame), batch):
                yield frame.iloc[a : a + batch]

    return cut


def _scored(windows: DataFrame, key: str, make: ScorerFactory, batch: int, budget: int | None, limit: int) -> DataFrame:
    """(key, logp, greedy) of the targets of windows (key, ids, first), which have ``limit`` tokens at most."""
    rows, cut = windows.select(key, "ids", "first"), _by_length(batch)
    if budget is not None:
        planned = token_batches(stored(rows, "requests"), budget, limit)  # the index reads it more than once
        width = shuffle_width(windows.sparkSession)  # a number of its own: bytes say little of a model's work
        rows, cut = planned.repartition(width, "band", "batch").sortWithinPartitions("band", "batch"), _in_batches

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for part in cut(frames):
            found = list(_target_rows(scorer, [list(map(int, x)) for x in part["ids"]], part["first"].tolist()))
            yield pd.DataFrame({key: part[key].to_numpy()[[r[0] for r in found]], "logp": [r[1] for r in found], "greedy": [r[2] for r in found]})

    kind = windows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, logp double, greedy boolean")


def loglikelihood(requests: DataFrame, key: str, tokenizer: Tokenizer, end_id: int, limit: int, make: ScorerFactory, batch: int = 8, budget: int | None = None) -> DataFrame:
    """(key, log_likelihood, is_greedy) of continuations given their contexts.

    ``requests``: key, context and continuation.  Contexts are cut on the left to fit ``limit``; a
    continuation without tokens, or too long for any context, is an error.  ``batch``: rows of a batch;
    ``budget``: tokens of one, padding included, planned over the whole table instead.
    """
    coded = encode_pairs(requests, tokenizer, end_id)
    some = F.when(F.size("continuation_ids") > 0, F.col("continuation_ids")).otherwise(F.raise_error(F.lit("a continuation has no tokens")).cast("array<int>"))
    coded = coded.select(key, left_truncated(F.col("context_ids"), some, limit).alias("c"), some.alias("t"))
    return metrics.sequence_scores(_scored(coded.select(key, F.concat("c", "t").alias("ids"), F.size("c").alias("first")), key, make, batch, budget, limit), key)


def rolling_loglikelihood(requests: DataFrame, key: str, tokenizer: Tokenizer, end_id: int, limit: int, make: ScorerFactory, text: str = "text", batch: int = 8, budget: int | None = None) -> DataFrame:
    """(key, log_likelihood) of whole texts: one total for each request; an empty text has 0."""
    ids = F.concat(F.array(F.lit(end_id)), tokenizer.ids(F.coalesce(F.col(text), F.lit(""))))
    coded = requests.select(key, ids.alias("all"))
    cut = scoring_windows(coded, "all", limit).select(key, F.col("window").alias("ids"), F.lit(1).alias("first"))
    sums = metrics.sequence_scores(_scored(cut, key, make, batch, budget, limit), key).select(key, "log_likelihood")
    return requests.select(key).join(sums, key, "left").withColumn("log_likelihood", F.coalesce("log_likelihood", F.lit(0.0)))


def chosen(logits: np.ndarray, draws: np.ndarray | None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> np.ndarray:
    """The next token of each row: the best one (the first of equals), or, given a number in [0, 1) for
    each row, one drawn by probability among those that ``top_k`` (ties kept) and then ``top_p`` leave."""
    z = np.asarray(logits, np.float64)
    if draws is None:
        return z.argmax(axis=1)
    if temperature <= 0:
        raise ValueError("a temperature must be positive")
    z = z / temperature
    if top_k is not None:
        least = np.sort(z, axis=1)[:, -min(top_k, z.shape[1])]
        z = np.where(z < least[:, None], -np.inf, z)
    order = np.argsort(-z, axis=1, kind="stable")
    p = np.exp(np.take_along_axis(z, order, axis=1) - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    if top_p is not None and top_p < 1.0:
        p[np.cumsum(p, axis=1) - p > top_p] = 0.0  # what comes before a token has passed top_p
        p /= p.sum(axis=1, keepdims=True)
    at = (np.cumsum(p, axis=1) <= draws[:, None]).sum(axis=1)
    return np.take_along_axis(order, np.minimum(at, (p > 0).sum(axis=1) - 1)[:, None], axis=1)[:, 0]


def generate_tokens(
    requests: DataFrame, key: str, make: ScorerFactory, limit: int, most: int, end_id: int | None = None, seed: int | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, ids: str = "ids", batch: int = 8
) -> DataFrame:
    """(key, token_ids): up to ``most`` new tokens after each row's ``ids``, one after another.

    The model sees the last ``limit`` tokens.  Without a ``seed`` the best token is taken, else one is
    drawn by a number fixed by seed, key and step.  A row ends with its own end token, so that it does
    not depend on the rows that happen to be in its batch.
    """
    if limit <= 0 or most < 0:
        raise ValueError("a limit must be positive and a number of tokens not negative")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                held = [list(map(int, x)) for x in part["ids"]]
                new: list[list[int]] = [[] for _ in held]
                names = part[key].tolist()
                for step in range(most):
                    live = [i for i, own in enumerate(new) if not own or own[-1] != end_id]
                    if not live:
                        break
                    last = np.stack([np.asarray(z)[-1] for z in scorer.logits([held[i][-limit:] for i in live])])
                    draws = None if seed is None else np.array([stable_seed(seed, names[i], step) / 2.0**64 for i in live])
                    for i, t in zip(live, chosen(last, draws, temperature, top_k, top_p).tolist()):
                        held[i].append(t)
                        new[i].append(t)
                yield pd.DataFrame({key: part[key].to_numpy(), "token_ids": new})

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, F.col(ids).alias("ids")).mapInPandas(run, f"`{key}` {kind}, token_ids array<int>")


def generate_until(requests: DataFrame, key: str, tokenizer: Tokenizer, end_id: int, limit: int, make: ScorerFactory, stops: list[str], most: int = 256, context: str = "context", batch: int = 8) -> DataFrame:
    """(key, text): greedy continuations without special tokens, cut at the stop strings; an empty
    context is the end token."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                heads = [(tokenizer.encode(c or "") or [end_id])[-limit:] for c in part[context]]
                yield pd.DataFrame({key: part[key].to_numpy(), "text": [tokenizer.decode(own, skip_special=True) for own in scorer.generate(heads, most)]})

    kind = requests.schema[key].dataType.simpleString()
    made = requests.select(key, context).mapInPandas(run, f"`{key}` {kind}, text string")
    return made.withColumn("text", cut_at_stops(F.col("text"), stops))
