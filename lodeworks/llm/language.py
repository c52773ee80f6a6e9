"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector, fixed by a seed and the letter alone.  A letter's place in
an n-gram permutes (rolls) its vector, the n-gram binds its letters by multiplication, a text
bundles its n-grams by addition, a language bundles the unit vectors of its texts, and a text is
given the language whose prototype has the highest cosine.

Learning is an aggregation of bundles (languages x dimension numbers); no text leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import with_prefix_sum
from .common import lean, small_batches, written

#: Dimension of the vectors, letters of an n-gram, seed of the letter vectors.
DIMENSION, ORDER, SEED = 512, 3, 20_011
#: Share of held-out rows that ``least_score`` leaves below it, and the fewest rows that can tell.
REJECT_SHARE, LEAST_HELD = 0.001, 50
UNKNOWN = "und"
#: Even ranges of the score in which held-out rows are counted.
SCORE_RANGES = 4_096
_BITS = 21  # of a code point; 0 is the boundary between words
_TABLE_SIZE = 0x250
#: Letters whose vectors a worker keeps, texts that are multiplied together, n-grams in a slice.
_KEPT, _TOGETHER, _SLICE = 8_192, 64, 8_192
#: Code points of a text that are looked at in one go.
_PART = 1 << 16


def _letter(code: int) -> int:
    """The letter (its lower case's first code point) that a code point stands for; 0 if for none."""
    c = chr(code)
    return ord(c.lower()[0]) if c.isalpha() else 0


class Profiler:
    """Bundled n-gram vectors of texts."""

    def __init__(self, dimension: int = DIMENSION, seed: int = SEED):
        self.dimension, self.seed = dimension, seed
        self.table = np.array([_letter(c) for c in range(_TABLE_SIZE)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.int64)  # letters, ascending
        self.rows = np.zeros((0, self.dimension), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """A letter's own vector of ones and minus ones; it depends on the seed and the letter alone."""
        return np.random.default_rng([self.seed, code]).integers(0, 2, self.dimension, dtype=np.int8) * 2 - 1

    def _learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.known)
        if not len(new):
            return
        if len(self.known) + len(new) > _KEPT:
            self._forget()
            new = np.unique(codes)
        known = np.concatenate([self.known, new])
        rows = np.concatenate([self.rows, np.stack([self.letter(int(c)) for c in new])])
        order = np.argsort(known)
        self.known, self.rows = known[order], rows[order]
        # the place of a letter in the n-gram rolls its vector
        self.placed = [np.roll(self.rows, ORDER - 1 - k, axis=1) for k in range(ORDER)]

    def _letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.table[np.minimum(codes, _TABLE_SIZE - 1)]
        far = np.flatnonzero(codes >= _TABLE_SIZE)
        if len(far):
            seen, back = np.unique(codes[far], return_inverse=True)
            letters[far] = np.array([_letter(int(c)) for c in seen], np.int64)[back]
        return letters

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (three code points in a number) and their counts; nothing if the text
        has no letter.  A text of any length is taken ``_PART`` code points at a time."""
        parts, held = [], np.zeros(1, np.int64)  # the letters that the next part's n-grams begin with
        for at in range(0, len(text) + 1, _PART):
            own = self._letters(text[at : at + _PART])
            if at + _PART > len(text):
                own = np.append(own, 0)  # a boundary at the end
            letters = np.concatenate((held, own))
            keep = np.ones(len(letters), bool)
            keep[len(held) :] = (letters[len(held) :] != 0) | (letters[len(held) - 1 : -1] != 0)  # runs of boundaries are one
            letters = letters[keep]
            gram = (letters[:-2] << 2 * _BITS) | (letters[1:-1] << _BITS) | letters[2:]
            gram.sort()
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            parts.append((gram[first], np.diff(np.append(first, len(gram)))))
            held = letters[-2:]
        if len(parts) == 1:
            return parts[0]
        grams, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        union, place = np.unique(grams, return_inverse=True)
        return union, np.bincount(place, weights=counts).astype(np.int64)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of distinct n-grams."""
        mask = (1 << _BITS) - 1
        parts = [grams >> 2 * _BITS, grams >> _BITS & mask, grams & mask]
        self._learn(np.unique(np.concatenate([np.unique(p) for p in parts])))
        a, b, c = (placed[np.searchsorted(self.known, p)] for placed, p in zip(self.placed, parts))
        return (a * b * c).astype(np.float32)

    def unit(self, texts: list[str]) -> np.ndarray:
        """One bundled vector of length 1 for each text; zero for a text without letters."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        for at in range(0, len(texts), _TOGETHER):
            own = [self.grams(x) for x in texts[at : at + _TOGETHER]]
            grams, counts = (np.concatenate([o[i] for o in own]) for i in (0, 1))
            union, place = np.unique(grams, return_inverse=True)
            row = np.repeat(np.arange(len(own)), [len(g) for g, _ in own])
            for low in range(0, len(union), _SLICE):  # bounded, however many distinct n-grams there are
                inside = (place >= low) & (place < low + _SLICE)
                table = np.zeros((len(own), min(_SLICE, len(union) - low)), np.float32)
                table[row[inside], place[inside] - low] = counts[inside]
                out[at : at + len(own)] += table @ self.bound(union[low : low + _SLICE])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


_profilers: dict[tuple[int, int], Profiler] = {}


def _profiler(dimension: int, seed: int) -> Profiler:
    if (dimension, seed) not in _profilers:
        _profilers[dimension, seed] = Profiler(dimension, seed)
    return _profilers[dimension, seed]


@dataclass
class Prototypes:
    """Learnt languages and their unit prototype vectors (languages x dimension)."""

    languages: list[str]
    vectors: np.ndarray
    dimension: int = DIMENSION
    seed: int = SEED


def _sampled(usable: DataFrame, id_col: str, text_col: str, rows: int | None) -> DataFrame:
    if rows is None:
        return usable
    share = min(1.0, rows / max(1, usable.select(F.lit(1)).count()))
    return usable if share == 1.0 else usable.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int | None = None, dimension: int = DIMENSION, seed: int = SEED
) -> Prototypes:
    """Prototypes from all labelled rows: those with text and a language.

    If ``rows`` is given, about so many of them are used, chosen by a hash of id and text: rows
    that repeat an id, or have none, are chosen singly as far as their texts differ, and rows alike in
    both are used all or none.  Languages whose texts have no letters are not learnt.
    """
    small_batches(labelled.sparkSession)
    picked = _sampled(labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), id_col, text_col, rows)

    @lean
    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = _profiler(dimension, seed), {}
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                sums[lang] = sums.get(lang, 0) + own.unit(group["text"].tolist()).astype(np.float64).sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    partial = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(bundle, "lang string, vector array<double>")
    summed = partial.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    got = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").collect()  # languages x dimension
    # rounded, so that the order of addition does not show
    vectors = np.array([[x["x"] for x in r["v"]] for r in got], np.float64).round(6).reshape(len(got), dimension)
    norm = np.linalg.norm(vectors, axis=1)
    keep = norm > 0
    return Prototypes([r["lang"] for r, k in zip(got, keep) if k], (vectors[keep] / norm[keep, None]).astype(np.float32), dimension, seed)


def identify(
    docs: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep: list[str] | None = None, lead_name: str = "lead"
) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with the predicted language, its cosine, 0 to 1
    (negative ones become 0), and its lead: how far the next language's cosine is behind.

    Columns of ``docs`` by these names are replaced.  A null text, or one without letters, is ``und``
    with score and lead 0; so is every text if nothing was learnt.  With one language learnt the lead is
    the score.  Equal cosines: the language first in alphabetical order.  Repeated rows are predicted alike.
    """
    names = np.array([*prototypes.languages, UNKNOWN], dtype=object)
    vectors, dimension, seed = prototypes.vectors, prototypes.dimension, prototypes.seed
    added = (lang_name, score_name, lead_name)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    width = len(keep)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _profiler(dimension, seed)
        for batch in batches:
            units = own.unit([x or "" for x in batch.column(width).to_pylist()])
            which, score, lead = np.full(len(units), len(vectors)), np.zeros(len(units)), np.zeros(len(units))
            some = units.any(axis=1)
            if len(vectors) and some.any():
                cosines = units[some] @ vectors.T
                which[some] = cosines.argmax(axis=1)
                ordered = np.sort(np.clip(cosines, 0, 1), axis=1)
                score[some] = ordered[:, -1]
                lead[some] = ordered[:, -1] - (ordered[:, -2] if len(vectors) > 1 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names[which].tolist(), pa.string()), pa.array(score), pa.array(lead)], [*keep, *added])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}`{lang_name}` string, `{score_name}` double, `{lead_name}` double")


def least_score(held: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_col: str = "lang", share: float = REJECT_SHARE) -> float:
    """The score that all but ``share`` of labelled rows kept apart from learning reach: a text below it
    is less like any language than they are.  All of them count; 0 if they are fewer than ``LEAST_HELD``."""
    usable = held.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    found = identify(usable.select(F.col(text_col).alias("text")), prototypes, keep=[]).filter(F.col("lang_pred") != UNKNOWN)
    scores = written(found.groupBy("score").count(), "scores")
    n = scores.agg(F.sum("count")).first()[0] or 0
    if n < LEAST_HELD:
        return 0.0
    place = (n - 1) * share
    # equal scores are one row; those before it are counted in ranges of the score, so none is sorted whole
    ranked = with_prefix_sum(scores, F.col("count"), "_before", ["score"], [], F.floor(F.col("score") * SCORE_RANGES))
    near = [F.max(F.when((F.col("_before") <= k) & (F.col("_before") + F.col("count") > k), F.col("score"))) for k in (math.floor(place), math.ceil(place))]
    low, high = ranked.agg(*near).first()
    return low + (high - low) * (place - math.floor(place))


def held_out(id_col: str = "doc_id"):
    """Rows kept apart from learning: CRC-32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
