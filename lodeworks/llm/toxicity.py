"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w . x - c_k): the weights w are shared by all thresholds c_1 < c_2 < ..., so
the grades stay ordered, and the expected severity is the sum of P(grade > k) over k.

The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by a hash of the id)
and on the ``FEATURES`` words that tell toxic from clean documents best; word statistics of the sample
are aggregated by Spark, the small sparse matrix is fitted on the driver.  Every document is then
scored over its whole text, on the executors.

Where labels say only toxic or not, the toxic rows are graded 1 to 3 by thirds of how often they use
the words that mark toxicity (``severity_grades``); clean rows have grade 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: Bounds of the fit: labelled rows (expected number), and words.
TRAIN_ROWS, FEATURES = 20_000, 1024
#: A word must occur in so many rows, and in this share of as many rows as are toxic.
LEAST_ROWS, LEAST_SHARE = 5, 0.02
#: A word marks toxicity from this z-score of its log-odds on.
MARK = 4.0
GRADES, RIDGE, ROUNDS = 4, 2.0, 300
_NO_WORD = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of anything but ASCII characters that are no letters, and white space."""
    return (text or "").lower().translate(_NO_WORD).split()


def sparse(text: str | None, index: dict[str, int]) -> tuple[list[int], list[float]]:
    """Known words of a whole text, with 1 + log of their counts."""
    seen = Counter(index[w] for w in words_of(text) if w in index)
    return list(seen), [1.0 + math.log(n) for n in seen.values()]


@dataclass
class OrdinalModel:
    """Words, shared weights and ordered cut points."""

    words: list[str]
    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, score: float) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -500, 500)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, features: int, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximise the penalised likelihood of the grades (Adam, full batches)."""
    top = int(grades.max(initial=0))
    if not len(rows) or not top:
        return np.zeros(features), np.full(max(top, 1), 30.0)
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col, val = np.concatenate([i for i, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])
    over = (grades[:, None] > np.arange(top)).astype(np.float64)  # n x top
    share = over.mean(axis=0).clip(1e-6, 1 - 1e-6)
    first = math.log(1 / share[0] - 1)
    # cuts are the first and the logs of the gaps, which keeps them ordered
    gaps = np.log(np.maximum(np.diff(np.log(1 / share - 1)), 1e-2))
    x = np.concatenate([np.zeros(features), [first], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, cuts = x[:features], x[features] + np.concatenate([[0.0], np.cumsum(np.exp(x[features + 1 :]))])
        score = np.bincount(at, weights=val * w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500)))
        # likelihood of grade g: P(>g-1) - P(>g)
        edge = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        pick = np.arange(len(rows))
        hi, lo = edge[pick, grades], edge[pick, grades + 1]
        like = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        d_score = slope_hi - slope_lo
        d_cut = np.zeros(top)
        np.add.at(d_cut, grades[grades > 0] - 1, -slope_hi[grades > 0])
        np.add.at(d_cut, grades[grades < top], slope_lo[grades < top])
        grad = np.empty_like(x)
        grad[:features] = np.bincount(col, weights=val * d_score[at], minlength=features) - ridge * w
        grad[features] = d_cut.sum()
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad[features + 1 :] = tail[1:] * np.exp(x[features + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:features], x[features] + np.concatenate([[0.0], np.cumsum(np.exp(x[features + 1 :]))])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(key, text, label) of about ``rows`` distinct labelled texts, by hashes of id and text.

    Ids may have any type.  Null ids, labels and texts are left out; a text with several labels, by
    repeated labels or repeated documents, has the highest; a text counts once, however often it comes.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    share = min(1.0, rows / max(1, usable.count()))
    picked = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("id").agg(F.max("label").alias("label"))
    few = picked.count() <= 2 * rows + 1000
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    met = held.join(F.broadcast(picked) if few else picked, "id").groupBy("text").agg(F.max("label").alias("label"))
    return met.select(F.xxhash64("text").alias("key"), "text", "label")


def bounded(picked: DataFrame, rows: int) -> DataFrame:
    """``picked``, or about ``rows`` of it by a hash if ids that repeat made it larger than twice that."""
    n = picked.count()
    return picked if n <= 2 * rows + 1000 else picked.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def _word_table(picked: DataFrame, features: int, least: int) -> list[tuple[str, float]]:
    """(word, z) of the words whose log-odds of toxicity stand out most, either way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for x, y in zip(batch.column(0), batch.column(1).to_pylist()):
                (toxic if y else clean).update(set(words_of(x.as_py())))
            words = list({**toxic, **clean})
            cols = [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["word", "t", "c"])

    counted = picked.select("text", "label").mapInArrow(run, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n_t, n_c = (picked.filter(c).count() for c in ("label > 0", "label = 0"))
    odds = F.log((F.col("t") + 0.5) / (F.lit(n_t) - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(n_c) - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counted.filter(F.col("t") + F.col("c") >= max(least, LEAST_SHARE * n_t)).withColumn("z", odds / error).orderBy(F.abs("z").desc(), "word").limit(features)
    return [(r["word"], r["z"]) for r in best.select("word", "z").collect()]  # `features` rows


def severity_grades(labels: np.ndarray, marks: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean rows; 1 .. grades - 1 for toxic ones, by equal parts of their marking words."""
    out = np.zeros(len(labels), np.int64)
    toxic = labels > 0
    if toxic.any():
        cuts = np.quantile(marks[toxic], np.arange(1, grades - 1) / (grades - 1))
        out[toxic] = 1 + np.searchsorted(cuts, marks[toxic], side="left")
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, features: int = FEATURES, graded: bool = False) -> OrdinalModel:
    """Fit on labelled rows (see ``sample``); ``graded``: labels are grades 0, 1, ... already, else 0 or 1.

    Without labelled texts, or without toxic ones, the model calls nothing toxic.
    """
    picked = bounded(written(sample(docs, labels, id_col, text_col, label_col, rows), "labelled"), rows)
    best = _word_table(picked, features, LEAST_ROWS)
    index = {w: i for i, (w, _) in enumerate(best)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sparse(x.as_py(), index) for x in batch.column(0)]
            cols = [batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["label", "i", "v", "key"])

    # a bounded sample: at most `rows` or so, of at most `features` numbers each
    got = picked.select("text", "label", "key").mapInArrow(run, "label int, i array<int>, v array<double>, key long").toPandas().sort_values("key")
    matrix = [(np.asarray(i, np.int64), np.asarray(v, np.float64)) for i, v in zip(got["i"], got["v"])]
    labels_ = got["label"].to_numpy(dtype=np.int64)
    if not graded:
        strong = np.array([z >= MARK for _, z in best], bool)
        marks = np.array([v[strong[i]].sum() if len(i) else 0.0 for i, v in matrix]) if len(best) else np.zeros(len(matrix))
        labels_ = severity_grades(labels_, marks)
    weights, cuts = fit_ordinal(matrix, labels_, len(best))
    return OrdinalModel([w for w, _ in best], weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, grade, toxic) of every whole text.

    grade: the most probable one (ties: the lower); toxic: P(grade > 0) is at least one half.  A null
    or empty text has no features and gets what the cut points alone give, clean unless most of the
    sample is toxic.  Rows with null or repeated ids are scored like any other.
    """
    index = {w: i for i, w in enumerate(model.words)}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                i, v = sparse(x.as_py(), index)
                p = model.exceed(float(model.weights[i] @ np.array(v)) if i else 0.0)
                grades = -np.diff(np.concatenate([[1.0], p, [0.0]]))
                out.append((float(p.sum()), int(grades.argmax()), bool(p[0] >= 0.5)))
            cols = [batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "expected_severity", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, grade int, toxic boolean")
