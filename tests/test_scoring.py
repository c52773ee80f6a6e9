import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodeworks.functions.tokenizers import CodepointTokenizer
from lodeworks.operators import batches, scoring

TOK = CodepointTokenizer()
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


class NextLetter:
    """Prefers the code point after the last one, by 2 in logits."""

    def logits(self, ids):
        out = []
        for own in ids:
            z = np.zeros((len(own), 256))
            z[np.arange(len(own)), (np.array(own) + 1) % 256] = 2.0
            out.append(z)
        return out

    def generate(self, ids, most):
        return [[(own[-1] + 1 + k) % 256 for k in range(min(most, 6))] for own in ids]


RIGHT = 2 - math.log(math.exp(2) + 255)
WRONG = -math.log(math.exp(2) + 255)


def test_loglikelihood(spark):
    rows = [(1, "ab", "cd"), (2, "ab", "cx"), (3, "xxxxxxxxa", "b"), (4, "", "\x03")]
    df = spark.createDataFrame(rows, "k int, context string, continuation string").repartition(3)
    got = {r["k"]: (r["log_likelihood"], r["is_greedy"]) for r in scoring.loglikelihood(df, "k", TOK, 2, 4, NextLetter, batch=2).collect()}
    assert got[1] == (pytest.approx(2 * RIGHT), True) and got[2] == (pytest.approx(RIGHT + WRONG), False)
    assert got[3] == (pytest.approx(RIGHT), True) and got[4] == (pytest.approx(RIGHT), True)
    with pytest.raises(Exception, match="no room"):
        scoring.loglikelihood(spark.createDataFrame([(1, "a", "bcde")], df.schema), "k", TOK, 2, 4, NextLetter).collect()


def test_rolling_gives_a_total_for_each_request(spark):
    df = spark.createDataFrame([(1, "\x03\x04\x05\x06\x07"), (2, ""), (3, "z"), (4, None)], "k int, text string")
    got = {r["k"]: r["log_likelihood"] for r in scoring.rolling_loglikelihood(df, "k", TOK, 2, 3, NextLetter).collect()}
    assert got == {1: pytest.approx(5 * RIGHT), 2: 0.0, 3: pytest.approx(WRONG), 4: 0.0}


def test_generation_stops(spark):
    df = spark.createDataFrame([(1, "a"), (2, "x")], "k int, context string")
    got = {r["k"]: r["text"] for r in scoring.generate_until(df, "k", TOK, 2, 8, NextLetter, ["e", "|"]).collect()}
    assert got == {1: "bcd", 2: "yz{"}


def test_epoch_orders(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, again, other = ([r["k"] for r in batches.epoch_order(df.repartition(n), "k", 7, e).orderBy("position").collect()] for n, e in ((2, 0), (9, 0), (2, 1)))
    assert one == again != other and sorted(one) == list(range(500)) and one != sorted(one)
    assert batches.first_batches(spark.range(9).select((F.col("id") / 2).cast("int").alias("batch_id")), 2).count() == 4
    assert batches.tokens_per_step(8, 256) == 2048


def test_progress_is_observed(spark):
    df, watch = batches.observed(spark.range(7), odd=F.count_if(F.col("id") % 2 == 1))
    df.collect()
    assert watch.get == {"rows": 7, "odd": 3}


def test_progress_is_told_every_so_many_rows(spark):
    told = []
    with batches.progress(spark.range(0, 1000, 1, 8), 200, told.append, pause=0.01) as rows:
        assert rows.count() == 1000
    assert told == sorted(told) and told[-1] == 1000 and len({n // 200 for n in told}) == len(told)
    with pytest.raises(ValueError), batches.progress(spark.range(1), 0, told.append):
        pass


def test_choices_among_what_the_filters_leave():
    z = np.log(np.array([[0.5, 0.25, 0.15, 0.1]]))

    def seen(**how):
        return [int(scoring.chosen(z, np.array([x]), **how)[0]) for x in np.linspace(0, 0.999, 200)]

    assert scoring.chosen(z, None).tolist() == [0] and scoring.chosen(np.zeros((1, 4)), None).tolist() == [0]
    assert [seen().count(t) / 200 for t in range(4)] == pytest.approx([0.5, 0.25, 0.15, 0.1], abs=0.02)
    assert set(seen(top_k=2)) == {0, 1} and set(seen(top_p=0.4)) == {0} and set(seen(top_p=0.5)) == {0, 1} and set(seen(top_p=1.0)) == {0, 1, 2, 3}
    tied = np.zeros((1, 4))
    assert {int(scoring.chosen(tied, np.array([x]), top_k=1)[0]) for x in np.linspace(0, 0.999, 50)} == {0, 1, 2, 3}  # ties are kept
    assert seen(temperature=0.05).count(0) == 200
    with pytest.raises(ValueError):
        scoring.chosen(z, np.array([0.1]), temperature=0)


def test_generated_tokens_end_with_a_rows_own_end_and_do_not_depend_on_batches(spark):
    df = spark.createDataFrame([(i, [5, i]) for i in range(20)], "k long, ids array<int>")
    got = {r["k"]: r["token_ids"] for r in scoring.generate_tokens(df.repartition(3), "k", NextLetter, 4, 5, end_id=9).collect()}
    assert got[7] == [8, 9] and got[1] == [2, 3, 4, 5, 6] and got[9] == [10, 11, 12, 13, 14]
    one, other = ({r["k"]: tuple(r["token_ids"]) for r in scoring.generate_tokens(df.repartition(n), "k", NextLetter, 4, 5, seed=3, batch=b).collect()} for n, b in ((1, 20), (7, 2)))
    assert one == other and len(set(one.values())) > 10
