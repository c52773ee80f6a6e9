import numpy as np

from lodeworks.functions.hashing import stable_seed
from lodeworks.operators import mixture


def test_a_pass_is_given_out_in_parts(spark):
    """The same permutation as numpy's own, in frames of a bounded number of rows."""
    passes = spark.createDataFrame([("a", 3, 200_000), ("b", 0, 0), ("c", 1, 1)], "source string, pass long, windows long")
    made = mixture.pass_order(passes, 42)
    want = np.random.default_rng(np.random.SeedSequence([stable_seed("stream", 42, "a"), 3])).permutation(200_000)
    got = made.filter("source = 'a'").orderBy("rank").toPandas()
    assert got["window_index"].tolist() == want.tolist() and got["rank"].tolist() == list(range(200_000))
    frames = passes.coalesce(1)

    class Table:  # takes the function that works on the frames
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return [len(x) for x in run([frames.toPandas()])]

    assert max(mixture.pass_order(Table(), 42)) <= mixture.CHUNK


def test_ranks_are_listed_by_many_tasks(spark):
    passes = spark.createDataFrame([("a", 0, 1000), ("b", 0, 0), ("c", 1, 1)], "source string, pass long, windows long")
    made = mixture.listed_ranks(passes.coalesce(1), chunk=100)
    assert sorted((r["source"], r["rank"]) for r in made.collect()) == [*(("a", i) for i in range(1000)), ("c", 0)]
    assert made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 2
