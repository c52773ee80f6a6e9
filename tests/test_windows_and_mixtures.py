import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions.hashing import stable_seed
from lodeworks.operators import mixture, windows
from lodeworks.operators.permutation import place_of, rank_of

WEIGHTS = {"books": 0.15, "news": 0.75, "scripts": 0.10}


def pieces(spark, sizes, cut=7):
    rows = []
    for n, (source, shard, size) in enumerate(sizes):
        ids = list(range(n * 1000, n * 1000 + size))
        rows += [(source, shard, a, ids[a : a + cut]) for a in range(0, size, cut)]
    return spark.createDataFrame(rows, "source string, shard_index long, start long, tokens array<int>")


def test_tiles_leave_no_gap(spark):
    got = windows.tile(pieces(spark, [("a", 0, 85)]), 16, ["source", "shard_index"], "start", "tokens").orderBy("window_index").collect()
    assert [r["window_index"] for r in got] == list(range(5)) and [t for r in got for t in r["tokens"]] == list(range(85))


@pytest.mark.parametrize("size,count", [(16, 0), (17, 1), (18, 1), (34, 2)])
def test_short_shards(spark, size, count):
    assert windows.tile(pieces(spark, [("a", 0, size)], 100), 16, ["source", "shard_index"], "start", "tokens").count() == count


def test_validation_pass(spark):
    made = pieces(spark, [("b", 0, 51), ("a", 0, 34), ("a", 1, 17), ("c", 0, 51)])
    sizes = made.groupBy("source", "shard_index").agg(F.sum(F.size("tokens")).alias("tokens"))
    counts = windows.window_counts(sizes, 16, ["source"])
    tiles = windows.tile(made, 16, ["source", "shard_index"], "start", "tokens")
    got = windows.samples(windows.full_split(tiles, counts, 5)).orderBy("sample_index").collect()
    assert [r["source_id"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and [r["batch_id"] for r in got] == [0] * 5 + [1] * 4
    assert all(r["x"][1:] == r["y"][:-1] and len(r["x"]) == 16 for r in got) and got[2]["x"][0] == 2000


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 15, 40])
def test_scoring_windows(spark, n):
    rows = windows.scoring_windows(spark.createDataFrame([(1, list(range(n)))], "i int, ids array<int>"), "ids", 8).orderBy("target_start").collect()
    assert [t for r in rows for t in r["window"][1:]] == list(range(1, n)) and all(len(r["window"]) <= 8 for r in rows)
    with pytest.raises(ValueError):
        windows.scoring_windows(spark.range(1), "ids", 1)


@pytest.mark.parametrize("size,want", [(1, (0, 1, 0)), (2, (0, 2, 0)), (7, (1, 5, 1)), (8, (1, 6, 1)), (30, (5, 22, 3)), (32, (5, 24, 3)), (100, (15, 75, 10))])
def test_quotas(size, want):
    assert tuple(mixture.quotas(size, WEIGHTS).values()) == want


def test_starved_sources_take_from_the_largest():
    assert mixture.quotas(3, {"a": 0.9, "b": 0.05, "c": 0.05}, ensure_all=True) == {"a": 1, "b": 1, "c": 1}
    assert mixture.quotas(2, {"a": 0.9, "b": 0.05, "c": 0.05}, ensure_all=True) == {"a": 2, "b": 0, "c": 0}


def test_unit_schedules():
    assert [mixture.unit_schedule(1, WEIGHTS).count(s) for s in WEIGHTS] == [5, 22, 3]
    assert [mixture.unit_schedule(8, WEIGHTS).count(s) for s in WEIGHTS] == [5, 24, 3]


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.6}, {"a": 1.5, "b": -0.5}, {}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        mixture.check_weights(weights)


def table(spark, counts):
    return spark.createDataFrame([(s, i, [hash(s) % 50, i]) for s, n in counts.items() for i in range(n)], "source string, window_index long, tokens array<int>")


def plain(counts, batch, seed, first, end):
    unit = mixture.unit_schedule(batch, WEIGHTS)
    served, out = dict.fromkeys(WEIGHTS, 0), []
    for step in range(end):
        for slot in range(batch):
            cycle, at = divmod(step * batch + slot, len(unit))
            labels = list(unit)
            np.random.default_rng(np.random.SeedSequence([seed, cycle])).shuffle(labels)
            s = labels[at]
            p, rank = divmod(served[s], counts[s])
            order = np.random.default_rng(np.random.SeedSequence([stable_seed("stream", seed, s), p])).permutation(counts[s])
            served[s] += 1
            if step >= first:
                out.append((step, slot, s, int(order[rank])))
    return out


def test_batches_equal_a_plain_stream_and_resume(spark):
    counts = {"books": 5, "news": 40, "scripts": 3}
    w = table(spark, counts)
    got = lambda a, b: sorted(tuple(r)[:4] for r in mixture.batches(spark, w, WEIGHTS, 8, 42, a, b).collect())
    want = plain(counts, 8, 42, 0, 25)
    assert got(0, 25) == want and got(15, 25) == [r for r in want if r[0] >= 15]


def test_every_window_once_a_pass_and_golden_order(spark):
    order = mixture.pass_order(spark.createDataFrame([("a", 0, 12), ("a", 1, 12)], "source string, pass long, windows long"), 42).collect()
    for p in (0, 1):
        own = [r["window_index"] for r in order if r["pass"] == p]
        assert sorted(own) == list(range(12))
    rng = lambda: np.random.default_rng(np.random.SeedSequence([42, 0]))
    assert rng().permutation(8).tolist() == [3, 4, 2, 7, 6, 1, 5, 0]
    labels = list("aabbbbcc")
    rng().shuffle(labels)
    assert "".join(labels) == "bbbccaba"


def test_long_run_share(spark):
    got = {r["source"]: r["count"] for r in mixture.label_plan(spark, 8, WEIGHTS, 1, 0, 60).groupBy("source").count().collect()}
    assert all(abs(got[s] / 480 - w) < 0.05 for s, w in WEIGHTS.items())


def test_guards(spark):
    with pytest.raises(ValueError):
        mixture.label_plan(spark, 0, WEIGHTS, 1, 0, 1)
    with pytest.raises(Exception, match="no full window"):
        mixture.draws(mixture.label_plan(spark, 8, WEIGHTS, 1, 0, 4), spark.createDataFrame([("news", 4)], "source string, windows long")).collect()
    assert [r["source"] for r in mixture.missing_sources(spark, WEIGHTS, spark.createDataFrame([("news",)], "source string")).collect()] == ["books", "scripts"]


@pytest.mark.parametrize("step", [0, 1, 3, 7, 29, 120])
def test_position_at_any_step(spark, step):
    per_pass = spark.createDataFrame([("books", 5), ("news", 40), ("scripts", 3)], "source string, windows long")
    served = {r["source"]: r["count"] for r in mixture.label_plan(spark, 8, WEIGHTS, 11, 0, step).groupBy("source").count().collect()}
    got = {r["source"]: (r["served"], r["pass"], r["cursor"]) for r in mixture.position_at(spark, 8, WEIGHTS, 11, step, per_pass).collect()}
    assert got == {s: (served.get(s, 0), *divmod(served.get(s, 0), n)) for s, n in (("books", 5), ("news", 40), ("scripts", 3))}


def test_hashed_batches_serve_every_window_once_a_pass(spark):
    counts = {"books": 5, "news": 40, "scripts": 3}
    got = mixture.batches(spark, table(spark, counts), WEIGHTS, 8, 42, 0, 40, order="hashed").collect()
    for s, n in counts.items():
        own = [r["window_index"] for r in sorted((r for r in got if r["source"] == s), key=lambda r: (r["step"], r["slot"]))]
        for p in range(len(own) // n):
            assert sorted(own[p * n : p * n + n]) == list(range(n))
    big = spark.createDataFrame([("a", 0, 1000), ("b", 1, 0)], "source string, pass long, windows long")
    order = mixture.hashed_order(big, 7, chunk=64).collect()
    assert sorted(r["rank"] for r in order) == sorted(r["window_index"] for r in order) == list(range(1000))


def test_lookup_in_uneven_ranges(spark):
    """One range of a million numbers, many of one, empty ones: each number finds its own."""
    sizes = [1, 0, 1, 1, 1_000_000, 3, 0, 1, 7, 1, 1, 1, 64, 65, 1]
    ends = np.cumsum(sizes)
    counts = spark.createDataFrame([(s, i, n, int(e - n)) for s in ("a", None) for i, (n, e) in enumerate(zip(sizes, ends))], "source string, shard_index long, windows long, first_window long")
    rnd = np.random.default_rng(1)
    numbers = [*range(12), *map(int, rnd.integers(0, ends[-1], 50)), *range(int(ends[-1]) - 150, int(ends[-1]))]
    asked = spark.createDataFrame([(n, "a") for n in numbers], "source_window long, source string")
    found = windows.locate_windows(asked, counts, 16)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["source_window"]: (r["shard_index"], r["window_index"], r["start"]) for r in found.collect()}
    for n in numbers:
        shard = int(np.searchsorted(ends, n, side="right"))
        at = n - int(ends[shard] - sizes[shard])
        assert got[n] == (shard, at, at * 17)


def test_lookup_of_samples(spark):
    made = pieces(spark, [("b", 0, 51), ("a", 0, 34), ("a", 1, 5), ("a", 2, 17), ("c", 0, 51)])
    counts = windows.window_counts(made.groupBy("source", "shard_index").agg(F.sum(F.size("tokens")).alias("tokens")), 16, ["source"])
    tiles = windows.tile(made, 16, ["source", "shard_index"], "start", "tokens")
    want = {tuple(r) for r in windows.full_split(tiles, counts, 5).select("sample_index", "source_id", "source", "shard_index", "window_index").collect()}
    asked = spark.range(9).select(F.col("id").alias("sample_index"))
    got = windows.locate_samples(asked, counts, 16)
    assert {tuple(r) for r in got.select("sample_index", "source_id", "source", "shard_index", "window_index").collect()} == want and len(want) == 9
    for wrong in (-1, 9):
        with pytest.raises(Exception, match="no window"):
            windows.locate_samples(spark.range(1).select(F.lit(wrong).cast("long").alias("sample_index")), counts, 16).collect()


def test_keyed_permutations(spark):
    sizes = [1, 2, 3, 5, 16, 17, 30, 101, 1025]
    each = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    made = each.crossJoin(spark.createDataFrame([("a",), ("b",)], "key string"))
    made = made.withColumn("place", place_of(F.col("rank"), F.col("n"), F.lit("7"), F.col("key"))).withColumn("back", rank_of(F.col("place"), F.col("n"), F.lit("7"), F.col("key")))
    rows = made.collect()
    assert all(r["back"] == r["rank"] for r in rows)
    orders = {}
    for r in rows:
        orders.setdefault((r["n"], r["key"]), {})[r["rank"]] = r["place"]
    for (n, _), order in orders.items():
        assert sorted(order.values()) == list(range(n))
    a, b = (np.array([orders[1025, k][i] for i in range(1025)]) for k in "ab")
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1025))[0, 1]) < 0.15
    with pytest.raises(Exception, match="not in a permutation"):
        spark.range(1).select(place_of(F.lit(5), F.lit(5), F.lit("7"))).collect()


def test_keyed_batches_far_into_an_endless_mixture(spark):
    """Twenty steps after a billion, over ten billion windows: a row for each draw of them, no more."""
    per_pass = spark.createDataFrame([(s, 10_000_000_000) for s in WEIGHTS], "source string, windows long")
    first, size = 1_000_000_000, 8
    plan = mixture.draws(mixture.label_plan(spark, size, WEIGHTS, 3, first, first + 20), per_pass)
    rows = mixture.keyed_draws(plan, per_pass, 3).collect()
    assert len(rows) == 20 * size and len({(r["source"], r["window_index"]) for r in rows}) == len(rows)
    assert all(0 <= r["window_index"] < 10_000_000_000 for r in rows)
    some = mixture.keyed_draws(mixture.draws(mixture.label_plan(spark, size, WEIGHTS, 3, first + 5, first + 6), per_pass), per_pass, 3).collect()
    assert {tuple(sorted(r.asDict().items())) for r in some} == {tuple(sorted(r.asDict().items())) for r in rows if r["step"] == first + 5}
