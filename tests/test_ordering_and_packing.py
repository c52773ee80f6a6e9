import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import shards
from lodeworks.operators.ordered import block_column, with_index, with_prefix_sum, with_prefix_sums, within_budget


def greedy(lengths, cap, rule):
    out, held, shard = [], 0, 0
    for n in lengths:
        if rule == shards.BEFORE and held and held + n > cap:
            shard, held = shard + 1, 0
        out.append(shard)
        held += n
        if rule == shards.AFTER and held >= cap:
            shard, held = shard + 1, 0
    return out


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
@pytest.mark.parametrize("seed", range(40))
def test_cut_points_in_batches(rule, seed):
    rnd = random.Random(seed)
    lengths, cap = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 40))], rnd.randint(1, 20)
    cuts = sorted({0, len(lengths), rnd.randint(0, len(lengths)), rnd.randint(0, len(lengths))})
    out, shard, held, pending = [], 0, 0, False
    for a, b in zip(cuts, cuts[1:]):
        new, left = shards.cut_points(np.array(lengths[a:b]), cap, rule, held)
        new[0] |= pending
        out += (shard + np.cumsum(new)).tolist()
        shard, held, pending = out[-1], left, rule == shards.AFTER and left == 0
    assert out == greedy(lengths, cap, rule)


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
def test_packing_is_the_same_under_any_partitioning(spark, rule):
    rnd = random.Random(1)
    rows = [(i, f"s{rnd.randint(0, 2)}", rnd.randint(1, 30)) for i in range(400)] + [(1000, None, 5), (1001, None, 500), (1002, None, 1)]
    want = {}
    for s in ("s0", "s1", "s2", None):
        own = [(i, n) for i, x, n in rows if x == s]
        want |= dict(zip((i for i, _ in own), greedy([n for _, n in own], 60, rule)))
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for partitions in (1, 4, 17):
        got = shards.assign_shards(df.repartition(partitions), 60, rule, ["source"], "doc_id").collect()
        assert {r["doc_id"]: r["shard_index"] for r in got} == want


def test_prefix_sums_across_blocks(spark):
    rows = [(i * 7 % 100, "a" if i % 3 else None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = with_index(with_prefix_sum(df, F.col("v"), "before", ["k"], ["g"], width=13), "i", ["k"], ["g"], width=13).collect()
    for g in ("a", None):
        total = 0
        for n, r in enumerate(sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])):
            assert (r["before"], r["i"]) == (total, n)
            total += r["v"]


def test_budget_keeps_the_document_that_reaches_it(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(9)], "doc_id long, source string, n long")
    for budget, kept in ((30, 3), (31, 4), (1, 1), (1000, 9)):
        assert within_budget(df, "n", budget, ["doc_id"], ["source"]).count() == kept
    with pytest.raises(ValueError):
        within_budget(df, "n", 0, ["doc_id"], ["source"])


def stretches(lengths, span):
    """(number, totals before, lengths) of the stretches that hold a document."""
    before = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
    return [(int(k), before[before // span == k], np.array(lengths)[before // span == k]) for k in np.unique(before // span)]


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
@pytest.mark.parametrize("seed", range(60))
def test_jumps_put_in_a_row_give_the_greedy_walk(rule, seed):
    rnd = random.Random(seed)
    lengths, cap = [rnd.choice([0, *range(1, 9), 25, 90]) for _ in range(rnd.randint(1, 80))], rnd.randint(1, 30)
    span = cap * rnd.randint(2, 4)
    out, at, target, begun = [], [], shards._FIRST[rule], 0
    for k, before, own in stretches(lengths, span):
        got, positions = shards._along(before, own, target, begun, cap, rule)
        out += got.tolist()
        at += positions.tolist()
        jump = shards.Jump.of(before, own, k * span, cap, rule)
        assert len(jump.edges) <= (before < k * span + cap).sum() + 1 or rule == shards.BEFORE
        target, more = (int(x[0]) for x in jump.apply(np.array([target]), rule))
        begun += more
    assert out == greedy(lengths, cap, rule)
    for i, s in enumerate(out):
        assert at[i] == sum(n for n, x in zip(lengths[:i], out) if x == s)


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
@pytest.mark.parametrize("seed", range(40))
def test_a_lifted_jump_does_what_its_parts_do(rule, seed):
    rnd = random.Random(seed)
    lengths, cap = [rnd.choice([0, 1, 2, 5, 60]) for _ in range(rnd.randint(20, 90))], rnd.randint(2, 20)
    span = 2 * cap
    parts = [(k * span, shards.Jump.of(before, own, k * span, cap, rule)) for k, before, own in stretches(lengths, span)]
    whole = parts[-1][1]
    for begin, jump in parts[-2::-1]:
        whole = jump.then(whole, begin + cap, rule)
    for target in range(-1, cap):  # those that the open shard before can have
        want, begun = np.array([target]), 0
        for _, jump in parts:
            want, more = jump.apply(want, rule)
            begun += int(more[0])
        got, n = whole.apply(np.array([target]), rule)
        assert (int(got[0]), int(n[0])) == (int(want[0]), begun)


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
def test_jumps_are_small_at_the_default_cap(rule):
    """Four million documents of 665 tokens: far fewer numbers than documents."""
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.pareto(1.5, 4_000_000) * 330 + 2, 200_000).astype(np.int64)
    before = np.cumsum(lengths) - lengths
    jump = shards.Jump.of(before, lengths, 0, 100_000_000, rule)
    assert 3 * 8 * len(jump.edges) * 100_000 / len(lengths) < 25_000  # bytes for 100,000 documents; lengths alone: 800,000


@pytest.mark.parametrize("width", [7, 1000])
@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
def test_packing_in_blocks_of_sparse_and_text_keys(spark, rule, width):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 10**15), "hot" if rnd.random() < 0.7 else rnd.choice(["b", None]), rnd.choice([1, 2, 3, 9, 40])) for _ in range(300)]
    want = {}
    for s in ("hot", "b", None):
        own = sorted((k, n) for k, x, n in rows if x == s)
        want |= dict(zip((k for k, _ in own), greedy([n for _, n in own], 33, rule)))
    df = spark.createDataFrame(rows, "k long, source string, n_tokens long")
    got = shards.assign_shards(df.repartition(5), 33, rule, ["source"], "k", width=width, stretch=width).collect()
    assert {r["k"]: r["shard_index"] for r in got} == want
    text = df.withColumn("k", F.lpad(F.col("k").cast("string"), 16, "0"))
    got = shards.assign_shards(text, 33, rule, ["source"], "k", width=width, stretch=width).collect()
    assert {int(r["k"]): r["shard_index"] for r in got} == want


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_prefix_sums_of_sparse_keys(spark, kind):
    rnd = random.Random(5)
    keys = rnd.sample(range(10**12), 200)
    df = spark.createDataFrame([(k, "a" if k % 4 else None, k % 11) for k in keys] + [(None, "a", 5)], "k long, g string, v long").withColumn("k", F.lpad(F.col("k").cast("string"), 13, "0") if kind == "string" else F.col("k").cast(kind))
    got = with_prefix_sums(df, {"before": F.col("v"), "i": F.lit(1)}, ["k"], ["g"], width=9).collect()
    for g in ("a", None):
        total = 0
        for n, r in enumerate(sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"] is not None, r["k"]))):
            assert (r["before"], r["i"]) == (total, n)
            total += r["v"]


def test_blocks_are_even_whatever_the_keys(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") * 977 + 10**9).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for key in ("k", "h"):
        sizes = [r["count"] for r in df.groupBy(block_column(df, key, 200).alias("b")).count().collect()]
        assert len(sizes) >= 15 and max(sizes) <= 1000
    assert block_column(df, "k", 5000) is None


def test_gaps_are_ranges(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 5), ("a", 10**9), ("b", 4), ("b", None), (None, 1), (None, 3)], "source string, shard_index long")
    got = {(r["source"], r["first"], r["last"]) for r in shards.missing_ranges(df).collect()}
    assert got == {("a", 1, 1), ("a", 3, 4), ("a", 6, 10**9 - 1), (None, 2, 2)}
    report = {r["source"]: r["error"] for r in shards.source_report(df.withColumn("tokens", F.lit(1)).withColumn("eos_tokens", F.lit(1))).collect()}
    assert report == {"a": "missing shard indices 1, 3, 4, 6-999999999", "b": None, None: "missing shard indices 2"}


@pytest.mark.parametrize("rule", [shards.AFTER, shards.BEFORE])
def test_lifted_levels_and_equal_keys(spark, rule, monkeypatch):
    """Chains over several levels of jumps; documents alike in their key are told apart by another."""
    monkeypatch.setattr(shards, "_FAN", 3)
    rnd = random.Random(11)
    rows = [(i // 3, i, "hot" if rnd.random() < 0.8 else None, rnd.choice([0, 1, 2, 3, 70])) for i in range(500)]
    want = {}
    for s in ("hot", None):
        own = [(i, n) for _, i, x, n in rows if x == s]
        want |= dict(zip((i for i, _ in own), greedy([n for _, n in own], 10, rule)))
    df = spark.createDataFrame(rows, "k long, i long, source string, n_tokens long")
    got = shards.assign_shards(df.repartition(3), 10, rule, ["source"], "k", width=9, stretch=5, ties=["i"]).collect()
    assert {r["i"]: r["shard_index"] for r in got} == want
    held = {}
    for r in sorted(got, key=lambda r: r["i"]):
        assert r["position"] == held.get((r["source"], r["shard_index"]), 0)
        held[r["source"], r["shard_index"]] = r["position"] + r["n_tokens"]
