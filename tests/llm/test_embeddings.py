import math

import helpers
import numpy as np
import pytest

from lodeworks.llm import embeddings


def plain(rows, threshold=0.9):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    roots = helpers.components({rows[k][0] for k in unit}, [(rows[a][0], rows[b][0]) for a, b in linked])
    n = {k: sum(k in p for p in linked) for k in unit}
    return [(i, n.get(k, 0), roots.get(i, i) if k in unit else i) for k, (i, v) in enumerate(rows)]


def planted(seed=0, groups=60, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [base]
    for cosine in (0.97, 0.99, 0.85):
        side = rng.standard_normal((groups, d))
        side -= (side * base).sum(axis=1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        rows.append(cosine * base + math.sqrt(1 - cosine**2) * side)
    return np.concatenate(rows).astype(np.float32)


def test_planted_pairs_and_odd_rows(spark):
    x = planted()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [1.0] * 63 + [None]), (1003, [float("nan")] * 64), (1004, [float("inf")] + [0.0] * 63), (1005, rows[0][1]), (1006, [v * 1e-30 for v in rows[1][1]]), (1007, []), (1008, [1.0, 2.0]), (1009, [2.0, 4.0]), (None, rows[2][1])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, id long, v double")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    found, there = sum(r["n_links"] for r in got.values()), sum(n for _, n, _ in want)
    assert found >= 0.98 * there and all(got[i]["n_links"] <= n for i, n, _ in want)
    assert sum(got[i]["component_id"] == c for i, _, c in want) >= 0.98 * len(want)
    assert all(r["kept"] == (r["component_id"] in (None, i)) for i, r in got.items())
    for i in (*range(1000, 1005), 1007, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i
    assert got[1008]["component_id"] == got[1009]["component_id"] == 1008
    assert got[1005]["n_links"] == got[0]["n_links"] and got[1005]["component_id"] == 0


def test_large_cells_are_compared_in_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    x = (centre + 0.1 * rng.standard_normal((90, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "id long, v array<float>, times long")
    rows = embeddings.embedding_links(df, 64, block=8).filter("kind = 1").groupBy("x").sum("y").collect()
    links = {r["x"]: r["sum(y)"] for r in rows}
    assert len(links) == 90 and max(links.values()) <= 89 and sum(links.values()) >= 0.985 * 90 * 89


def test_estimates_are_unbiased_and_bounded():
    x = planted(3, 150).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embeddings.Codes.of(x, embeddings.rotation(64, 64 * embeddings.PADDING))
    at = np.arange(len(x))
    estimate, error = c.estimates(at, at)
    true = x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.01
    close = off & (true >= 0.9)
    assert ((estimate + embeddings.ERRORS * error) >= 0.9)[close].mean() > 0.995


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_just_above_the_threshold_are_met(spark):
    rng = np.random.default_rng(4)
    n, d = 4000, 64
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, d))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.linspace(0.9001, 0.92, n)[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    bits, tables = embeddings.tables_for(51_282)
    key = embeddings.cells(x, bits, tables)
    assert (key[:n] == key[n:]).any(axis=1).mean() >= 0.9995
    some = np.concatenate([x[:n:8], x[n::8]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(some)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[i + n // 8] == (1, i) and got[i] == (1, i) for i in range(n // 8)) >= n // 8 - 1


def test_query_and_its_sql_on_vectors_that_link(spark, tmp_path):
    """Groups at 0.9 to 1.0, copies and chains, in the registered query and in its SQL."""
    import duckdb

    from lodeworks.llm.queries import ORACLE_SQL, QUERIES

    x = planted(9, 80)
    rng = np.random.default_rng(1)
    chain = [rng.standard_normal(64)]
    for _ in range(6):  # neighbours at 0.93, ends far apart
        u = chain[-1] / np.linalg.norm(chain[-1])
        side = rng.standard_normal(64)
        side -= side @ u * u
        chain.append(0.93 * u + math.sqrt(1 - 0.93**2) * side / np.linalg.norm(side))
    rows = [*x, *chain, *x[:5], *(x[:5] * 3)]
    spark.createDataFrame([(i, "c", [float(v) for v in np.float32(r)]) for i, r in enumerate(rows)], "vec_id long, label string, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = c.sql(ORACLE_SQL["op2_embedding_near_dedup"])
    order = [sql.columns.index(n) for n in ("vec_id", "n_links", "component_id", "kept")]
    assert got == sorted(tuple(r[i] for i in order) for r in sql.fetchall())
    assert sum(n for _, n, *_ in got) > 300 and any(n == 0 for _, n, *_ in got)


def test_ids_of_any_type(spark):
    x = planted(5, 10)
    ids = [f"v{i:03}" for i in range(len(x) - 1)] + [None]
    got = embeddings.near_duplicates(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id string, embedding array<double>")).collect()
    want = {i: (n, c) for i, n, c in plain([(i, list(map(float, r))) for i, r in zip(ids, x)])}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_the_bound_holds_at_the_threshold_given(threshold):
    rng, n, d = np.random.default_rng(12), 400, 64
    turn, dropped = embeddings.rotation(d, 64), 0
    for _ in range(25):
        base, side = rng.standard_normal((2, n, d))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side -= (side * base).sum(axis=1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        both = np.concatenate([base, threshold * base + math.sqrt(1 - threshold**2) * side])
        estimate, error = embeddings.Codes.of(both, turn).estimates(np.arange(n), np.arange(n, 2 * n), threshold)
        dropped += int((np.diag(estimate) + embeddings.ERRORS * np.diag(error) < threshold).sum())
    assert dropped <= 5  # of 10,000
