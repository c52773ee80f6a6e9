import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import checkpoints, requests, scoring
from lodeworks.sources import tensorfiles
from test_scoring import TOK, NextLetter


def save(path, tensors, gap=0, **header):
    """A tensor file; tensors: name -> (dtype name, shape, bytes)."""
    at, told = 0, dict(header)
    for name, (dtype, shape, raw) in tensors.items():
        told[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw) + gap
    head = json.dumps(told).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + b"".join(raw + bytes(gap) for *_, raw in tensors.values()))


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 10**9])
def test_every_type_is_read_in_any_ranges(spark, tmp_path, range_bytes):
    x = np.arange(-5, 6)
    own = {code: (code, [11], x.astype(t).tobytes()) for code, t in tensorfiles.DTYPES.items() if code not in ("BF16", "BOOL")}
    own["BF16"] = ("BF16", [11], (x.astype(np.float32).view(np.uint32) >> 16).astype("<u2").tobytes())
    own["BOOL"] = ("BOOL", [11], (x > 0).tobytes())
    own |= {"none": ("F32", [3, 0], b""), "one": ("F64", [], np.float64(2.5).tobytes())}
    save(tmp_path / "a.safetensors", own, __metadata__={"format": "x"})
    rows = tensorfiles.read_tensors(spark, str(tmp_path), range_bytes=range_bytes, row_elements=4).collect()
    for name, (code, shape, raw) in own.items():
        parts = sorted((r["start"], r["values"]) for r in rows if r["name"] == name)
        got = [v for _, p in parts for v in p]
        want = x.astype(float) if code == "BF16" else np.frombuffer(raw, tensorfiles.DTYPES[code]).astype(float)
        assert got == want.tolist()
        assert {(r["dtype"], tuple(r["shape"]), r["elements"]) for r in rows if r["name"] == name} == {(code, tuple(shape), math.prod(shape))}
    heads = tensorfiles.read_tensors(spark, str(tmp_path), headers=True).collect()
    assert sorted(r["name"] for r in heads) == sorted(own)


def test_ranges_cut_a_large_tensor(spark, tmp_path):
    save(tmp_path / "a.safetensors", {"w": ("F32", [1000, 100], np.arange(100_000, dtype="<f4").tobytes())})
    read = tensorfiles.read_tensors(spark, str(tmp_path), range_bytes=50_001)
    assert read.rdd.getNumPartitions() == 9
    got = read.select(F.explode("values").alias("v")).agg(F.count("*"), F.sum("v"), F.countDistinct("v")).first()
    assert tuple(got) == (100_000, sum(range(100_000)), 100_000)


def test_written_and_read_again(spark, tmp_path):
    rows = [(f"t{i}", [2, i], [float(j) / 4 for j in range(2 * i)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "name string, shape array<int>, values array<float>").repartition(3)
    for dtype in ("F16", "F32", "F64"):
        folder = str(tmp_path / dtype)
        tensorfiles.write_tensors(df, folder, dtype=dtype, file_bytes=300)
        assert len(tensorfiles.list_files(folder)) > 3 and not list((tmp_path / dtype).glob("*.tmp"))
        back = tensorfiles.read_tensors(spark, folder, range_bytes=64).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "values"))).alias("p"), F.first("shape").alias("shape"))
        got = sorted((r["name"], r["shape"], [v for p in r["p"] for v in p["values"]]) for r in back.collect())
        assert got == sorted(rows)
    with pytest.raises(Exception, match="holds tensor files"):
        tensorfiles.write_tensors(df, str(tmp_path / "F32"))
    bad = spark.createDataFrame([("t", [2, 2], [1.0])], "name string, shape array<int>, values array<float>")
    with pytest.raises(Exception, match="does not have the shape"):
        tensorfiles.write_tensors(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir())


def test_what_is_wrong_is_told(spark, tmp_path):
    f4 = lambda *x: np.array(x, "<f4").tobytes()
    save(tmp_path / "a.safetensors", {"good": ("F32", [2], f4(1, -3)), "odd": ("F32", [3], f4(1, np.inf, np.nan)), "wide": ("F32", [2, 1], f4(0, 0)), "twice": ("F32", [1], f4(0))})
    save(tmp_path / "b.safetensors", {"twice": ("F32", [1], f4(0)), "more": ("I64", [1], (7).to_bytes(8, "little"))})
    save(tmp_path / "c.safetensors", {"x": ("F32", [2], f4(1, 2))}, gap=4)
    save(tmp_path / "d.safetensors", {"x": ("F8", [2], b"ab")})
    (tmp_path / "e.safetensors").write_bytes(b"abc")
    (tmp_path / "f.safetensors").write_bytes((3).to_bytes(8, "little") + b"[1]")
    expected = spark.createDataFrame([("good", [2]), ("odd", [3]), ("wide", [1, 2]), ("twice", [1]), ("gone", [4])], "name string, shape array<int>")
    report = checkpoints.inspect(tensorfiles.read_tensors(spark, str(tmp_path), outline=True, range_bytes=5), expected)
    got = {r["name"]: r for r in report.collect() if r["name"]}
    assert {k: r["errors"] for k, r in got.items()} == {
        "good": [], "odd": ["2 values are not finite"], "wide": ["shape [2, 1], not [1, 2]"], "twice": ["held by 2 files"], "more": ["unexpected"], "gone": ["missing"],
    }
    assert (got["good"]["low"], got["good"]["high"], got["odd"]["high"]) == (-3.0, 1.0, 1.0)
    files = sorted(r["errors"][0].rsplit("/", 1)[-1] for r in report.collect() if not r["name"])
    assert [x[0] for x in files] == ["c", "d", "e", "f"] and "unknown type F8" in files[1] and "cut off" in files[2] and "not readable" in files[3]
    assert checkpoints.summary(report).first().asDict() == {"passed": False, "tensors": 5, "parameters": 9, "weights_finite": False, "errors": 9}


def test_nothing_there_and_nothing_expected(spark, tmp_path):
    read = tensorfiles.read_tensors(spark, str(tmp_path), outline=True)
    assert checkpoints.summary(checkpoints.inspect(read)).first().asDict() == {"passed": True, "tensors": 0, "parameters": 0, "weights_finite": True, "errors": 0}
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        tensorfiles.read_tensors(spark, str(tmp_path / "nowhere")).count()


def test_bands_keep_padding_below_their_factor():
    for limit, padding in ((1, 1.1), (7, 1.5), (4096, 1.1), (1000, 1.01)):
        edges = requests.band_lengths(limit, padding)
        assert edges[0] == limit and edges[-1] == 1 and all(a > b for a, b in zip(edges, edges[1:]))
        assert all(a <= padding * (b + 1) + 1e-9 for a, b in zip(edges, [*edges[1:], 0]))
    for wrong in ((0, 1.1), (5, 1.0)):
        with pytest.raises(ValueError):
            requests.band_lengths(*wrong)


def test_batches_fit_the_budget(spark):
    sizes = [64] * 500 + [i % 64 for i in range(700)] + [200] * 3
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate(sizes)] + [(-1, None)], "k int, ids array<int>").repartition(5)
    rows = requests.token_batches(df, 150, 256).collect()
    assert sorted(r["k"] for r in rows) == [-1, *range(len(sizes))]
    groups = {}
    for r in rows:
        groups.setdefault((r["band"], r["batch"]), []).append(r)
    for (band, _), own in groups.items():
        n = [max(r["n"], 1) for r in own]
        assert max(n) <= band and (len(n) * max(n) <= 150 or len(n) == 1) and len(n) * max(n) <= 1.1 * sum(n) + 1e-9
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    report = requests.padding_report(requests.token_batches(df, 150, 256)).collect()
    assert sum(r["batches"] for r in report) == len(groups) and sum(r["tokens"] for r in report) == sum(sizes)
    with pytest.raises(Exception, match="over the limit of 100"):
        requests.token_batches(df, 150, 100).collect()
    assert requests.token_batches(df.limit(0), 150, 256).count() == 0


def test_scores_do_not_depend_on_the_batches(spark):
    rows = [(i, "ab" * (i % 9 + 1), "cde"[: i % 3 + 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, context string, continuation string").repartition(4)
    one = scoring.loglikelihood(df, "k", TOK, 2, 12, NextLetter).collect()
    for budget in (1, 30, 10_000):
        other = scoring.loglikelihood(df, "k", TOK, 2, 12, NextLetter, budget=budget).collect()
        assert {r["k"]: (round(r[1], 9), r[2]) for r in other} == {r["k"]: (round(r[1], 9), r[2]) for r in one}
    texts = spark.createDataFrame([(1, "\x03\x04\x05\x06\x07" * 9), (2, ""), (3, "z"), (4, None)], "k int, text string")
    got, want = (dict(scoring.rolling_loglikelihood(texts, "k", TOK, 2, 3, NextLetter, budget=b).collect()) for b in (7, None))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
