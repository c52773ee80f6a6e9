import gzip
import math

import pytest
from pyspark.sql import functions as F

from lodeworks.config import Data, Experiment, Model, Training, TuningData, load
from lodeworks.functions.text import cut_at_stops, shown_reply
from lodeworks.functions.tokenizers import CodepointTokenizer
from lodeworks.operators import decoding, metrics, schedules
from lodeworks.sources.blobs import fetch_text, is_blob_id, with_blob_text

LOGITS = [(0, 0, 3.0), (0, 1, 1.0), (0, 2, 3.0), (0, 3, 0.0), (1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)]


@pytest.fixture(scope="module")
def logits(spark):
    return spark.createDataFrame(LOGITS, "row int, token int, logit double")


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["row"], set()).add(r["token"])
    return out


def test_top_k_keeps_ties(logits):
    assert kept(decoding.top_k(logits, 1, "row")) == {0: {0, 2}, 1: {0, 1, 2, 3}}
    assert kept(decoding.top_k(logits, 99, "row")) == {0: {0, 1, 2, 3}, 1: {0, 1, 2, 3}}


def test_top_p(logits):
    assert kept(decoding.top_p(logits, 0.1, "row")) == {0: {0}, 1: {0}}
    assert kept(decoding.top_p(logits, 0.5, "row")) == {0: {0, 2}, 1: {0, 1, 2}}
    assert decoding.top_p(logits, 1.0, "row").count() == 8


def test_greedy_and_softmax(logits):
    assert {r["row"]: r["token"] for r in decoding.greedy(logits, "row").collect()} == {0: 0, 1: 0}
    for r in decoding.softmax(logits, "row").groupBy("row").agg(F.sum("prob").alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    got = decoding.log_softmax(logits, "row").filter("row = 1 and token = 2").first()["logp"]
    assert got == pytest.approx(-math.log(4))
    with pytest.raises(ValueError):
        decoding.softmax(logits, "row", temperature=0)


def test_pairs_move_trailing_space(spark):
    tok = CodepointTokenizer()
    rows = [("ab ", "c"), ("", "c"), ("  ", "c"), ("ab", " c")]
    got = decoding.encode_pairs(spark.createDataFrame(rows, "context string, continuation string"), tok, 2).collect()
    assert [(r["context_ids"], r["continuation_ids"]) for r in got] == [(tok.encode("ab"), tok.encode(" c")), ([2], tok.encode("c")), ([2], tok.encode("  c")), (tok.encode("ab"), tok.encode(" c"))]


def test_left_truncation(spark):
    df = spark.sql("select array(1,2,3,4,5) c, array(9,9) t")
    for limit, want in ((7, [1, 2, 3, 4, 5]), (4, [4, 5]), (3, [5])):
        assert df.select(decoding.left_truncated(F.col("c"), F.col("t"), limit)).first()[0] == want
    with pytest.raises(Exception, match="no room"):
        df.select(decoding.left_truncated(F.col("c"), F.col("t"), 2)).collect()


def test_stops_and_replies(spark):
    df = spark.createDataFrame([("abSTOPcd.e",), ("STOP",), ("x",)], "t string")
    assert [r[0] for r in df.select(cut_at_stops(F.col("t"), ["STOP", "."])).collect()] == ["ab", "", "x"]
    with pytest.raises(ValueError):
        cut_at_stops(F.col("t"), [""])
    shown = spark.createDataFrame([([2], ""), ([5, 2], "hi"), ([2, 2], "")], "i array<int>, t string").select(shown_reply(F.col("i"), 2, F.col("t"))).collect()
    assert [r[0] for r in shown] == ["[EOS]", "hi", ""]


def test_norms_and_rotation(spark):
    df = spark.sql("select array(3d, 4d, 0d, 1d) v, 2d p")
    n = df.select(decoding.rms_norm(F.col("v"), 0.0)).first()[0]
    assert sum(x * x for x in n) / 4 == pytest.approx(1)
    r = df.select(decoding.rotated(F.col("v"), F.col("p"))).first()[0]
    a, b = 2.0, 2.0 * 10_000 ** (-2 / 4)
    assert r == pytest.approx([3 * math.cos(a) - 4 * math.sin(a), 3 * math.sin(a) + 4 * math.cos(a), -math.sin(b), math.cos(b)])
    assert sum(x * x for x in r) == pytest.approx(26)


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 30.0, True), (0, 10.0, False)], "source_id int, loss double, correct boolean")
    row = metrics.token_metrics(rows).first()
    assert (row["loss"], row["token_accuracy"], row["tokens"]) == (20.0, 0.5, 2) and row["perplexity"] == pytest.approx(math.exp(20))
    none = metrics.token_metrics(rows.filter("false")).first()
    assert (none["loss"], none["perplexity"], none["tokens"]) == (0.0, 1.0, 0)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "source_id int, source string")
    got = {r["source"]: r for r in metrics.source_metrics(rows, names).collect()}
    assert got["a"]["tokens"] == 2 and got["b"]["loss"] == 0.0 and got["b"]["perplexity"] == 1.0


def test_masked_loss_counts_shifted_targets(spark):
    df = spark.createDataFrame([([1, 0, 1, 1], [5.0, 1.0, 3.0])], "loss_mask array<int>, loss array<double>")
    row = metrics.masked_loss(df).first()
    assert (row["mean_loss"], row["targets"]) == (2.0, 2)
    assert metrics.masked_loss(df.filter("false")).first()["mean_loss"] is None


def test_logging_best_and_finite(spark):
    steps = spark.createDataFrame([(i, float(i), 1) for i in range(7)], "step long, loss double, tokens long")
    got = {r["logged_step"]: r["mean_loss"] for r in metrics.logged_means(steps, 3).collect()}
    assert got == {0: 0.0, 3: 2.0, 6: 5.0}
    evals = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 1.0), (3, 2.0)], "step int, loss double")
    assert [r["improved"] for r in metrics.best_so_far(evals).orderBy("step").collect()] == [True, False, True, False]
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("-inf")],), ([0.0],)], "v array<double>")
    assert [r[0] for r in df.select(metrics.is_finite(F.col("v"))).collect()] == [False, False, True]


def test_learning_rates(spark):
    df = spark.createDataFrame([(0,), (499,), (10000,)], "s int")
    assert [r[0] for r in df.select(schedules.warmup_constant(F.col("s"), 3e-5, 500)).collect()] == pytest.approx([6e-8, 3e-5, 3e-5])
    got = [r[0] for r in df.select(schedules.warmup_cosine(F.col("s"), 1.0, 1000, 0, 0.1)).collect()]
    assert got[0] == pytest.approx(1.0) and got[2] == pytest.approx(0.1)


def test_blobs(spark):
    store = {"content/a": gzip.compress(b"print('hi')"), "content/b": b"junk", "content/c": gzip.compress(b"x\xffy")}
    assert [fetch_text(store.__getitem__, i) for i in "abcd"] == ["print('hi')", "", "xy", ""]
    ids = spark.createDataFrame([(i, b) for i, b in enumerate(["a", None, "c", "", "b", " "] * 3)], "n int, blob string").coalesce(1)
    got = with_blob_text(ids, "blob", lambda: store.__getitem__, threads=4, batch=2).collect()
    assert [r["text"] for r in got] == ["print('hi')", "", "xy", "", "", ""] * 3
    assert [r[0] for r in ids.limit(6).select(is_blob_id(F.col("blob"))).collect()] == [True, False, True, False, True, True]


def test_configuration(tmp_path):
    good = dict(vocab_size=None, block_size=8, n_layer=1, n_embd=8, n_head=4, n_head_kv=2, intermediate_size=8)
    model = Model(**good)
    for change in ({"vocab_size": 0}, {"n_layer": 0}, {"n_embd": 9}, {"n_head_kv": 3}, {"block_size": -1}, {"rope_theta": 0}, {"rms_norm_eps": 0}):
        with pytest.raises(ValueError):
            Model(**good | change)
    assert model.resolved(CodepointTokenizer()).vocab_size == 256
    with pytest.raises(ValueError):
        Model(**good | {"vocab_size": 5}).resolved(CodepointTokenizer())
    with pytest.raises(ValueError):
        Data("r", "train", "val", {"a": 0.9})
    with pytest.raises(ValueError):
        TuningData("x", "x")
    path = tmp_path / "c.yml"
    path.write_text("model: {vocab_size: 5, block_size: 8, n_layer: 1, n_embd: 8, n_head: 4, n_head_kv: 2, intermediate_size: 8}\ntraining: {batch_size: 1, learning_rate: 0.1, weight_decay: 0, max_steps: 1, warmup_steps: 0, min_learning_rate: 0, max_grad_norm: 1, log_interval: 1, eval_interval: 1, checkpoint_interval: 1}\ntokenizer: {name: t}\ndata: {root: r, train_split: train, validation_split: val, source_weights: {a: 0.5, b: 0.5}}\n")
    got = load(str(path))
    assert isinstance(got, Experiment) and isinstance(got.training, Training) and got.data.source_weights == {"a": 0.5, "b": 0.5}
