import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringStartsWith

from lodeworks import pipelines
from lodeworks.functions import hashing
from lodeworks.functions.text import casefolded, is_nonblank, stripped
from lodeworks.functions.tokenizers import ByteTokenizer, CodepointTokenizer, FileTokenizer, check_narrow, decoded, narrowed, with_end
from lodeworks.operators import shards
from lodeworks.sources.tokenfiles import OPEN_BYTES, _Reader, list_files, read_ends, read_outline, read_shards, write_shards


def put(folder, name, ids):
    os.makedirs(folder, exist_ok=True)
    np.asarray(ids, np.uint16).tofile(os.path.join(folder, name))


def test_valid_shard(spark, tmp_path):
    put(tmp_path / "s", "web_0000.bin", [10, 2, 11, 2])
    got = pipelines.check(spark, str(tmp_path / "s"), 32000, 2)
    assert got["errors"] == [] and got["total_tokens"] == 4 and got["total_eos_tokens"] == 2 and got["shards"][0]["ends_with_eos"]
    assert got["text"].endswith("RESULT: PASSED")


def test_id_out_of_range(spark, tmp_path):
    put(tmp_path / "s", "web_0000.bin", [1, 2, 32000])
    got = pipelines.check(spark, str(tmp_path / "s"), 32000, 2)
    assert "vocabulary size" in got["errors"][0] and got["text"].endswith("RESULT: FAILED")


def test_missing_index_empty_odd_and_unnamed_files(spark, tmp_path):
    root = tmp_path / "s"
    put(root, "web_0000.bin", [1, 2])
    put(root, "web_0002.bin", [3, 2])
    put(root, "web_0003.bin", [])
    put(root / "other", "part.bin", [5, 5])
    (root / "odd_0000.bin").write_bytes(b"abc")
    got = pipelines.check(spark, str(root), 32000, 2)
    text = " | ".join(got["errors"])
    assert "missing shard indices 1" in text and "empty file" in text and "two bytes" in text
    assert any("no end token" in w for w in got["warnings"]) and any("no name has" in w for w in got["warnings"])
    assert got["sources"]["other"]["tokens"] == 2 and got["sources"]["web"]["shards"] == 3


def test_nothing_there(spark, tmp_path):
    assert "total_tokens" not in pipelines.check(spark, str(tmp_path / "none"), 10, 2)
    os.makedirs(tmp_path / "bare")
    assert pipelines.check(spark, str(tmp_path / "bare"), 10, 2)["errors"]


def test_token_files_round_trip_byte_for_byte(spark, tmp_path):
    rows = [(None, "a", 0, 0, [1, 2, 3]), (None, "a", 0, 3, [65535, 0]), (None, "a", 1, 0, [7]), ("val", "b", 12345, 0, [9, 9])]
    df = spark.createDataFrame(rows, "split string, source string, shard_index long, position long, tokens array<int>")
    write_shards(df, str(tmp_path / "o"))
    assert (tmp_path / "o/a/a_0000.bin").read_bytes() == np.array([1, 2, 3, 65535, 0], np.uint16).tobytes()
    assert (tmp_path / "o/val/b/b_12345.bin").exists() and not list((tmp_path / "o").rglob("*.tmp"))
    got = read_shards(spark, str(tmp_path / "o"), partition_bytes=4, batch_tokens=1).collect()
    ids = {r["path"].rsplit("/", 1)[1]: [] for r in got}
    for r in sorted(got, key=lambda r: (r["path"], r["position"])):
        ids[r["path"].rsplit("/", 1)[1]] += r["tokens"]
    assert ids == {"a_0000.bin": [1, 2, 3, 65535, 0], "a_0001.bin": [7], "b_12345.bin": [9, 9]}
    with pytest.raises(Exception, match="holds token files"):
        write_shards(df, str(tmp_path / "o"))


def test_small_files_share_partitions_and_large_ones_are_split(tmp_path):
    root = tmp_path / "s"
    for i in range(300):
        put(root / f"s{i % 3}", f"s{i % 3}_{i // 3:04d}.bin", [i] * (i % 7 + 1))
    put(root / "big", "big_0000.bin", np.zeros(20_000_000))
    parts = _Reader({"path": str(root), "parallelism": "8"}).partitions()
    assert len(parts) <= 45 and sorted({r[0] for p in parts for r in p.runs}) == sorted(p for p, _ in list_files(str(root)))
    seen = sorted(r[2:] for p in parts for r in p.runs if "big" in r[0])
    assert seen[0][0] == 0 and seen[-1][1] == 20_000_000 and all(a[1] == b[0] for a, b in zip(seen, seen[1:])) and len(seen) > 1
    assert all(a % 65_536 == 0 for a, _ in seen)
    few = _Reader({"path": str(root), "parallelism": "1"}).partitions()
    assert len(few) == 1 and len(parts) < 12
    bounded = _Reader({"path": str(root), "parallelism": "1", "partition_bytes": "3000000"}).partitions()
    assert all(sum(2 * (e - a) + OPEN_BYTES for _, _, a, e in p.runs) <= 3_000_000 + 2 * OPEN_BYTES for p in bounded)


def test_filters_reach_the_files(spark, tmp_path):
    root = tmp_path / "s"
    for s in ("a", "b", "c"):
        for i in range(3):
            put(root / s, f"{s}_{i:04d}.bin", range(10))
    (root / "c" / "odd_0000.bin").write_bytes(b"abc")  # an error to anyone who looks at it
    reader = _Reader({"path": str(root)})
    wanted = [StringStartsWith(("path",), f"{root}/b/")]
    assert list(reader.pushFilters(wanted)) == wanted
    assert sorted(r[0] for p in reader.partitions() for r in p.runs) == [f"{root}/b/b_{i:04d}.bin" for i in range(3)]
    df = read_shards(spark, str(root), batch_tokens=4)
    with pytest.raises(Exception, match="odd size"):
        df.count()
    got = df.filter(F.col("path").startswith(f"{root}/b/") & (F.col("position") >= 4)).select("path", "position", "tokens").collect()
    assert sorted((r["path"][-8:-4], r["position"], tuple(r["tokens"])) for r in got) == [(f"000{i}", a, tuple(range(a, min(a + 4, 10)))) for i in range(3) for a in (4, 8)]
    one = df.filter(F.col("path").isin(f"{root}/a/a_0001.bin", "none") & (F.col("position") < 4)).collect()
    assert len(one) == 1 and one[0]["tokens"] == [0, 1, 2, 3]


def test_outlines_say_what_the_tokens_say(spark, tmp_path):
    put(tmp_path / "s", "a_0000.bin", [5, 2, 6, 2, 2, 9])
    put(tmp_path / "s", "a_0001.bin", [2])
    put(tmp_path / "s", "b_0000.bin", [7])
    rows = read_outline(spark, str(tmp_path / "s"), 2, batch_tokens=4).orderBy("file_order", "position").collect()
    assert [(r["file_order"], r["position"], r["n_tokens"], r["low"], r["high"], r["ends"]) for r in rows] == [(0, 0, 4, 2, 6, [2, 4]), (0, 4, 2, 2, 9, [1]), (1, 0, 1, 2, 2, [1]), (2, 0, 1, 7, 7, [])]
    cut = read_ends(spark, str(tmp_path / "s"), 2, batch_tokens=4).orderBy("file_order", "position").collect()
    assert [(r["tokens"], r["ends"]) for r in cut] == [([5, 2, 6, 2], [2, 4]), ([2, 9], [1]), ([2], [1]), ([7], [])]
    plain = shards.scan(read_shards(spark, str(tmp_path / "s")), ["path"], "tokens", "position", 2, 8)
    outlined = shards.scan_outline(read_outline(spark, str(tmp_path / "s"), 2), ["path"], 8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, outlined.collect()))


def test_split_reads_the_files_twice(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "s", "x" * (i % 9 + 1)) for i in range(30)], "doc_id long, source string, text string")
    pipelines.tokenize(docs, ByteTokenizer(), str(tmp_path / "raw"), shard_tokens=40)
    reads = []
    for name in ("read_outline", "read_ends", "read_shards"):
        real = getattr(pipelines, name)
        monkeypatch.setattr(pipelines, name, lambda *a, _n=name, _f=real, **k: reads.append(_n) or _f(*a, **k))
    pipelines.split(spark, str(tmp_path / "raw"), str(tmp_path / "parts"), 2, shard_tokens=40)
    assert reads == ["read_outline", "read_ends"]


@pytest.mark.parametrize("ids", [[1, 1, 2], [None, None, 3], [None, 1, 1, 1, None, 2]])
def test_tokenize_rows_with_one_id(spark, tmp_path, ids):
    texts = [f"text {min(i, 3)}" for i in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, ["s"] * len(ids), texts)) + [(5, None, "no source's"), (None, "s", " ")], "doc_id long, source string, text string").coalesce(1)
    got = pipelines.tokenize(docs, ByteTokenizer(), str(tmp_path / "o"), shard_tokens=20)
    assert got["documents"] == len(ids) + 1 and got["skipped"] == 1
    files = sorted((tmp_path / "o" / "s").glob("*.bin"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    assert np.concatenate([np.fromfile(f, np.uint16) for f in files]).tolist() == [x for i in order for x in [*ByteTokenizer().encode(texts[i]), 2]]


def test_ids_beyond_sixteen_bits_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 0, 0, [70000])], "split string, source string, shard_index long, position long, tokens array<int>")
    with pytest.raises(Exception, match="16 bits"):
        write_shards(df, str(tmp_path / "o"))


def test_narrowed_ids_are_the_bytes_of_a_shard(spark):
    ids = [[5, 0, 65535], [], None, [9] * 70_000, [1]]
    made = spark.createDataFrame(list(enumerate(ids)), "i int, ids array<int>").coalesce(1).select("i", narrowed(F.col("ids"), 2).alias("b"))
    assert dict(made.collect()) == {i: None if x is None else np.array([*x, 2], np.uint16).tobytes() for i, x in enumerate(ids)}
    wide = spark.createDataFrame([([65536],)], "ids array<int>").select(narrowed(F.col("ids"), 2))
    with pytest.raises(Exception, match="16 bits"):
        wide.collect()


@pytest.mark.parametrize("tokenizer", [ByteTokenizer(), CodepointTokenizer()])
def test_tokens_are_stored_in_two_bytes_each(spark, tmp_path, monkeypatch, tokenizer):
    held, real = {}, pipelines.stored
    monkeypatch.setattr(pipelines, "stored", lambda df, name: held.setdefault(name, real(df, name)))
    texts = ["abc", "d", "é" * 9]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    pipelines.tokenize(docs, tokenizer, str(tmp_path / "o"), shard_tokens=1000)
    want = [[*tokenizer.encode(t), 2] for t in texts]
    assert [bytes(r["tokens"]) for r in held["tokens"].orderBy("doc_id").collect()] == [np.array(x, np.uint16).tobytes() for x in want]
    assert [r["n_tokens"] for r in held["tokens"].orderBy("doc_id").collect()] == [len(x) for x in want]
    assert np.fromfile(tmp_path / "o/s/s_0000.bin", np.uint16).tolist() == sum(want, [])


def test_tokenize_check_split(spark, tmp_path):
    texts = [f"document {i} " + "x" * (i * 5 % 40) for i in range(60)] + ["", None, " \t", "　", "\x1c"]
    docs = spark.createDataFrame([(i, "web" if i % 3 else "code", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = pipelines.tokenize(docs, ByteTokenizer(), str(tmp_path / "raw"), shard_tokens=200)
    n = sum(len(t.encode()) + 1 for t in texts[:60])
    assert got["documents"] == 60 and got["skipped"] == 5 and got["total_tokens"] == n
    found = pipelines.check(spark, str(tmp_path / "raw"), 259, 2)
    assert found["errors"] == [] and found["total_tokens"] == n and found["files_found"] == got["shards"]
    done = pipelines.split(spark, str(tmp_path / "raw"), str(tmp_path / "parts"), 2, seed=42, fraction=0.3, shard_tokens=150)
    for source in ("web", "code"):
        own = [t for i, t in enumerate(texts[:60]) if (i % 3 > 0) == (source == "web")]
        val = [int.from_bytes(hashlib.blake2b(f"42:{source}:{k}".encode(), digest_size=8).digest(), "big") / 2**64 < 0.3 for k in range(len(own))]
        for name, want in (("val", True), ("train", False)):
            files = sorted((tmp_path / "parts" / name / source).glob("*.bin"))
            ids = np.concatenate([np.fromfile(f, np.uint16) for f in files])
            assert ids.tolist() == [x for t, v in zip(own, val) if v == want for x in [*ByteTokenizer().encode(t), 2]]
            assert all(f.stat().st_size // 2 <= 150 for f in files)
        assert done["sources"][source]["val_documents"] == sum(val)


def test_tokenize_stops_at_the_budget(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s", " " if i == 1 or i == 8 else "abc") for i in range(10)], "doc_id long, source string, text string")
    got = pipelines.tokenize(docs, ByteTokenizer(), str(tmp_path / "o"), shard_tokens=8, max_tokens=13)
    assert got == {"documents": 4, "skipped": 1, "total_tokens": 16, "shards": 2}


def test_split_refuses_an_unfinished_document(spark, tmp_path):
    put(tmp_path / "s", "a_0000.bin", [5, 2, 6])
    put(tmp_path / "s", "a_0001.bin", [7, 2, 9])
    with pytest.raises(Exception, match="incomplete"):
        pipelines.split(spark, str(tmp_path / "s"), str(tmp_path / "o"), 2)


def test_golden_hashes(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), hashing.blake2b_share(F.lit("python-edu"), F.col("id"), 42).alias("x"))
    rows = df.collect()
    assert rows[0]["x"] == pytest.approx(0.9575016162207062, abs=1e-15)
    assert [r["i"] for r in rows if r["x"] < 0.01] == [81, 233, 428, 469, 515, 652, 730, 764]
    assert hashing.stable_seed("stream", 42, "a") == int.from_bytes(hashlib.blake2b(b"stream:42:a", digest_size=8).digest(), "big")


def test_blank_text_and_case_folding(spark):
    blanks, inks = [None, "", "   ", "\t\n", " ", "　", "\x1c"], ["a", "​", " x "]
    rows = spark.createDataFrame([(t,) for t in blanks + inks], "t string").select(is_nonblank(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in rows] == [False] * 7 + [True] * 3
    got = spark.createDataFrame([(" Human\x1c",), ("aßiſtant",)], "t string").select(casefolded(stripped(F.col("t"))).alias("c")).collect()
    assert [r["c"] for r in got] == ["human", "assistant"]


@pytest.mark.parametrize("tok", [ByteTokenizer(), CodepointTokenizer()])
def test_tokenizers(spark, tok):
    texts = ["", "abc", "é漢\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tok.ids(F.col("t")).alias("i"), tok.length(F.col("t")).alias("n")).collect()
    assert [r["i"] for r in rows] == [tok.encode(t) for t in texts] and [r["n"] for r in rows] == [len(tok.encode(t)) for t in texts]
    check_narrow(tok)
    assert ByteTokenizer().decode(ByteTokenizer().encode("é漢")) == "é漢"


def test_shard_names(spark):
    paths = ["r/a_1_0002.bin", "r/foo.bin", "r/x/y/foo.bin", "r/t/a_10000.bin", "r/a_b.bin"]
    s, i = shards.name_parts(F.col("p"), "r")
    t, _ = shards.name_parts(F.col("p"))
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(s.alias("s"), i.alias("i"), t.alias("t")).collect()
    assert [tuple(r) for r in got] == [("a_1", 2, "a_1"), ("<root>", None, "r"), ("x/y", None, "y"), ("a", 10000, "a"), ("<root>", None, "r")]


def test_decoded_columns(spark):
    texts = ["abc", "", "é漢", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(decoded(ByteTokenizer(), with_end(ByteTokenizer().ids(F.col("t")), ByteTokenizer())).alias("d")).collect()
    assert [r["d"] for r in got] == texts


def test_tokenizer_files(spark):
    public = pytest.importorskip("public_tokenizers")
    tok = FileTokenizer(public.path("byte_bpe_50k.json"), eos_token_id=50256)
    check_narrow(tok)
    texts = ["Hello world", "", "naïve"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tok.ids(F.col("t")).alias("i"), tok.length(F.col("t")).alias("n")).collect()
    assert [r["i"] for r in got] == [tok.encode(t) for t in texts] and [r["n"] for r in got] == [len(tok.encode(t)) for t in texts]
    assert [tok.decode(tok.encode(t)) for t in texts] == texts
