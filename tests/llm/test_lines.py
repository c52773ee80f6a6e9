import collections
import hashlib
import re

import helpers
import numpy as np
import pytest

from lodeworks.llm import linededup


def plain(rows, least=20, min_docs=3):
    held = collections.defaultdict(list)
    key = lambda line: helpers.lower_az(line.strip(helpers.SPACE))
    for i, x in rows:
        for k in {key(line) for line in (x or "").split("\n")}:
            if len(k) >= least:
                held[k].append(i)
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        keeper = lambda k: max((j for j in held[k] if j is not None), default=None)
        kept = [n for n in lines if not (len(key(n)) >= least and len(held[key(n)]) >= min_docs and keeper(key(n)) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_against_a_plain_version(spark, table, broadcast_bytes):
    docs = table(spark)
    got = linededup.dedup_lines(docs, broadcast_bytes=broadcast_bytes).collect()
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert any(n for *_, n in want)
    digests = linededup.dedup_lines(docs, digest=True, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(r["kept_sha256"] for r in digests) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in want)


@pytest.mark.parametrize("hot_times", [1, 2, 256])
@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_filters_beyond_the_broadcast_bound_stay_with_their_ranges(spark, table, hot_times, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_TIMES", hot_times)
    docs = table(spark).repartition(3)
    far = linededup.dedup_lines(docs, max_bits=0).collect()
    assert sorted(map(tuple, far), key=str) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    _, suspects = linededup.repeated_lines(docs, max_bits=0, hot_times=hot_times)
    lines = collections.Counter(k for r in docs.collect() for k in {helpers.lower_az(x.strip(helpers.SPACE)) for x in (r["text"] or "").split("\n")} if len(k) >= 20)
    found = {bytes(r["key"]).decode() for r in suspects.collect()}
    assert found >= {k for k, n in lines.items() if n > 1}
    if hot_times > 1:
        assert len(found - {k for k, n in lines.items() if n > 1}) <= 2


def test_ranges_follow_the_text():
    assert linededup.range_bits_for(0) == linededup.range_bits_for(10**9) == 10
    for size in (10**13, 10**14, 10**15):
        assert linededup.RANGE_LINES / 2 <= size / 21 / 2 ** linededup.range_bits_for(size) <= linededup.RANGE_LINES


@pytest.mark.parametrize("max_bits", [0, linededup.MAX_BITS])
def test_many_lines_long_lines_and_string_ids(spark, max_bits):
    long = "q" * 2_000_000
    rows = [(f"d{i}", "\n".join(f"line number {j} of the common block" for j in range(i, i + 40)) + f"\n{long if i % 9 == 0 else 'short'}") for i in range(60)] + [(None, long), ("d3", long)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = linededup.dedup_lines(docs, max_bits=max_bits, digest=True).collect()
    want = [(i, hashlib.sha256(t.encode()).hexdigest(), n, d) for i, t, n, d in plain(rows)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_bloom_pair_has_no_false_negative():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    pair = linededup.BloomPair(1 << 14)
    pair.add(h[:3000])
    pair.add(np.concatenate([h[2000:], h[3500:]]))
    at = linededup._places(h, pair.bits)
    assert pair.twice[at].all(axis=1)[2000:3000].all() and pair.twice[at].all(axis=1)[3500:].all()
    assert pair.twice[at].all(axis=1)[:2000].mean() < 0.5


def test_code_points_count(spark):
    texts = ["ééééééééééééééééééé", "éééééééééééééééééééé"] * 3  # 19 and 20 of them
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(helpers.documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_no_documents(spark):
    assert linededup.dedup_lines(helpers.empty(spark)).count() == 0


def moved(df):
    """The columns of every exchange of the plan."""
    told = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", told)


@pytest.mark.parametrize("max_bits", [0, linededup.MAX_BITS])
def test_beyond_the_bounds_lists_move_and_not_the_text(spark, max_bits, monkeypatch):
    """Rows are bucketed once; the joins with lists exchange the lists alone.  Null and repeated ids have lists
    of their own for each row."""
    joined = []
    pick, lists = linededup._suspect_lines, linededup._Lines.with_lists
    monkeypatch.setattr(linededup, "_suspect_lines", lambda rows, *more: joined.append(rows) or pick(rows, *more))
    monkeypatch.setattr(linededup._Lines, "with_lists", lambda self: joined.append(lists(self)) or joined[-1])
    rows = [(None if i % 2 else i % 7, "\n".join(f"a line of the text with number {j % 90}" for j in range(i, i + 30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = linededup.dedup_lines(docs, max_bits=max_bits, broadcast_bytes=-1)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
        met = [x for x in joined if {"maybe", "gone"} & set(x.columns)]
        assert len(met) == (2 if max_bits == 0 else 1)
        for x in met:
            assert moved(x) and not any("text#" in columns for columns in moved(x))
        most = max(len(r["gone"] or ()) for r in met[-1].collect())
        assert most <= 30  # a row's own lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("max_bits", [0, linededup.MAX_BITS])
def test_columns_whose_names_clash_are_kept_beyond_the_bounds(spark, max_bits):
    rows = [(i, "the same line is in every document", f"k{i}", i * 2, "t") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, k string, id long, text string")
    got = linededup.dedup_lines(docs, text_col="body", keep=["k", "id", "text"], max_bits=max_bits, broadcast_bytes=-1)
    assert got.columns == ["k", "id", "text", "kept_text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(f"k{i}", i * 2, "t", rows[0][1] if i == 4 else "", 1, int(i < 4)) for i in range(5)]
