"""Registered queries over all rows of small tables, against plain versions."""

import pytest

from lodeworks.plans import queries


def test_tokenize_report_counts_all_documents(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", "x" * (7_000 + i * 13)) for i in range(60)] + [(60, "a", " \n"), (61, "b", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for s in ("a", "b"):
        lengths = [len(t) + 1 for _, x, t in rows if x == s and t and t.strip()]
        made, held = 1, 0
        for n in lengths:
            if held >= queries.CAP:
                made, held = made + 1, 0
            held += n
        assert sum(lengths) > queries.BUDGET
        want[s] = (len(lengths), sum(lengths), made)
    got = queries.QUERIES["tokenize_report"](spark, str(tmp_path)).collect()
    assert {r["source"]: (r["documents"], r["total_tokens"], r["shards"]) for r in got} == want


@pytest.fixture(scope="module")
def gapped(spark, tmp_path_factory):
    """Conversations whose shards (20 ids each) leave planted gaps, and the shards' texts."""
    at = tmp_path_factory.mktemp("gaps")
    there = {"user": [0, 1, 3, 4, 7], "assistant": [1, 2, 4], "system": [5]}
    rows = [(20 * k + c, turn, role, f"turn {turn}. of {role} {c}.") for role, own in there.items() for k in own for turn, c in enumerate((2, 11))]
    rows += [(13 * 20, 1, "user", ""), (14 * 20, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(at / "conversations.parquet"))
    texts = {(role, k): "".join(t for i, _, r, t in rows if r == role and i // 20 == k) for role, own in there.items() for k in own}
    return str(at), texts, {"user": [2, 5, 6], "assistant": [3], "system": []}


def test_source_check_reports_all_shards_and_the_real_gaps(spark, gapped):
    folder, texts, gaps = gapped
    got = {r["source"]: tuple(r)[1:] for r in queries.QUERIES["source_check"](spark, folder).collect()}
    own = {s: [t for (x, _), t in texts.items() if x == s] for s in gaps}
    assert got == {s: (len(t), sum(map(len, t)), sum(x.count(".") for x in t), ",".join(map(str, gaps[s]))) for s, t in own.items()}


def test_missing_shards_are_the_real_gaps(spark, gapped):
    folder, _, gaps = gapped
    got = queries.QUERIES["missing_shards"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((s, k) for s, own in gaps.items() for k in own)


def test_check_messages_name_the_real_gaps(spark, gapped):
    folder, _, gaps = gapped
    got = queries.QUERIES["check_messages"](spark, folder).collect()
    assert sorted(r["message"] for r in got if r["place"] == 1) == sorted(f"{s}: missing shard indices {', '.join(map(str, k))}" for s, k in gaps.items() if k)


def test_left_truncate_splits_the_whole_item(spark, tmp_path):
    texts = ["", "short", "x" * 19, "y" * 20, "".join(chr(33 + i % 90) for i in range(47)), "".join(chr(33 + i * i % 90) for i in range(226))]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for i, t in enumerate(texts):
        ids = [2, *map(ord, t)]
        context = ids[:-20][-28:]
        want[i] = (len(context), sum(context))
    got = {r["item_id"]: (r["n_context"], r["id_sum"]) for r in queries.QUERIES["left_truncate"](spark, str(tmp_path)).collect()}
    assert got == want
