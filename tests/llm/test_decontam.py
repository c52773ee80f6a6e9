import re

import helpers
import pytest

from lodeworks.llm import decontam

ITEMS = [(1, " ".join(f"Passage{i}" for i in range(10, 30))), (2, "fox jumps over the lazy"), (3, "too short"), (4, None), (5, " ".join(f"Passage{i}" for i in range(10, 30))), (6, " ".join(f"passage{i}" for i in range(50, 60)) + " quite other words here")]


def plain(docs, items):
    words = lambda x: [w for w in re.findall(r"[^\W_]+", (x or "").lower())]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    held = {}
    for i, x in docs:
        if i is not None:
            held.setdefault(i, set()).update(shingles(words(x)))
    out = []
    for i, s in held.items():
        for j, x in items:
            t = shingles(words(x))
            if t and len(s & t) / len(t) >= 0.8:
                out.append((i, j, len(t), len(s & t), len(s & t) / len(t)))
    return sorted(out)


@pytest.mark.parametrize("rows", [1_000_000, -1])
@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_against_a_plain_version(spark, table, rows):
    docs = table(spark)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, decontam.contaminated(docs, items, broadcast_rows=rows).collect()))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert got == want and {i for i, *_ in want} >= {0, 9, 10}


@pytest.mark.parametrize("kept", range(10, 21))
def test_threshold_is_exact_and_nothing_near_it_is_lost(spark, kept):
    item = [f"w{i}" for i in range(24)]  # 20 shingles
    text = " ".join(item[: kept + 4]) + " other words " + " ".join(f"z{i}" for i in range(3000))
    docs = helpers.documents(spark, [text])
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontam.contaminated(docs, items).count() == (kept >= 16)


def test_no_documents_or_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminated(helpers.empty(spark), items).count() == 0
    assert decontam.contaminated(helpers.documents(spark), items.filter("false")).count() == 0


def test_a_passage_that_many_items_share_meets_those_that_hit(spark):
    """Three hundred items begin alike; a document holds that beginning, and one item whole."""
    shared = " ".join(f"template{i}" for i in range(12))
    items = [(j, f"{shared} " + " ".join(f"own{j}x{i}" for i in range(12))) for j in range(300)]
    docs = [("a", f"before {shared} after"), ("b", f"in front {items[7][1]} behind"), ("b", items[9][1]), (None, items[3][1]), ("c", "y" * 500_000), ("d", None)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in got) == [("b", 7, 1.0), ("b", 9, 1.0)]
