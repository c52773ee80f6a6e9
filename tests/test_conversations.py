import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions.tokenizers import CodepointTokenizer
from lodeworks.operators import conversations as chat
from lodeworks.sources import artifacts

TOK = CodepointTokenizer()
SCHEMA = "conv_id long, turn long, role string, text string"


def turns(spark, *convs):
    return spark.createDataFrame([(c, i, r, t) for c, own in enumerate(convs) for i, (r, t) in enumerate(own)], SCHEMA)


@pytest.mark.parametrize("own,end,want", [
    ([("human", "q"), ("gpt", "a")], "assistant", None),
    ([(" Human ", "q"), ("aßiſtant", "a")], "assistant", None),
    ([("system", "s"), ("user", "q"), ("bot", "a")], "assistant", None),
    ([("assistant", "a")], "assistant", "assistant speaks first"),
    ([("user", "a"), ("user", "b")], "assistant", "last turn is not assistant"),
    ([("user", "a"), ("user", "b"), ("assistant", "c")], "assistant", "user after user"),
    ([("user", "a"), ("system", "b"), ("assistant", "c")], "assistant", "system after user"),
    ([("user", "a")], "assistant", "last turn is not assistant"),
    ([("user", "a")], "user", None),
    ([("user", "a"), ("assistant", "b")], "user", "last turn is not user"),
    ([("user", "a"), ("tool", "b"), (None, "c")], "assistant", "turn 1: role unknown"),
    ([("user", " 　"), ("tool", "b")], "assistant", "turn 0: content missing"),
    ([(" ", "x"), ("assistant", "b")], "assistant", "turn 0: role missing"),
    ([("user", None), ("assistant", "b")], "assistant", "turn 0: content missing"),
])
def test_first_broken_rule(spark, own, end, want):
    got = chat.gather(turns(spark, own)).select(chat.first_error("messages", end).alias("e")).first()
    assert got["e"] == want


def test_no_messages(spark):
    df = spark.sql("select cast(array() as array<struct<turn:bigint,role:string,content:string>>) m union all select null")
    assert {r[0] for r in df.select(chat.first_error("m")).collect()} == {"no turns"}
    with pytest.raises(ValueError):
        chat.first_error("m", "system")


def plain(own):
    ids, mask = [1], [0]
    for role, text in own:
        a = role == "assistant"
        ids += TOK.encode(f"{role}: ") + TOK.encode(text + "\n") + [2] * a
        mask += [0] * (len(role) + 2) + [int(a)] * (len(text) + 1 + a)
    return ids, mask


CHATS = [[("system", "be brief"), ("user", "2+2?"), ("assistant", "4")], [("user", "one"), ("assistant", "first"), ("user", "two"), ("assistant", " second ")]]


def test_assembly(spark):
    got = chat.assembled(turns(spark, *CHATS), TOK).orderBy("conv_id").collect()
    for r, own in zip(got, CHATS):
        assert (r["token_ids"], r["loss_mask"]) == plain(own) and r["roles"] == [role for role, _ in own]
    assert sum(got[0]["loss_mask"]) == 3 and sum(got[1]["loss_mask"]) == 7 + 10


def test_generation_prompt(spark):
    got = chat.generation_prompts(turns(spark, [("user", "Hello")]), TOK).first()["token_ids"]
    assert got[0] == 1 and TOK.decode(got[1:]) == "user: Hello\nassistant: "


def test_classes_offsets_audit_and_batches(spark):
    df = turns(spark, *CHATS, [("user", "x")], [("user", "q"), ("assistant", "y" * 100)])
    ids = [plain(c)[0] for c in CHATS]
    made = chat.classify(df, TOK, len(ids[1])).persist()
    assert [r["status"] for r in made.orderBy("conv_id").collect()] == ["retained", "retained", "invalid", "dropped"]
    assert [r["start"] for r in chat.offsets(made).orderBy("conv_id").collect()] == [0, len(ids[0])]
    row = chat.audit(made).first()
    assert (row["scanned"], row["retained"], row["dropped"], row["invalid"]) == (4, 2, 1, 1) and row["max_tokens"] == len(ids[1])
    assert chat.audit(made.filter("false")).first()["mean_tokens"] is None
    assert chat.classify(df, TOK, 10_000, max_examples=3).count() == 3
    got = chat.collate(chat.offsets(made), 2, 2).orderBy("conv_id").collect()
    pad = len(ids[1]) - len(ids[0])
    assert got[0]["token_ids"] == ids[0] + [2] * pad and got[0]["loss_mask"][-pad:] == [0] * pad
    with pytest.raises(Exception, match="no supervised"):
        chat.collate(spark.createDataFrame([(0, [1], [0])], "example_index long, token_ids array<int>, loss_mask array<int>"), 2, 2).collect()


def test_artifacts(spark, tmp_path):
    made = chat.classify(turns(spark, *CHATS, [("user", "x")]), TOK, 1000).persist()
    at = str(tmp_path / "sft")
    artifacts.export(made, at, tokenizer="points", max_length=1000)
    got = artifacts.read_export(spark, at).orderBy("example_index").collect()
    assert [(r["token_ids"], r["loss_mask"]) for r in got] == [plain(c) for c in CHATS]
    assert (tmp_path / "sft/tokens.bin").read_bytes() == np.concatenate([np.array(plain(c)[0], "<u2") for c in CHATS]).tobytes()
    assert np.load(tmp_path / "sft/offsets.npy").tolist() == np.cumsum([0, *(len(plain(c)[0]) for c in CHATS)]).tolist()
    assert sorted(p.name for p in (tmp_path / "sft").iterdir()) == ["loss_mask.bin", "metadata.json", "offsets.npy", "tokens.bin"]
    with pytest.raises(FileExistsError):
        artifacts.export(made, at)
    meta = artifacts.metadata(made, tokenizer="points", max_length=1000)
    artifacts.check_fits(meta, "points", 1000)
    for wrong in ({"tokenizer": "other"}, {"formatter": "x"}, {"max_length": 2000}, {"assistant_tokens": 0}):
        with pytest.raises(ValueError):
            artifacts.check_fits(meta | wrong, "points", 1000)
    artifacts.write_table(made, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/examples")).count() == 2
    (tmp_path / "sft/loss_mask.bin").write_bytes(b"\0")
    with pytest.raises(ValueError):
        artifacts.read_export(spark, at)


def test_flat_files_from_many_tasks(spark, tmp_path):
    """Scattered examples, empty ones and none at all; written twice they are refused, wide ids too."""
    rows = [(i, "retained", [i % 7 + k for k in range(i * 5 % 11)], [k % 2 for k in range(i * 5 % 11)]) for i in range(200)]
    schema = "conv_id long, status string, token_ids array<int>, loss_mask array<int>"

    def frame(rows):
        df = spark.createDataFrame(rows, schema).repartition(7)
        return df.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("assistant_tokens", chat.mask_total().cast("long"))

    at = str(tmp_path / "a")
    artifacts.export(frame(rows), at)
    for options in ({}, {"range_tokens": 50}):
        got = artifacts.read_export(spark, at, **options)
        assert [(r["token_ids"], r["loss_mask"]) for r in got.orderBy("example_index").collect()] == [r[2:] for r in rows]
    assert artifacts.read_export(spark, at, range_tokens=50).rdd.getNumPartitions() > 5
    artifacts.export(frame(rows).filter("false"), str(tmp_path / "none"))
    assert artifacts.read_export(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="16 bits"):
        artifacts.export(frame([(0, "retained", [70_000], [0])]), str(tmp_path / "wide"))
    assert not [p for p in (tmp_path / "wide").rglob("*") if p.is_file()]
