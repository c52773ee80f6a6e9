"""Chat data: validation, token assembly with loss masks, length filters, batches, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefolded, is_nonblank, stripped
from ..functions.tokenizers import Tokenizer
from .ordered import null_safe_join, with_prefix_sums

# fixed values: role names, and the role that must follow each
ROLE_NAMES = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant"}
NEXT_ROLE = {"system": "user", "user": "assistant", "assistant": "user"}
INVALID, DROPPED, RETAINED = "invalid", "dropped", "retained"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def role_of(raw: Column) -> Column:
    """Canonical role, null if unknown."""
    return F.try_element_at(_literal_map(ROLE_NAMES), casefolded(stripped(raw)))


def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(conv, messages): a conversation's messages in order, as structs of raw role and content."""
    each = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(each)).alias("messages"))


def first_error(messages: str, end: str = "assistant") -> Column:
    """The first rule that a conversation breaks, in words; null if it is valid."""
    if end not in ("assistant", "user"):
        raise ValueError(f"a conversation ends with assistant or user, not {end!r}")
    m = F.col(messages)
    where = F.sequence(F.lit(0), F.size(m) - 1)

    def of_message(i: Column) -> Column:
        x = F.get(m, i)
        named = F.concat(F.lit("turn "), i.cast("string"))
        return (
            F.when(~is_nonblank(x["role"]), F.concat(named, F.lit(": role missing")))
            .when(~is_nonblank(x["content"]), F.concat(named, F.lit(": content missing")))
            .when(role_of(x["role"]).isNull(), F.concat(named, F.lit(": role unknown")))
        )

    roles = F.transform(m, lambda x: role_of(x["role"]))
    wrong = F.filter(where, lambda i: (i > 0) & (F.get(roles, i) != F.try_element_at(_literal_map(NEXT_ROLE), F.get(roles, i - 1))))
    at = F.get(wrong, F.lit(0))
    broken = F.filter(F.transform(where, of_message), lambda e: e.isNotNull())
    return (
        F.when(m.isNull() | (F.size(m) == 0), "no turns")
        .when(F.size(broken) > 0, F.get(broken, F.lit(0)))
        .when(F.get(roles, F.lit(0)) == "assistant", "assistant speaks first")
        .when(F.element_at(roles, -1) != end, f"last turn is not {end}")
        .when(F.size(wrong) > 0, F.concat(F.get(roles, at), F.lit(" after "), F.get(roles, at - 1)))
    )


def _coded(turns: DataFrame, tokenizer: Tokenizer, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """(conv, messages): as ``gather`` gives them, with the ids and mask of each turn.

    Prefix, content and newline of a turn are encoded apart, so masks fall on their borders.  An
    assistant's content, newline and end token are targets; nothing else is.  A turn that cannot be
    encoded has null ids, and its conversation an error.
    """
    if tokenizer.eos_token_id is None:
        raise ValueError("the tokenizer has no end token")
    named = turns.withColumn("_role", role_of(F.col(role)))
    mine = F.col("_role") == "assistant"
    ids = {r: tokenizer.encode(f"{r}: ") for r in set(ROLE_NAMES.values())}
    prefix = F.coalesce(*[F.when(F.col("_role") == r, F.array(*map(F.lit, ids[r]))) for r in sorted(ids)])
    body = F.concat(tokenizer.ids(F.col(content)), F.array(*map(F.lit, tokenizer.encode("\n"))))
    end = F.when(mine, F.array(F.lit(int(tokenizer.eos_token_id)))).otherwise(F.array().cast("array<int>"))
    made = named.withColumn("_p", prefix).withColumn("_b", F.concat(body, end))
    mask = F.concat(F.array_repeat(F.lit(0), F.size("_p")), F.array_repeat(mine.cast("int"), F.size("_b")))
    each = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"), F.concat("_p", "_b").alias("ids"), mask.alias("mask"), F.col("_role").alias("known"))
    return made.groupBy(conv).agg(F.array_sort(F.collect_list(each)).alias("messages"))


def _joined(field: str, start: list[int]) -> Column:
    return F.concat(F.array(*map(F.lit, start)).cast("array<int>"), F.flatten(F.transform("messages", lambda x: x[field])))


def _tokens(tokenizer: Tokenizer, bos: bool = True) -> tuple[Column, Column]:
    """(token_ids, loss_mask) of a coded conversation."""
    first = [tokenizer.bos_token_id] if bos and tokenizer.bos_token_id is not None else []
    return _joined("ids", first), _joined("mask", [0] * len(first))


def assembled(turns: DataFrame, tokenizer: Tokenizer, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", bos: bool = True) -> DataFrame:
    """(conv, token_ids, loss_mask, roles) of valid conversations' turns."""
    ids, mask = _tokens(tokenizer, bos)
    got = _coded(turns, tokenizer, conv, turn, role, content)
    return got.select(conv, ids.alias("token_ids"), mask.alias("loss_mask"), F.transform("messages", lambda x: x["known"]).alias("roles"))


def generation_prompts(turns: DataFrame, tokenizer: Tokenizer, conv: str = "conv_id", **names) -> DataFrame:
    """(conv, token_ids) of valid prompts, which end with a user turn and the assistant's prefix."""
    ready = assembled(turns, tokenizer, conv, **names)
    return ready.select(conv, F.concat("token_ids", F.array(*map(F.lit, tokenizer.encode("assistant: ")))).alias("token_ids"))


def mask_total(mask: str = "loss_mask") -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def classify(turns: DataFrame, tokenizer: Tokenizer, max_length: int, conv: str = "conv_id", max_examples: int | None = None) -> DataFrame:
    """Per scanned conversation: error, status, token_ids, loss_mask, n_tokens, assistant_tokens.

    Invalid conversations are told apart before long ones.  ``max_examples``: the first so many
    conversations in order are scanned, invalid ones too.
    """
    if max_length <= 0 or (max_examples is not None and max_examples <= 0):
        raise ValueError("lengths and counts must be positive")
    if max_examples is not None:
        turns = null_safe_join(turns, turns.select(conv).distinct().orderBy(conv).limit(max_examples), [conv], "left_semi")
    # one pass: turns are encoded where they are, and come together once
    coded = _coded(turns, tokenizer, conv, "turn", "role", "text").withColumn("error", first_error("messages"))
    ids, mask = (F.when(F.col("error").isNull(), x) for x in _tokens(tokenizer))
    made = coded.select(conv, "error", ids.alias("token_ids"), mask.alias("loss_mask"))
    status = F.when(F.col("error").isNotNull(), INVALID).when(F.size("token_ids") > max_length, DROPPED).otherwise(RETAINED)
    return made.select(conv, "error", status.alias("status"), "token_ids", "loss_mask", F.size("token_ids").cast("long").alias("n_tokens"), mask_total().cast("long").alias("assistant_tokens"))


def offsets(examples: DataFrame, conv: str = "conv_id", width: int = 100_000) -> DataFrame:
    """Retained examples with example_index and the start and end of their tokens in one array."""
    kept = examples.filter(F.col("status") == RETAINED)
    one = kept.withColumn("_all", F.lit(0))
    placed = with_prefix_sums(one, {"start": F.col("n_tokens"), "example_index": F.lit(1)}, [conv], ["_all"], width=width).drop("_all")
    return placed.withColumn("end", F.col("start") + F.col("n_tokens"))


def audit(examples: DataFrame) -> DataFrame:
    """Counts by status, and lengths of the retained; means are null if none is."""
    kept = F.col("status") == RETAINED
    n, a = (F.when(kept, F.col(c)) for c in ("n_tokens", "assistant_tokens"))
    return examples.agg(
        F.count("*").alias("scanned"),
        *[F.count_if(F.col("status") == s).alias(s) for s in (RETAINED, DROPPED, INVALID)],
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum(a), F.lit(0)).cast("long").alias("total_assistant_tokens"),
        F.avg(n).alias("mean_tokens"),
        F.max(n).alias("max_tokens"),
        F.avg(a).alias("mean_assistant_tokens"),
        F.max(a).alias("max_assistant_tokens"),
    )


def collate(examples: DataFrame, batch_size: int, pad_id: int, index: str = "example_index") -> DataFrame:
    """Right-padded batches: batch_id, width, token_ids, loss_mask; a batch without any target after
    its first token is an error."""
    own = Window.partitionBy("batch_id")
    made = examples.withColumn("batch_id", F.floor(F.col(index) / F.lit(batch_size)).cast("long"))
    made = made.withColumn("width", F.max(F.size("token_ids")).over(own))
    targets = F.sum(mask_total("loss_mask") - F.get("loss_mask", F.lit(0))).over(own)
    made = made.withColumn("_targets", targets)

    def padded(name: str, fill: int) -> Column:
        return F.concat(name, F.array_repeat(F.lit(fill), F.col("width") - F.size(name)))

    checked = F.when(F.col("_targets") > 0, F.col("width")).otherwise(F.raise_error(F.lit("a batch holds no supervised target")).cast("int"))
    return made.select(*[c for c in examples.columns if c not in ("token_ids", "loss_mask")], "batch_id", checked.alias("width"), padded("token_ids", pad_id).alias("token_ids"), padded("loss_mask", 0).alias("loss_mask"))
