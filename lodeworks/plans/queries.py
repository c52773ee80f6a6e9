"""Registered queries for the reference's own operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import blake2b_share, md5_share, split_name
from ..functions.text import cut_at_stops, is_nonblank
from ..functions.tokenizers import ByteTokenizer, CodepointTokenizer
from ..operators import conversations as chat
from ..operators import decoding, documents, metrics, mixture, schedules, shards, windows
from ..operators.ordered import with_prefix_sum, within_budget
from ..pipelines import numbered
from ..session import shared_dir
from ..streaming import ingest

BYTES, POINTS = ByteTokenizer(), CodepointTokenizer()
WEIGHTS = {"web": 0.625, "books": 0.25, "code": 0.125}
SEED, FRACTION, CAP, BUDGET, BLOCK = 42, 0.05, 20_000, 100_000, 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank documents with the length of their byte tokens and the end token."""
    docs = _table(spark, sf_dir, "documents").filter(is_nonblank(F.col("text")))
    return docs.select("doc_id", "source", (BYTES.length(F.col("text")) + 1).cast("long").alias("n_tokens"))


def _turn_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as code-point tokens with their place: source = role, shard = conversation over 20."""
    turns = _table(spark, sf_dir, "conversations").filter(is_nonblank(F.col("text")))
    made = turns.select(F.col("role").alias("source"), F.floor(F.col("conv_id") / 20).cast("long").alias("shard_index"), "conv_id", "turn", POINTS.ids(F.col("text")).alias("tokens"))
    return with_prefix_sum(made, F.size("tokens"), "start", ["conv_id", "turn"], ["source", "shard_index"], F.col("conv_id"))


def _shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pieces(spark, sf_dir).groupBy("source", "shard_index").agg(F.sum(F.size("tokens")).cast("long").alias("tokens"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.posexplode("embedding").alias("token", "x")).select("vec_id", "token", F.col("x").cast("double").alias("logit"))


def _token_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in for a model's per-token output: one row for each document."""
    docs = _documents(spark, sf_dir)
    loss = (F.col("doc_id") * 37 % 1000).cast("double") / 250.0
    return docs.select("doc_id", "source", loss.alias("loss"), (F.col("doc_id") % 3 == 0).alias("correct"))


# --- tokenize ---------------------------------------------------------------------------------


@query
def nonblank_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter(is_nonblank(F.col("text")))
    return docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))


@query
def token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    ok = is_nonblank(F.col("text"))
    n = F.when(ok, F.octet_length("text") + 1)
    return docs.groupBy("source").agg(F.count_if(ok).alias("documents"), F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_tokens"), F.max(n).cast("long").alias("longest"))


@query
def token_budget(spark, sf_dir):
    return within_budget(_documents(spark, sf_dir), "n_tokens", BUDGET, ["doc_id"], ["source"])


@query
def pack_flush_after(spark, sf_dir):
    return shards.assign_shards(_documents(spark, sf_dir), CAP, shards.AFTER, ["source"], "doc_id").drop("position")


@query
def pack_flush_before(spark, sf_dir):
    return shards.assign_shards(_documents(spark, sf_dir), CAP, shards.BEFORE, ["source"], "doc_id").drop("position")


@query
def tokenize_report(spark, sf_dir):
    placed = shards.assign_shards(_documents(spark, sf_dir), CAP, shards.AFTER, ["source"], "doc_id")
    return placed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").cast("long").alias("total_tokens"), (F.max("shard_index") + 1).cast("long").alias("shards"))


@query
def stream_packing(spark, sf_dir):
    """The packing of ``pack_flush_after`` by the streaming job, with its state per source."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = ingest.file_stream(spark, f"{sf_dir}/documents.parque[t]", raw.schema, 1_000)  # a stream takes no plain file
    docs = stream.filter(is_nonblank(F.col("text"))).select("doc_id", "source", (BYTES.length(F.col("text")) + 1).cast("long").alias("n_tokens"))
    at = f"{shared_dir(spark)}/lodeworks/stream-{uuid.uuid4().hex}"
    job = ingest.packed(docs, CAP).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{at}/out")


# --- check --------------------------------------------------------------------------------------

_VOCAB, _END = 245, 46


def _scanned(spark, sf_dir):
    made = shards.scan(_turn_pieces(spark, sf_dir), ["source", "shard_index"], "tokens", "start", _END, _VOCAB)
    return made.withColumn("path", shards.shard_path(F.col("source"), F.col("shard_index")))


@query
def shard_scan(spark, sf_dir):
    return _scanned(spark, sf_dir)


@query
def source_check(spark, sf_dir):
    made = shards.source_report(_scanned(spark, sf_dir))
    return made.select("source", "shards", "tokens", "eos_tokens", shards.listed(F.col("missing"), ",").alias("missing"))


@query
def check_messages(spark, sf_dir):
    scanned = _scanned(spark, sf_dir)
    return shards.messages(scanned, shards.source_report(scanned))


@query
def check_totals(spark, sf_dir):
    return _scanned(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("tokens").cast("long").alias("total_tokens"), F.sum("eos_tokens").cast("long").alias("total_eos_tokens"))


@query
def shard_name_parse(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("root/"), "source", F.lit("_1_"), F.lpad(i.cast("string"), 5, "0"), F.lit(".bin"))).when(i % 4 == 1, F.concat(F.lit("root/train/"), "source", F.lit("/part.bin"))).when(i % 4 == 2, F.lit("root/loose.bin")).otherwise(F.concat(F.lit("root/val/"), "source", F.lit("_"), i.cast("string"), F.lit(".bin")))
    named = docs.select("doc_id", path.alias("path"))
    of_check, index = shards.name_parts(F.col("path"), "root")
    of_split, _ = shards.name_parts(F.col("path"))
    return named.select("doc_id", "path", of_check.alias("check_source"), index.alias("shard_index"), of_split.alias("split_source"))


@query
def missing_shards(spark, sf_dir):
    made = shards.missing_ranges(_shard_sizes(spark, sf_dir))
    return made.select("source", F.explode(F.sequence("first", "last")).alias("shard_index"))


@query
def first_documents(spark, sf_dir):
    found = documents.first_document(_turn_pieces(spark, sf_dir), "tokens", _END, "start", ["source", "shard_index"])
    return found.select("source", "shard_index", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# --- split --------------------------------------------------------------------------------------


@query
def document_index(spark, sf_dir):
    return numbered(_documents(spark, sf_dir))


@query
def doc_segments(spark, sf_dir):
    made = documents.segments(_turn_pieces(spark, sf_dir), "tokens", _END, ["shard_index", "start"], ["source"], F.col("shard_index"))
    return made.select("source", "doc_index", "n_tokens", "complete")


@query
def split_assignment_blake2b(spark, sf_dir):
    docs = numbered(_documents(spark, sf_dir))
    return docs.withColumn("split", split_name(blake2b_share(F.col("source"), F.col("doc_index"), SEED), FRACTION))


def _md5_split(spark, sf_dir):
    docs = numbered(_documents(spark, sf_dir))
    return docs.withColumn("split", split_name(md5_share(F.col("source"), F.col("doc_index"), SEED), FRACTION))


@query
def split_assignment_md5(spark, sf_dir):
    return _md5_split(spark, sf_dir)


@query
def split_shards(spark, sf_dir):
    return shards.assign_shards(_md5_split(spark, sf_dir), CAP, shards.BEFORE, ["split", "source"], "doc_index").drop("position")


@query
def split_report(spark, sf_dir):
    return documents.split_report(_md5_split(spark, sf_dir))


@query
def split_summary(spark, sf_dir):
    return documents.split_summary(documents.split_report(_md5_split(spark, sf_dir)))


# --- windows and mixtures -------------------------------------------------------------------------


@query
def window_counts(spark, sf_dir):
    return windows.window_counts(_shard_sizes(spark, sf_dir), BLOCK, ["source"])


@query
def window_boundaries(spark, sf_dir):
    return windows.source_bounds(windows.window_counts(_shard_sizes(spark, sf_dir), BLOCK, ["source"]))


def _windows(spark, sf_dir):
    return windows.tile(_turn_pieces(spark, sf_dir), BLOCK, ["source", "shard_index"], "start", "tokens")


def _sum(name: str):
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, v: a + v)


@query
def token_windows(spark, sf_dir):
    made = windows.samples(_windows(spark, sf_dir))
    return made.select("source", "shard_index", "window_index", F.get("x", F.lit(0)).alias("x_first"), _sum("x").alias("x_sum"), F.element_at("y", -1).alias("y_last"), _sum("y").alias("y_sum"))


@query
def full_split_samples(spark, sf_dir):
    counts = windows.window_counts(_shard_sizes(spark, sf_dir), BLOCK, ["source"])
    made = windows.full_split(_windows(spark, sf_dir), counts, 5)
    return made.select("sample_index", "batch_id", "source", "source_id", "shard_index", "window_index", _sum("tokens").alias("token_sum"))


@query
def source_quotas(spark, sf_dir):
    sizes = [1, 2, 7, 8, 30, 32, 100]
    names = sorted(WEIGHTS)
    rows = [(n, s, mixture.quotas(n, {k: WEIGHTS[k] for k in names})[s]) for n in sizes for s in names]
    return spark.createDataFrame(rows, "batch_size int, source string, quota int")


@query
def unit_labels(spark, sf_dir):
    rows = []
    for batch in (1, 8, 32):
        unit = mixture.unit_schedule(batch, WEIGHTS)
        rows += [(batch, s, unit.count(s), len(unit)) for s in sorted(WEIGHTS)]
    return spark.createDataFrame(rows, "batch_size int, source string, labels int, unit_size int")


def _per_pass(spark, sf_dir):
    counts = windows.window_counts(_shard_sizes(spark, sf_dir), BLOCK, ["source"])
    return counts.groupBy("source").agg(F.sum("windows").cast("long").alias("windows"))


def _role_weights():
    return {"assistant": 0.5, "system": 0.125, "user": 0.375}


@query
def source_draws(spark, sf_dir):
    return mixture.draws(mixture.label_plan(spark, 8, _role_weights(), SEED, 10, 200), _per_pass(spark, sf_dir))


@query
def resume_position(spark, sf_dir):
    unit = mixture.unit_schedule(8, _role_weights())
    counts = spark.createDataFrame([(s, unit.count(s), len(unit)) for s in sorted(_role_weights())], "source string, per_unit int, unit_size int")
    return mixture.resume_position(counts.join(_per_pass(spark, sf_dir), "source"), 3 * 500, 8)


def _source_windows(spark, sf_dir):
    counts = windows.window_counts(_shard_sizes(spark, sf_dir), BLOCK, ["source"])
    met = _windows(spark, sf_dir).join(counts.select("source", "shard_index", "first_window"), ["source", "shard_index"])
    return met.select("source", (F.col("first_window") + F.col("window_index")).alias("window_index"), "tokens")


@query
def pass_order(spark, sf_dir):
    return mixture.pass_order(_per_pass(spark, sf_dir).withColumn("pass", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))), SEED)


@query
def hashed_pass_order(spark, sf_dir):
    return mixture.hashed_order(_per_pass(spark, sf_dir).withColumn("pass", F.lit(0)), SEED)


@query
def mixture_batches(spark, sf_dir):
    made = mixture.batches(spark, _source_windows(spark, sf_dir), _role_weights(), 8, SEED, 5, 25, _per_pass(spark, sf_dir))
    return made.select("step", "slot", "source", "window_index", _sum("tokens").alias("token_sum"))


@query
def missing_sources(spark, sf_dir):
    present = _table(spark, sf_dir, "conversations").select(F.col("role").alias("source")).distinct()
    return mixture.missing_sources(spark, {"assistant": 0.5, "tool": 0.25, "critic": 0.25}, present)


# --- conversations ----------------------------------------------------------------------------------

_LIMIT = 2048


@query
def conversation_status(spark, sf_dir):
    held = chat.gather(_table(spark, sf_dir, "conversations"))
    return held.select("conv_id", F.size("messages").cast("long").alias("turns"), chat.first_error("messages").alias("error"))


def _examples(spark, sf_dir):
    return chat.classify(_table(spark, sf_dir, "conversations"), POINTS, _LIMIT)


@query
def sft_examples(spark, sf_dir):
    made = _examples(spark, sf_dir)
    return made.select("conv_id", "status", "n_tokens", "assistant_tokens", _sum("token_ids").alias("id_sum"))


@query
def sft_offsets(spark, sf_dir):
    return chat.offsets(_examples(spark, sf_dir)).select("conv_id", "example_index", "start", "end")


@query
def sft_audit(spark, sf_dir):
    return chat.audit(_examples(spark, sf_dir))


@query
def generation_prompts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    good = chat.gather(turns).select("conv_id", chat.first_error("messages", "user").alias("e")).filter("e is null")
    made = chat.generation_prompts(turns.join(good, "conv_id", "left_semi"), POINTS)
    return made.select("conv_id", F.size("token_ids").cast("long").alias("n_tokens"), _sum("token_ids").alias("id_sum"))


@query
def collated_batches(spark, sf_dir):
    made = chat.collate(chat.offsets(_examples(spark, sf_dir)), 4, POINTS.pad_token_id)
    return made.select("conv_id", "batch_id", F.col("width").cast("long").alias("width"), _sum("token_ids").alias("id_sum"), _sum("loss_mask").alias("mask_sum"))


# --- metrics ------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def masked_loss(spark, sf_dir):
    kept = _examples(spark, sf_dir).filter(F.col("status") == chat.RETAINED)
    losses = F.transform(F.slice("token_ids", F.lit(2), F.size("token_ids") - 1), lambda t: t.cast("double") / 64.0)
    return _rounded(metrics.masked_loss(kept.select("conv_id", "loss_mask", losses.alias("loss")), by=["conv_id"]))


@query
def sft_eval(spark, sf_dir):
    batches = _token_losses(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 16).alias("b")).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("targets"), F.sum(F.col("correct").cast("long")).alias("correct"))
    return _rounded(metrics.reweighted(batches), 6)


@query
def token_metrics(spark, sf_dir):
    return _rounded(metrics.token_metrics(_token_losses(spark, sf_dir)), 6)


@query
def source_metrics(spark, sf_dir):
    names = _table(spark, sf_dir, "documents").select("source").distinct()
    listed = names.unionAll(spark.createDataFrame([("unseen",)], "source string"))
    return _rounded(metrics.source_metrics(_token_losses(spark, sf_dir), listed.withColumn("name", F.upper("source")), "source", "name"), 6)


@query
def logged_means(spark, sf_dir):
    steps = _token_losses(spark, sf_dir).select(F.col("doc_id").alias("step"), "loss", (F.col("doc_id") % 7 + 1).alias("tokens"))
    return _rounded(metrics.logged_means(steps, 50), 6)


@query
def best_validation(spark, sf_dir):
    evals = _token_losses(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 50).alias("step")).agg(F.round(F.avg("loss"), 6).alias("loss"))
    return metrics.best_so_far(evals)


@query
def finite_check(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", metrics.is_finite(F.col("embedding")).alias("finite"))


def _parameters(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    name = F.concat(F.lit("layers."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".bias").when(F.col("p_partkey") % 3 == 1, ".weight").otherwise(".embedding"))
    return parts.select("p_partkey", name.alias("name"), (F.col("p_partkey") % 3).cast("int").alias("dimensions"), F.col("p_size").cast("long").alias("elements"), (F.col("p_partkey") % 5 > 0).alias("trainable"))


@query
def decay_groups(spark, sf_dir):
    return _parameters(spark, sf_dir).select("p_partkey", metrics.decays(F.col("name"), F.col("dimensions")).alias("decays"))


@query
def parameter_count(spark, sf_dir):
    return metrics.parameter_count(_parameters(spark, sf_dir))


# --- decoding -----------------------------------------------------------------------------------------


@query
def topk_filter(spark, sf_dir):
    return decoding.top_k(_logits(spark, sf_dir), 5, "vec_id")


@query
def topp_filter(spark, sf_dir):
    return decoding.top_p(_logits(spark, sf_dir), 0.4, "vec_id").select("vec_id", "token")


@query
def greedy_argmax(spark, sf_dir):
    return decoding.greedy(_logits(spark, sf_dir), "vec_id")


@query
def token_probabilities(spark, sf_dir):
    made = decoding.softmax(_logits(spark, sf_dir), "vec_id", temperature=0.7)
    return made.select("vec_id", "token", F.round("prob", 9).alias("prob"))


@query
def loglikelihood(spark, sf_dir):
    """Ten vectors make a request; each vector's target is its id modulo the vocabulary."""
    scored = decoding.log_softmax(_logits(spark, sf_dir), "vec_id")
    best = decoding.greedy(_logits(spark, sf_dir), "vec_id").withColumnRenamed("token", "best")
    mine = scored.filter(F.col("token") == F.col("vec_id") % 64).join(best, "vec_id")
    rows = mine.select(F.floor(F.col("vec_id") / 10).alias("request"), "logp", (F.col("token") == F.col("best")).alias("greedy"))
    return _rounded(metrics.sequence_scores(rows, "request"), 6)


def _requests(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.array(F.lit(2)), POINTS.ids(F.col("text"))).alias("ids"))


@query
def rolling_windows(spark, sf_dir):
    made = windows.scoring_windows(_requests(spark, sf_dir), "ids", 50)
    return made.select("item_id", F.col("target_start").cast("long").alias("target_start"), F.col("target_end").cast("long").alias("target_end"), F.size("window").cast("long").alias("width"), _sum("window").alias("id_sum"))


@query
def left_truncate(spark, sf_dir):
    """The last 20 ids of an item are its continuation, all before them its context."""
    n = F.greatest(F.size("ids") - 20, F.lit(0))
    made = _requests(spark, sf_dir).select("item_id", F.slice("ids", F.lit(1), n).alias("context"), F.slice("ids", n + 1, F.size("ids") - n).alias("continuation"))
    cut = decoding.left_truncated(F.col("context"), F.col("continuation"), 48)
    return made.select("item_id", F.size(cut).cast("long").alias("n_context"), _sum_of(cut).alias("id_sum"))


def _sum_of(column):
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, v: a + v)


@query
def stop_strings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.char_length(cut_at_stops(F.col("text"), ["\n", ". ", ","])).cast("long").alias("n_chars"))


@query
def rmsnorm(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    normed = decoding.rms_norm(F.col("embedding"))
    return vectors.select("vec_id", F.posexplode(normed).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query
def rotary(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    turned = decoding.rotated(F.col("embedding"), F.col("vec_id").cast("double"))
    return vectors.select("vec_id", F.posexplode(turned).alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query
def silu_gate(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", "token", F.round(decoding.silu(F.col("logit")), 9).alias("gate"))


@query
def lr_pretrain(spark, sf_dir):
    steps = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("step"))
    return steps.select("step", F.round(schedules.warmup_cosine(F.col("step"), 3e-4, 800, 100, 3e-5), 12).alias("lr"))


@query
def lr_sft(spark, sf_dir):
    steps = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("step"))
    return steps.select("step", F.round(schedules.warmup_constant(F.col("step"), 3e-5, 500), 14).alias("lr"))


from . import jobs  # noqa: E402, F401 (they register themselves)
