"""Registered queries that run whole jobs: shards written, read back, checked and split; requests scored
by a model; artifacts, blobs and streams.  Files go to a folder of their own below the shared one."""

from __future__ import annotations

import gzip
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import pipelines
from ..functions.hashing import md5_share
from ..functions.text import is_nonblank, shown_reply
from ..functions.tokenizers import FileTokenizer, decoded
from ..operators import batches, checkpoints, decoding, metrics, mixture, requests, scoring, windows
from ..operators import conversations as chat
from ..operators.ordered import null_safe_join
from ..operators.permutation import place_of, rank_of
from ..session import shared_dir, small_batches, stored
from ..sources import artifacts, blobs, tensorfiles
from ..sources.tokenfiles import list_files, listing
from ..streaming import ingest
from . import queries as q
from .queries import BLOCK, BUDGET, BYTES, CAP, FRACTION, POINTS, SEED, query


#: Documents of a file that a stream takes in, about.
STREAM_ROWS = 1_000_000


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"


def _below(root: str):
    """A file's path from its folder on."""
    return F.substring_index(F.col("path"), root.rsplit("/", 1)[-1] + "/", -1).alias("path")


def _tokenized(spark, sf_dir) -> tuple[str, dict]:
    root = _folder(spark, "shards")
    docs = q._table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return root, pipelines.tokenize(docs, BYTES, root, CAP)


# --- shards as files ------------------------------------------------------------------------------


@query
def tokenize_job(spark, sf_dir):
    _, report = _tokenized(spark, sf_dir)
    return spark.createDataFrame([tuple(report[c] for c in ("documents", "skipped", "total_tokens", "shards"))], "documents long, skipped long, total_tokens long, shards long")


@query
def written_shards(spark, sf_dir):
    """The files that the tokenize job leaves, as their own bytes say."""
    root, _ = _tokenized(spark, sf_dir)
    found = pipelines.scanned_shards(spark, root, BYTES.vocab_size, BYTES.eos_token_id)
    return found.select(_below(root), "source", "shard_index", "bytes", "tokens", "eos_tokens", "ends_with_eos", "error")


@query
def shard_round_trip(spark, sf_dir):
    """Documents tokenized, written, read back, cut at end tokens and decoded: their texts again."""
    root, _ = _tokenized(spark, sf_dir)
    found = pipelines.shard_fragments(spark, root, BYTES.eos_token_id)
    parts = F.array_sort(F.collect_list(F.struct("at", "tokens")))  # a document's own fragments
    whole = found.groupBy("source", "doc_index").agg(F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("ids"))
    text = decoded(BYTES, F.col("ids"))
    return whole.select("source", "doc_index", text.alias("text")).select("source", "doc_index", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query
def decoded_samples(spark, sf_dir):
    root, _ = _tokenized(spark, sf_dir)
    return pipelines.samples(spark, root, BYTES, BYTES.eos_token_id, 40).select(_below(root), "n_tokens", "sample")


@query
def checked_shards(spark, sf_dir):
    """The lines of the check's report for its sources, and its verdict."""
    root, _ = _tokenized(spark, sf_dir)
    report = pipelines.check(spark, root, BYTES.vocab_size, BYTES.eos_token_id)
    lines = report["text"].split("\n")[1:]  # the first one names the folder
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line int, text string")


@query
def nothing_to_check(spark, sf_dir):
    """A folder that is not there, and one without shards."""
    gone, bare = _folder(spark, "none"), _folder(spark, "bare")
    files, at = pafs.FileSystem.from_uri(bare) if "://" in bare else (pafs.LocalFileSystem(), bare)
    files.create_dir(at)
    reports = [pipelines.check(spark, x, 10, 2) for x in (gone, bare)]
    return spark.createDataFrame([(i, r["files_found"], r["errors"][0].split(":")[0], "total_tokens" in r) for i, r in enumerate(reports)], "folder int, files long, error string, has_totals boolean")


@query
def unreadable_shards(spark, sf_dir):
    """A file for every region, of as many bytes as its key."""
    root = _folder(spark, "odd")
    files, at = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    files.create_dir(at)
    for r in q._table(spark, sf_dir, "region").select("r_regionkey").collect():  # five rows
        with files.open_output_stream(f"{at}/region_{r[0]:04d}.bin") as out:
            out.write(b"\x05" * r[0])
    return listing(spark, root).select(_below(root), "bytes", "error")


@query
def split_files(spark, sf_dir):
    """The files of the split job, by the hash that SQL knows."""
    root, out = _tokenized(spark, sf_dir)[0], _folder(spark, "parts")
    pipelines.split(spark, root, out, BYTES.eos_token_id, SEED, FRACTION, CAP, md5_share)
    return listing(spark, out).select(_below(out), "bytes", "error")


@query
def split_job(spark, sf_dir):
    """The split job's report, by the keyed hash of its own; sums over both splits."""
    root, out = _tokenized(spark, sf_dir)[0], _folder(spark, "parts")
    report = pipelines.split(spark, root, out, BYTES.eos_token_id, SEED, FRACTION, CAP)
    rows = [(s, r["documents"], r["train_documents"] + r["val_documents"], r["train_tokens"] + r["val_tokens"]) for s, r in report["sources"].items()]
    return spark.createDataFrame(rows, "source string, documents long, assigned long, tokens long")


# --- tokenizers -----------------------------------------------------------------------------------


@query
def vocabulary(spark, sf_dir):
    rows = [(n, t.vocab_size, t.bos_token_id, t.eos_token_id, t.pad_token_id) for n, t in (("bytes", BYTES), ("points", POINTS))]
    return spark.createDataFrame(rows, "name string, vocab_size int, bos int, eos int, pad int")


@query
def tokenizer_file_ids(spark, sf_dir):
    """Whole documents by a public tokenizer's file, and the text that the ids stand for."""
    import public_tokenizers

    small_batches(spark)
    tok = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"), eos_token_id=50256)
    docs = q._table(spark, sf_dir, "documents").select("doc_id", "text", tok.ids(F.col("text")).alias("ids"))
    made = docs.select("doc_id", "text", "ids", decoded(tok, F.col("ids")).alias("again"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_ids"), q._sum("ids").alias("id_sum"), F.col("again").eqNullSafe(F.col("text")).alias("same"))


@query
def replies(spark, sf_dir):
    """Turns as replies; one that is empty stands for an end token alone."""
    turns = q._table(spark, sf_dir, "conversations")
    none = F.col("turn") % 3 == 0
    text, ids = F.when(none, "").otherwise(F.col("text")), F.when(none, F.array(F.lit(2))).otherwise(POINTS.ids(F.col("text")))
    return turns.select("conv_id", "turn", F.char_length(shown_reply(ids, 2, text)).cast("long").alias("n_chars"))


# --- requests through a model ---------------------------------------------------------------------


class NextPoint:
    """A model that prefers the code point after the last one, by 2 in logits."""

    def logits(self, ids):
        out = []
        for own in ids:
            z = np.zeros((len(own), 256))
            z[np.arange(len(own)), (np.asarray(own) + 1) % 256] = 2.0
            out.append(z)
        return out

    def generate(self, ids, most):
        return [[(own[-1] + 1 + k) % 256 for k in range(min(most, 6))] for own in ids]


def _pairs(spark, sf_dir) -> DataFrame:
    """Items cut in the middle; white space at the end of the first half moves to the second."""
    items = q._table(spark, sf_dir, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    context = F.concat(F.substring("text", F.lit(1), half), F.when(F.col("item_id") % 2 == 0, "  ").otherwise(""))
    return items.select("item_id", context.alias("context"), F.substring("text", half + 1, F.length("text")).alias("continuation"))


@query
def encoded_pairs(spark, sf_dir):
    made = decoding.encode_pairs(_pairs(spark, sf_dir), POINTS, 2)
    sizes = [F.size(f"{c}_ids").cast("long").alias(f"n_{c}") for c in ("context", "continuation")]
    return made.select("item_id", *sizes, *[q._sum(f"{c}_ids").alias(f"{c}_sum") for c in ("context", "continuation")])


@query
def scored_pairs(spark, sf_dir):
    return q._rounded(scoring.loglikelihood(_pairs(spark, sf_dir), "item_id", POINTS, 2, 4096, NextPoint), 6)


@query
def scored_batches(spark, sf_dir):
    """The same scores in batches of at most 2048 tokens, planned over the whole table."""
    return q._rounded(scoring.loglikelihood(_pairs(spark, sf_dir), "item_id", POINTS, 2, 4096, NextPoint, budget=2048), 6)


def _document_batches(spark, sf_dir) -> DataFrame:
    """Rolling windows of all documents, 512 tokens wide at most, in batches of at most 8192."""
    docs = q._table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", F.concat(F.array(F.lit(2)), POINTS.ids(F.coalesce("text", F.lit("")))).alias("all"))
    rows = windows.scoring_windows(coded, "all", 512).select("doc_id", F.col("target_start").cast("long").alias("target_start"), F.col("window").alias("ids"))
    return requests.token_batches(stored(rows, "requests"), 8192, 512, order=["doc_id", "target_start"])


@query
def request_batches(spark, sf_dir):
    return _document_batches(spark, sf_dir).select("doc_id", "target_start", "n", "band", "batch", "place")


@query
def request_padding(spark, sf_dir):
    return requests.padding_report(_document_batches(spark, sf_dir))


@query
def rolling_scores(spark, sf_dir):
    return q._rounded(scoring.rolling_loglikelihood(q._table(spark, sf_dir, "benchmark"), "item_id", POINTS, 2, 50, NextPoint), 6)


@query
def generated_texts(spark, sf_dir):
    prompts = q._table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))
    return scoring.generate_until(prompts, "item_id", POINTS, 2, 4096, NextPoint, ["e", "|"], 6)


@query
def generated_tokens(spark, sf_dir):
    """Six new tokens after each item by the best next one, or until a line's end."""
    made = scoring.generate_tokens(q._requests(spark, sf_dir), "item_id", NextPoint, 64, 6, end_id=52)
    return made.select("item_id", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), ",").alias("tokens"))


@query
def sampled_tokens(spark, sf_dir):
    """Drawn tokens; the two best of the model are one and the ties of all others, so top-p keeps the one."""
    made = scoring.generate_tokens(q._requests(spark, sf_dir), "item_id", NextPoint, 64, 4, seed=SEED, temperature=0.1, top_k=2, top_p=0.5)
    return made.select("item_id", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), ",").alias("tokens"))


@query
def parameter_names(spark, sf_dir):
    """Names with a prefix that all have, and names that only some have it of."""
    parts = q._table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    all_have = metrics.plain_names(parts.withColumn("name", F.concat(F.lit("module."), "p_brand")))
    some_have = metrics.plain_names(parts.withColumn("other", F.concat(F.when(F.col("p_partkey") % 2 == 0, "module.").otherwise(""), "p_brand")), "other")
    return all_have.select("p_partkey", "name").join(some_have.select("p_partkey", "other"), "p_partkey")


# --- examples and artifacts -----------------------------------------------------------------------


@query
def first_scanned(spark, sf_dir):
    """The first 40 conversations alone are scanned, invalid ones too."""
    made = chat.classify(q._table(spark, sf_dir, "conversations"), POINTS, q._LIMIT, max_examples=40)
    return made.select("conv_id", "status", "n_tokens", "assistant_tokens")


@query
def artifact_examples(spark, sf_dir):
    """Examples written as an artifact and read back."""
    folder = _folder(spark, "artifact")
    artifacts.write_table(q._examples(spark, sf_dir), folder, tokenizer="points", max_length=q._LIMIT)
    made = spark.read.parquet(f"{folder}/examples")
    return made.select("example_index", "start", "end", q._sum("token_ids").alias("id_sum"), q._sum("loss_mask").alias("mask_sum"))


@query
def flat_examples(spark, sf_dir):
    """Examples written as flat files, by the tasks that hold them, and read back in ranges."""
    folder = _folder(spark, "flat")
    artifacts.export(q._examples(spark, sf_dir), folder, tokenizer="points", max_length=q._LIMIT)
    made = artifacts.read_export(spark, folder, range_tokens=100_000)
    return made.select("example_index", "start", (F.col("start") + F.size("token_ids")).alias("end"), q._sum("token_ids").alias("id_sum"), q._sum("loss_mask").alias("mask_sum"))


@query
def artifact_metadata(spark, sf_dir):
    folder = _folder(spark, "artifact")
    artifacts.write_table(q._examples(spark, sf_dir), folder, tokenizer="points", max_length=q._LIMIT)
    fields = "formatter string, tokenizer string, max_length long, scanned long, retained long, dropped long, invalid long, total_tokens long, assistant_tokens long"
    return spark.read.text(f"{folder}/metadata").select(F.from_json("value", fields).alias("m")).select("m.*").drop("formatter")


# --- tensor files ---------------------------------------------------------------------------------


def _weights(spark, sf_dir) -> tuple[str, DataFrame]:
    """Vectors as matrices of up to 256 rows, some with a value that is not a number, written as tensor
    files; and what is expected of them: full matrices, some of which are not there, not all that are."""
    block = F.floor(F.col("vec_id") / 256)
    vectors = q._table(spark, sf_dir, "embeddings").filter("embedding is not null").select(block.alias("b"), "vec_id", "embedding")
    odd = F.when(F.col("vec_id") % 97 == 0, F.transform("embedding", lambda v, i: F.when(i == 0, float("nan")).otherwise(v))).otherwise(F.col("embedding"))
    rows = vectors.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("vec_id", odd.alias("v")))).alias("rows"))
    values = F.flatten(F.col("rows.v"))
    shape = F.array(F.size("rows"), F.call_function("div", F.size(values), F.size("rows")))
    made = rows.select(F.format_string("block.%d.weight", "b").alias("name"), shape.alias("shape"), values.alias("values"))
    folder = _folder(spark, "tensors")
    tensorfiles.write_tensors(made, folder, file_bytes=1_000_000)
    blocks = vectors.select("b").distinct()
    full = F.array(F.lit(256), F.lit(64))
    weights = blocks.filter("b % 5 <> 0").select(F.format_string("block.%d.weight", "b").alias("name"), full.alias("shape"))
    biases = blocks.filter("b % 5 = 0").select(F.format_string("block.%d.bias", "b").alias("name"), F.array(F.lit(256)).alias("shape"))
    return folder, weights.unionAll(biases)


def _inspected(spark, sf_dir) -> DataFrame:
    folder, expected = _weights(spark, sf_dir)
    return checkpoints.inspect(tensorfiles.read_tensors(spark, folder, outline=True, range_bytes=100_000), expected)


@query
def tensor_values(spark, sf_dir):
    """Tensors read back in ranges that cut them anywhere: counts and sums of their values."""
    folder, _ = _weights(spark, sf_dir)
    found = tensorfiles.read_tensors(spark, folder, range_bytes=100_000, row_elements=1000).select("name", "elements", F.explode("values").alias("v"))
    return found.groupBy("name", "elements").agg(F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan("v"), F.col("v"))), 4).alias("total"))


@query
def tensor_headers(spark, sf_dir):
    """What the headers alone say, and the parameters by whether they take weight decay."""
    folder, _ = _weights(spark, sf_dir)
    found = tensorfiles.read_tensors(spark, folder, headers=True)
    return found.groupBy("dtype", metrics.decays(F.col("name"), F.size("shape")).alias("decays")).agg(F.count("*").alias("tensors"), F.sum("elements").alias("parameters"))


@query
def checkpoint_report(spark, sf_dir):
    found = _inspected(spark, sf_dir)
    return found.select("name", "elements", "nonfinite", "low", "high", F.array_join("errors", "; ").alias("errors"))


@query
def checkpoint_summary(spark, sf_dir):
    return checkpoints.summary(_inspected(spark, sf_dir))


# --- blobs ----------------------------------------------------------------------------------------


def _stub_store():
    """A client of a store that lacks every fifth object."""

    def get(key: str) -> bytes:
        if int(key.rsplit("/", 1)[-1]) % 5 == 0:
            raise KeyError(key)
        return gzip.compress(f"text of {key}".encode() + b"\xff")

    return get


@query
def blob_texts(spark, sf_dir):
    i = F.col("doc_id")
    ids = q._table(spark, sf_dir, "documents").select("doc_id", F.when(i % 7 == 0, None).when(i % 11 == 0, "").otherwise(i.cast("string")).alias("blob_id"))
    made = blobs.with_blob_text(ids, "blob_id", _stub_store, 4, 64, failed="failed")
    return made.select("doc_id", blobs.is_blob_id(F.col("blob_id")).alias("has_id"), "text", "failed")


# --- mixtures: what SQL can say of permuted orders --------------------------------------------------


@query
def ensured_quotas(spark, sf_dir):
    """Starved sources take from the largest."""
    weights = {"a": 0.9, "b": 0.05, "c": 0.05}
    rows = [(n, s, k) for n in (3, 5, 10, 20, 40) for s, k in mixture.quotas(n, weights, ensure_all=True).items()]
    return spark.createDataFrame(rows, "batch_size int, source string, quota int")


@query
def cycle_labels(spark, sf_dir):
    """Every cycle of the label plan holds each source by its weight; draws count on from the cycle before."""
    plan = mixture.label_plan(spark, 8, q._role_weights(), SEED, 0, 300)
    cycle = F.floor((F.col("step") * 8 + F.col("slot")) / 24)
    return plan.groupBy(cycle.alias("cycle"), "source").agg(F.count("*").alias("labels"), F.min("draw").alias("first_draw"), F.max("draw").alias("last_draw"))


@query
def drawn_ranks(spark, sf_dir):
    """Draws of 3000 whole cycles: every rank of a pass is drawn once before the next pass begins."""
    made = mixture.draws(mixture.label_plan(spark, 8, q._role_weights(), SEED, 0, 9000), q._per_pass(spark, sf_dir))
    return made.groupBy("source", "pass").agg(F.count("*").alias("draws"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("last_rank"))


@query
def pass_permutations(spark, sf_dir):
    """Each pass is a permutation of its source's windows."""
    made = stored(q.QUERIES["pass_order"](spark, sf_dir), "pass_order")
    rows, chunk = made.count(), 1 << 18

    def told(c: str) -> DataFrame:
        """Least, last and number of different values; a value is counted in the stretch that it is in."""
        part = made.select("source", "pass", F.floor(F.col(c) / chunk).alias("_part"), c).repartition(max(1, -(-rows // chunk)), "source", "pass", "_part")
        each = part.groupBy("source", "pass", "_part").agg(F.count("*").alias("n"), F.min(c).alias("a"), F.max(c).alias("z"), F.count_distinct(c).alias("d"))
        sums = [F.sum("n").alias(f"n_{c}"), F.min("a").alias(f"least_{c}"), F.max("z").alias(f"last_{c}"), F.sum("d").alias(f"different_{c}")]
        return each.groupBy("source", "pass").agg(*sums)

    met = null_safe_join(told("rank"), told("window_index"), ["source", "pass"])
    return met.select("source", "pass", F.col("n_rank").alias("windows"), *[f"{n}_{c}" for c in ("rank", "window_index") for n in ("least", "last", "different")])


@query
def mixture_windows(spark, sf_dir):
    """Windows served by the batches of 9000 steps, which pass over their sources more than once."""
    wins = q._source_windows(spark, sf_dir).select("source", "window_index", F.size("tokens").alias("tokens"))
    made = mixture.batches(spark, wins, q._role_weights(), 8, SEED, 0, 9000, q._per_pass(spark, sf_dir))
    each = made.groupBy("source", "window_index").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("served"), F.count("*").alias("windows"), F.min("n").alias("fewest"), F.max("n").alias("most"))


@query
def hashed_batches(spark, sf_dir):
    """The same by the hashed order."""
    wins = q._source_windows(spark, sf_dir).select("source", "window_index", F.size("tokens").alias("tokens"))
    made = mixture.batches(spark, wins, q._role_weights(), 8, SEED, 0, 9000, q._per_pass(spark, sf_dir), "hashed")
    each = made.groupBy("source", "window_index").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("served"), F.count("*").alias("windows"), F.min("n").alias("fewest"), F.max("n").alias("most"))


@query
def keyed_pass_order(spark, sf_dir):
    """Two passes over each source by the keyed permutation, and back."""
    passes = q._per_pass(spark, sf_dir).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    ranks = mixture.listed_ranks(stored(passes, "passes"))
    key = [F.lit(str(SEED)), F.col("source"), F.col("pass")]
    made = ranks.withColumn("window_index", place_of(F.col("rank"), F.col("windows"), *key))
    back = rank_of(F.col("window_index"), F.col("windows"), *key) == F.col("rank")
    return made.select("source", "pass", "rank", "window_index", back.alias("found_again"))


@query
def keyed_batches(spark, sf_dir):
    """Windows served by the batches of 9000 steps, each computed from its rank."""
    wins = q._source_windows(spark, sf_dir).select("source", "window_index", F.size("tokens").alias("tokens"))
    made = mixture.batches(spark, wins, q._role_weights(), 8, SEED, 0, 9000, q._per_pass(spark, sf_dir), "keyed")
    each = made.groupBy("source", "window_index").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("served"), F.count("*").alias("windows"), F.min("n").alias("fewest"), F.max("n").alias("most"))


# --- lookups --------------------------------------------------------------------------------------


@query
def sample_lookup(spark, sf_dir):
    """A sample of the full split for every document, looked up by its number."""
    counts = stored(windows.window_counts(q._shard_sizes(spark, sf_dir), BLOCK, ["source"]), "window_counts")
    total = counts.agg(F.sum("windows").alias("_n"))  # one row
    asked = q._table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(total)).select("doc_id", (F.col("doc_id") * 7919 % F.col("_n")).alias("sample_index"))
    return windows.locate_samples(asked, counts, BLOCK).select("doc_id", "sample_index", "source_id", "source", "shard_index", "window_index", "start")


@query
def window_lookup(spark, sf_dir):
    """A window of one of the sources for every document."""
    counts = stored(windows.window_counts(q._shard_sizes(spark, sf_dir), BLOCK, ["source"]), "window_counts")
    bounds = windows.source_bounds(counts).select("source_id", "source", (F.col("end_sample") - F.col("first_sample")).alias("windows"))
    docs = q._table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("source_id"))
    asked = docs.join(bounds, "source_id").select("doc_id", "source", (F.col("doc_id") * 104_729 % F.col("windows")).alias("source_window"))
    return windows.locate_windows(asked, counts, BLOCK).select("doc_id", "source", "source_window", "shard_index", "window_index", "start")


# --- batches, streams, layers -----------------------------------------------------------------------


@query
def first_batches(spark, sf_dir):
    counts = windows.window_counts(q._shard_sizes(spark, sf_dir), BLOCK, ["source"])
    made = batches.first_batches(windows.full_split(q._windows(spark, sf_dir), counts, 5), 3)
    return made.select("sample_index", "batch_id", "source", "window_index")


@query
def epoch_positions(spark, sf_dir):
    """The shuffle of an epoch gives every document a place of its own."""
    made = batches.epoch_order(q._table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED)
    return made.agg(F.count("*").alias("documents"), F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("places"))


@query
def observed_rows(spark, sf_dir):
    """What a job saw as its rows passed."""
    docs = q._table(spark, sf_dir, "documents").select("text")
    seen, watch = batches.observed(docs, f"seen-{uuid.uuid4().hex}", blank=F.count_if(~is_nonblank(F.col("text"))))
    seen.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["rows"], watch.get["blank"])], "documents long, blank long")


@query
def step_tokens(spark, sf_dir):
    return q._table(spark, sf_dir, "part").select("p_partkey", batches.tokens_per_step(F.col("p_size"), 128).cast("long").alias("tokens"))


@query
def stream_budget(spark, sf_dir):
    """The streamed packing with a budget for each source."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = ingest.file_stream(spark, f"{sf_dir}/documents.parque[t]", raw.schema, 1_000)
    docs = stream.filter(is_nonblank(F.col("text"))).select("doc_id", "source", (BYTES.length(F.col("text")) + 1).cast("long").alias("n_tokens"))
    at = _folder(spark, "stream")
    job = ingest.packed(docs, CAP, BUDGET).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query
def stream_stop(spark, sf_dir):
    """The same from documents that come in files, ended once every source has its budget."""
    docs = stored(q._documents(spark, sf_dir), "lengths")  # texts are read once, by as many tasks as there are
    at, low, high, n = _folder(spark, "stop"), *docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    parts = max(4, -(-n // STREAM_ROWS))
    part = F.floor((F.col("doc_id") - low) * parts / (high - low + 1))
    for i in range(parts):  # one after another: a file source takes the oldest first
        docs.filter(part == i).repartition(1).write.mode("append").parquet(f"{at}/in")
    sources = [r[0] for r in docs.select("source").distinct().collect()]  # a name for each source
    ingest.pack_until_budget(ingest.file_stream(spark, f"{at}/in", docs.schema), CAP, BUDGET, sources, f"{at}/out", f"{at}/state")
    return spark.read.schema("source string, doc_id long, n_tokens long, doc_index long, shard_index long").parquet(f"{at}/out")


@query
def streamed_shards(spark, sf_dir):
    """Shards read as a stream of files, a few for each micro-batch, and counted as they come."""
    root, _ = _tokenized(spark, sf_dir)
    at = _folder(spark, "streamed")
    files = len(list_files(root))
    rows = ingest.shard_stream(spark, root, -(-files // 3)).select(_below(root), F.size("tokens").alias("n"), q._sum("tokens").alias("id_sum"))
    rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("path").agg(F.sum("n").alias("tokens"), F.sum("id_sum").alias("id_sum"))


@query
def streamed_mixture(spark, sf_dir):
    """Windows served by the endless mixture in three runs of 3000 steps, each going on where the last ended."""
    at = _folder(spark, "mixture")
    wins = stored(q._source_windows(spark, sf_dir).select("source", "window_index", F.size("tokens").alias("tokens")), "windows")
    per_pass = stored(q._per_pass(spark, sf_dir), "per_pass")
    for _ in range(3):
        ingest.serve(ingest.mixture_stream(spark, wins, q._role_weights(), 8, SEED, per_pass, 3000), f"{at}/out", f"{at}/state")
    each = spark.read.parquet(f"{at}/out").groupBy("source", "window_index").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("served"), F.count("*").alias("windows"), F.min("n").alias("fewest"), F.max("n").alias("most"))


@query
def stream_examples(spark, sf_dir):
    """Conversations classified as they come, in micro-batches, and read back with their offsets."""
    at = _folder(spark, "chats")
    held = chat.gather(q._table(spark, sf_dir, "conversations"))
    held.repartitionByRange(4, "conv_id").write.parquet(f"{at}/in")
    ingest.write_examples(ingest.file_stream(spark, f"{at}/in", held.schema, 1), POINTS, q._LIMIT, f"{at}/out", f"{at}/state")
    made = chat.offsets(spark.read.parquet(f"{at}/out"))
    return made.select("conv_id", "example_index", "start", "end")


@query
def rmsnorm_weighted(spark, sf_dir):
    vectors = q._table(spark, sf_dir, "embeddings")
    weights = F.transform("embedding", lambda x, i: (i % 3 + 1).cast("double") / 2)
    made = decoding.rms_norm(F.col("embedding"), weights=weights)
    return vectors.select("vec_id", F.posexplode(made).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query
def swiglu(spark, sf_dir):
    vectors = q._table(spark, sf_dir, "embeddings")
    made = decoding.swiglu(F.col("embedding"), F.reverse("embedding"))
    return vectors.select("vec_id", F.posexplode(made).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))
