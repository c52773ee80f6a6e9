"""Command line: the verbs of corpus preparation, run on a Spark session.

    python -m lodeworks.cli tokenize --input docs.parquet --source web --output shards
    python -m lodeworks.cli check --root shards --vocab-size 259 --eos-id 2
    python -m lodeworks.cli split --input-root shards --output-root parts --eos-id 2
    python -m lodeworks.cli prepare-sft --input chats.parquet --output-dir sft
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pipelines
from .functions.registry import NamedTokenizer, fingerprint
from .functions.tokenizers import ByteTokenizer, FileTokenizer
from .operators.conversations import classify
from .sources.artifacts import export, metadata


def _tokenizer(spark: SparkSession, a: argparse.Namespace):
    if a.tokenizer == "bytes":
        return ByteTokenizer()
    if a.tokenizer_root is None:
        return FileTokenizer(a.tokenizer, a.bos_id, a.eos_id)
    name, _, revision = a.tokenizer.partition("@")
    return NamedTokenizer(spark, a.tokenizer_root, name, revision or "main", a.bos_id, a.eos_id)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lodeworks")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("tokenize", "check", "split", "prepare-sft"):
        p = verbs.add_parser(verb)
        p.add_argument("--tokenizer", default="bytes", help="bytes, the path of a tokenizer file, or name@revision below the registry")
        p.add_argument("--tokenizer-root", help="a registry: {name}/{revision}/tokenizer.json")
        p.add_argument("--bos-id", type=int)
        p.add_argument("--eos-id", type=int, default=2)
        p.add_argument("--report")
        if verb in ("tokenize", "prepare-sft"):
            p.add_argument("--input", required=True)
        if verb == "tokenize":
            p.add_argument("--source", required=True)
            p.add_argument("--text-field", default="text")
            p.add_argument("--output", required=True)
            p.add_argument("--shard-tokens", type=int, default=pipelines.SHARD_TOKENS)
            p.add_argument("--max-tokens", type=int)
        if verb == "check":
            p.add_argument("--root", required=True)
            p.add_argument("--vocab-size", type=int)
            p.add_argument("--decode-sample", action="store_true", help="decode the first document of every shard")
            p.add_argument("--max-characters", type=int, default=1000)
        if verb == "split":
            p.add_argument("--input-root", required=True)
            p.add_argument("--output-root", required=True)
            p.add_argument("--validation-fraction", type=float, default=0.01)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--output-shard-tokens", type=int, default=pipelines.SHARD_TOKENS)
        if verb == "prepare-sft":
            p.add_argument("--output-dir")
            p.add_argument("--max-length", type=int, default=2048)
            p.add_argument("--max-examples", type=int)
            p.add_argument("--dry-run", action="store_true")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    tok = _tokenizer(spark, a)
    code = 0
    if a.verb == "tokenize":
        docs = spark.read.parquet(a.input).withColumnRenamed(a.text_field, "text").withColumn("source", F.lit(a.source))
        report = pipelines.tokenize(docs, tok, a.output, a.shard_tokens, a.max_tokens)
    elif a.verb == "check":
        named = tok if a.tokenizer != "bytes" or a.vocab_size is None else None  # a vocabulary's size alone names none
        report = pipelines.check(spark, a.root, a.vocab_size or tok.vocab_size, a.eos_id, tokenizer=named)
        print(report.pop("text"))
        code = 1 if report["error_count"] else 0
        tables = {name: report.pop(name) for name in ("shard_table", "message_table") if name in report}
        if a.report:  # all rows, beside the report
            for name, rows in tables.items():
                rows.write.mode("overwrite").json(f"{a.report}.{name}")
        if a.decode_sample and report["files_found"]:
            for r in pipelines.samples(spark, a.root, tok, a.eos_id, a.max_characters).orderBy("path").toLocalIterator():
                print(f"{r['path']}: {r['n_tokens']:,} tokens in the first document\n    {r['sample']!r}")
    elif a.verb == "split":
        report = pipelines.split(spark, a.input_root, a.output_root, a.eos_id, a.seed, a.validation_fraction, a.output_shard_tokens)
    else:
        examples = classify(spark.read.parquet(a.input), tok, a.max_length, max_examples=a.max_examples).persist()
        if not a.dry_run:
            export(examples, a.output_dir, tokenizer=a.tokenizer, max_length=a.max_length, fingerprint=fingerprint(tok))
        report = metadata(examples, tokenizer=a.tokenizer, max_length=a.max_length, fingerprint=fingerprint(tok))
    text = json.dumps(report, indent=2)
    print(text)
    if a.report:
        os.makedirs(os.path.dirname(a.report) or ".", exist_ok=True)
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
