"""Texts of blobs kept elsewhere: fetched in order-preserving batches by a pool of threads a task."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes a client for a worker: a function from an object's key to its compressed bytes.
ClientFactory = Callable[[], Callable[[str], bytes]]
THREADS, BATCH = 16, 256


def is_blob_id(column):
    """Not null and not empty; white space is an id like any other."""
    return F.coalesce(column != "", F.lit(False))


def fetch_text(get: Callable[[str], bytes], blob_id: str, prefix: str = "content/") -> str:
    """Decompressed text, without undecodable bytes; empty if anything goes wrong."""
    return _fetched(get, blob_id, prefix) or ""


def _fetched(get: Callable[[str], bytes], blob_id: str, prefix: str = "content/") -> str | None:
    try:
        return gzip.decompress(get(prefix + blob_id)).decode("utf-8", errors="ignore")
    except Exception:
        return None


def unsigned_s3(bucket: str, region: str) -> ClientFactory:
    """Client factory for a public bucket; needs boto3 on the workers."""

    def make() -> Callable[[str], bytes]:
        import boto3
        from botocore import UNSIGNED
        from botocore.client import Config

        client = boto3.client("s3", region_name=region, config=Config(signature_version=UNSIGNED))
        return lambda key: client.get_object(Bucket=bucket, Key=key)["Body"].read()

    return make


def with_blob_text(ids: DataFrame, id_col: str, client: ClientFactory, threads: int = THREADS, batch: int = BATCH, name: str = "text", failed: str | None = None) -> DataFrame:
    """``ids`` with the text of each blob, row for row; rows without an id, and blobs that cannot be
    fetched or unpacked, get an empty text.  ``failed``: a column that tells the latter apart, so that
    they can be counted."""
    if threads <= 0 or batch <= 0:
        raise ValueError("threads and batch must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = client()
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                for a in range(0, len(frame), batch):
                    part = frame.iloc[a : a + batch]
                    texts = list(pool.map(lambda i: _fetched(get, i) if isinstance(i, str) and i else "", part[id_col]))
                    more = {failed: [t is None for t in texts]} if failed else {}
                    yield part.assign(**{name: [t or "" for t in texts]}, **more)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return ids.mapInPandas(run, f"{fields}, `{name}` string" + (f", `{failed}` boolean" if failed else ""))
