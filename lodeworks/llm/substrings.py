"""Substring dedup: words inside any 35-word window that starts somewhere else too.

Suffix automata of *all* reference text cannot be broadcast: their size and the work (shards x
documents) grow with the corpus.  So the reference shards are cut down and routed first:

1. Every window has an anchor, the smallest hash among its 12-word grams, which is the same wherever
   the window occurs.  Documents send one row for each anchor (about one in twelve words), with a
   digest of its segment, the text that the anchor's windows cover.
2. Anchors that occur once cannot be inside a repeated window.  If all segments of an anchor are
   alike, all their windows are repeated.  For the others the documents send the segments themselves;
   equal ones collapse, map-side first.
3. The distinct segments of one anchor are a reference shard.  A shard of up to ``SHARD`` segments
   gets a suffix automaton with occurrence counts, and the segments stream through it for their
   matching statistics: windows that end in two or more places are repeated.  An anchor with more
   distinct segments than that (a very common passage in ever new surroundings) is never gathered:
   its windows are counted one by one with an aggregation, and joined back.
4. The repeated windows of each document are removed.

The documents are kept once, compressed and bucketed by their key, so that lists of anchors and of
repeated windows come to the texts, and no text is shuffled twice.

All occurrences are judged on the input.  Segments that are alike are told by 128 bits of digests (anchor and
segment), as are the windows of large shards; automata compare words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import bucketed, discard, shuffle_width, written

WINDOW, GRAM = 35, 12
#: Distinct segments of an anchor that one automaton takes.
SHARD = 128
#: Text in a bucket of the documents' table, on average.
BUCKET_BYTES = 256 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, grown as needed, and the bytes' values."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
        _powers.append(np.random.default_rng(35).integers(1, 1 << 63, 256, dtype=np.uint64))
    return _powers


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, first, n, lead, digest) of each anchor: its windows start at first .. first + n - 1,
    the anchor itself at first + lead; digest: of the segment and where in it the anchor is."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 5
    text = b" ".join(words)
    flat = np.frombuffer(text, np.uint8)
    power, inverse, value = _power_tables(len(flat))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[flat] * power[: len(flat)])))
    s, e = starts[: len(words) - gram + 1], ends[gram - 1 :]
    g = (prefix[e] - prefix[s]) * inverse[s]
    g ^= g >> np.uint64(29)
    g *= _MIX
    g ^= g >> np.uint64(32)
    view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    step = 1 << 16
    least = np.concatenate([view[i : i + step].argmin(axis=1) for i in range(0, len(view), step)]) + np.arange(len(view))
    first = np.flatnonzero(np.diff(least, prepend=-1))
    n, lead = np.diff(np.append(first, len(view))), least[first] - first
    cuts = zip(starts[first].tolist(), ends[first + n + window - 2].tolist(), lead.tolist())
    digests = np.frombuffer(b"".join([xxhash.xxh3_64_digest(text[a:b], seed=k) for a, b, k in cuts]), ">i8").astype(np.int64)
    return g[least[first]].view(np.int64), first, n, lead, digests


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text with a key of each row, so that null, repeated and hot ids are rows like any other;
    it holds once it is written."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("k"))


def _buckets(docs: DataFrame, text_col: str) -> int:
    """Buckets for the texts: as many as shuffles have, and no fewer than keep one at ``BUCKET_BYTES``."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES))


def _send_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [anchors(split_words(x.as_py()), window, gram) for x in batch.column(1)]
            row = pa.array(np.repeat(np.arange(len(own)), [len(a[0]) for a in own]))
            h, first, n, _, g = (np.concatenate([a[i] for a in own]) if own else np.zeros(0, np.int64) for i in range(5))
            cols = [pa.array(h), pa.array(g), batch.column(0).take(row), *(pa.array(x.astype(np.int32)) for x in (first, n))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "g", "k", "first", "n"])

    return run


def _send_segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg, cols = [], ([], [], [], [])
            for text, at in (zip(batch.column(1), batch.column(2).to_pylist())):
                words = split_words(text.as_py())
                for a in at:
                    piece = b" ".join(words[a["first"] : a["first"] + a["n"] + window - 1])
                    seg.append(piece)
                    for held, name in zip(cols, ("h", "g", "first", "n")):
                        held.append(a[name])
            parts = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(seg, pa.binary()), pa.array(cols[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(parts, ["h", "g", "seg", "n"])

    return run


def shard_masks(segments: list[tuple[bytes, int]], window: int = WINDOW) -> list[int]:
    """For distinct segments of one anchor, with how often each occurs: bit j of a segment's mask is
    set if its window j ends in at least two places."""
    shard = SuffixAutomaton()
    split = [s.split(b" ") for s, _ in segments]
    for words, (_, times) in zip(split, segments):
        shard.add(words, times)
    shard.finish()
    masks = []
    for words in split:
        mask = 0
        for i, (n, places) in enumerate(shard.matching(words, window)):
            if n == window and places > 1:
                mask |= 1 << (i - window + 1)
        masks.append(mask)
    return masks


def _judge(window: int):
    """Rows come sorted by anchor; (h, g, mask) of every segment with a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> list[tuple[int, int, int]]:
            masks = shard_masks([(seg, times) for _, _, seg, times in held], window)
            return [(r[0], r[1], m) for r, m in zip(held, masks) if m]

        def batch_of(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["h", "g", "mask"])

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != r[0]:
                    out += done()
                    held = []
                held.append(r)
            yield batch_of(out)
        if held:
            yield batch_of(done())

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(k, spans): for keyed documents, (first, mask) of every segment with repeated windows."""
    sent = written(docs.select("k", "text").mapInArrow(_send_anchors(window, gram), "h long, g long, k long, first int, n int"), "anchors")
    # anchors that occur again; mixed: in segments that differ
    # written, so that the joins have plain exchanges on both sides and a hot anchor's rows can be split
    twice = written(sent.groupBy("h").agg(F.count("*").alias("c"), (F.min("g") != F.max("g")).alias("mixed")).filter("c > 1").select("h", "mixed"), "twice")
    again = written(sent.join(twice, "h").select("h", "g", "k", "first", "n", "mixed"), "again")
    discard(sent)
    discard(twice)
    # lists of one document each
    lists = again.filter("mixed").groupBy("k").agg(F.collect_set(F.struct("h", "g", "first", "n")).alias("at"))
    wanted = docs.select("k", "text").join(lists.hint("shuffle_hash"), "k")
    segments = wanted.mapInArrow(_send_segments(window), "h long, g long, seg binary, n int")
    distinct = written(segments.groupBy("h", "g").agg(F.first("seg").alias("seg"), F.first("n").alias("n"), F.count("*").alias("times")), "shards")
    sizes = written(distinct.groupBy("h").agg(F.count("*").alias("d")), "sizes")
    sized = distinct.join(sizes, "h")
    few = sized.filter(F.col("d") <= shard).select("h", "g", "seg", "times")
    judged = few.repartition("h").sortWithinPartitions("h").mapInArrow(_judge(window), "h long, g long, mask long")
    words = F.split(F.col("seg").cast("string"), " ", -1)
    many = sized.filter(F.col("d") > shard).select("h", "g", "times", "n", words.alias("w"))
    each = many.select("h", "g", "times", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    each = each.select("h", "g", "times", "j", F.md5(F.array_join(F.slice("w", F.col("j") + 1, window), " ").cast("binary")).alias("digest"))
    common = each.groupBy("digest").agg(F.sum("times").alias("c")).filter("c > 1").select("digest")
    counted = each.join(common, "digest").groupBy("h", "g").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("mask"))
    masks = written(judged.unionAll(counted), "masks")
    discard(distinct)
    mixed = again.filter("mixed").select("h", "g", "k", "first").join(masks, ["h", "g"]).select("k", "first", "mask")
    alike = again.filter("not mixed").select("k", "first", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    return mixed.unionAll(alike).groupBy("k").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))


def ways(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(way, anchors, windows): which way decides how many windows of ``docs``; see the module's text.

    once: the anchor occurs once; alike: all its segments are; automaton: its distinct segments make a
    shard; counted: they are more than that.  For reports; the operator itself does not need it.
    """
    keyed = _keyed(docs, id_col, text_col).select("k", "text")
    sent = keyed.mapInArrow(_send_anchors(window, gram), "h long, g long, k long, first int, n int")
    each = sent.groupBy("h", "g").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("h").agg(F.sum("c").alias("c"), F.count("*").alias("d"), F.sum("n").alias("n"))
    way = F.when(F.col("c") == 1, "once").when(F.col("d") == 1, "alike").when(F.col("d") <= shard, "automaton").otherwise("counted")
    return each.groupBy(way.alias("way")).agg(F.sum("c").alias("anchors"), F.sum("n").alias("windows"))


def covered(n_words: int, spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which words are inside a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for first, mask in spans:
        while mask:
            j = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            edge[first + j] += 1
            edge[min(first + j + window, n_words)] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_text): each document without the words of repeated windows.

    Words are runs of anything but ASCII white space, unchanged; kept words are joined by one space.
    Null, empty or short texts lose nothing; repeated rows are repeats of each other, whatever their
    ids, which may be of any type.  An empty table gives no rows.  ``digest``: kept_sha256 (lowercase hex, UTF-8) in place of kept_text.  Windows have 3 to 63
    more words than grams at most.  Other columns are ignored.
    """
    if not gram <= window < gram + 63:
        raise ValueError("a window must hold a gram, and at most 62 words more")
    keyed = bucketed(_keyed(docs, id_col, text_col), "texts", ["k"], _buckets(docs, text_col))
    spans = repeated_windows(keyed, window, gram, shard)
    joined = keyed.join(spans.hint("shuffle_hash"), "k", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for x, at in zip(batch.column(1), batch.column(2)):
                words = split_words(x.as_py())
                out = words
                if at.is_valid:
                    gone = covered(len(words), [(s["first"], s["mask"]) for s in at.as_py()], window)
                    out = [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                text = b" ".join(out)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass"))
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")
