"""Line dedup with two Bloom filters.

1. Every task sends the 64-bit hashes of its distinct line keys (eight bytes a line; a key that
   several of its documents hold is sent twice), filed under hash ranges, whose number follows the
   size of the text so that none holds more than about ``RANGE_LINES``.
2. Each hash range fills two filters of its own: bits of once-seen keys, and bits of keys that were
   already in the first.  Only the second, of twice-seen keys, is kept, at 16 bits a line.
3. The documents are read again, and lines that the second filter suspects are picked:
   * If the filters of all ranges have ``MAX_BITS`` or less, they go to the executors.
   * Beyond that they stay where they are: the documents' line hashes are filed under the same ranges
     and pass by their range's filter, and what it suspects comes back as a list of hashes for each
     row.  Hashes that very many tasks send, whose rows would crowd one range, are suspects without that
     way, as a list of at most ``HOT_KEYS``.  The filters suspect as few lines as before, at any size.
4. Suspected lines are shuffled, as text, and counted exactly per key, pre-aggregated, with the
   largest id that holds the key.
5. Keys in enough documents lose their lines everywhere but in that document.  The list of such
   keys goes to the executors if its measured size is at most ``BROADCAST_BYTES``; a longer list is
   joined by key and by row instead.

Up to both bounds only suspected lines are shuffled as text.  Beyond one of them rows have to meet lists
of their own: they are written once, bucketed by a key of each row (so no id, source or group of
copies crowds a bucket), and the joins with either list move the list, not the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, lean, shuffle_width, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of a filter for each line, and the most bits that are broadcast (64 MB).
BITS_PER_LINE, MAX_BITS = 16, 1 << 29
#: A list of repeated keys of more bytes than this is joined, not broadcast.
BROADCAST_BYTES = 16 << 20
#: Lines of a hash range, at most about; hashes that a task gathers before it sends them.
RANGE_LINES, _GATHERED = 1 << 22, 1 << 18
#: A key is hot if so many sendings hold it; so many hot keys go to all executors.
HOT_TIMES, HOT_KEYS = 256, 1 << 20
#: Bytes of text of a bucket, about.
BUCKET_BYTES = 128 << 20
_LEAST_RANGES, _PROBES, _SPACE, _CHUNK = 10, 4, b" \t\n\x0b\x0c\r", 1 << 16


def line_keys(text: str | None, least: int = MIN_CHARS) -> list[tuple[bytes, bytes]]:
    """(line, key) of every line; the key is empty if it has fewer than ``least`` code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(_SPACE).lower()  # bytes: A-Z only
        short = len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least)
        out.append((line, b"" if short else key))
    return out


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, keys)), ">u8").astype(np.uint64)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """n x probes bit positions within a hash range's own ``bits`` (a power of two)."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h[:, None] + step[:, None] * np.arange(1, _PROBES + 1, dtype=np.uint64)) >> np.uint64(7)) & np.uint64(bits - 1)


class BloomPair:
    """Once-seen and twice-seen bits of one hash range."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        own, n = np.unique(hashes, return_counts=True)
        at = _places(own, self.bits)
        again = (n > 1) | self.once[at].all(axis=1)
        self.twice[at[again].ravel()] = True
        self.once[at.ravel()] = True


class TwiceSeen:
    """The twice-seen filter of all hash ranges, packed; what executors get."""

    def __init__(self, ranges: dict[int, bytes], range_bits: int, bits: int):
        self.range_bits, self.bits = range_bits, bits
        self.packed = np.zeros((1 << range_bits, bits // 8), np.uint8)
        for k, v in ranges.items():
            self.packed[k] = np.frombuffer(v, np.uint8)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        own = (hashes >> np.uint64(64 - self.range_bits))[:, None]
        return _set_bits(self.packed[own, at >> np.uint64(3)], at)


def _set_bits(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (held >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def range_bits_for(text_bytes: int, least: int = MIN_CHARS, lines: int = RANGE_LINES) -> int:
    """Bits of the hash that name its range: no text has more keys than bytes by their least length."""
    return max(_LEAST_RANGES, (text_bytes // (least + 1) // lines).bit_length())


def _pieces(h: np.ndarray, range_bits: int, *more: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(ranges, bytes): sorted hashes, with what belongs to each, cut at range borders and in chunks."""
    ranges = (h >> np.uint64(64 - range_bits)).astype(np.int32)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
    ends = [*starts[1:], len(h)]
    each = _CHUNK // (8 + 8 * len(more))
    cuts = [(i, min(i + each, b)) for a, b in zip(starts, ends) for i in range(a, b, each)]
    return ranges[[a for a, _ in cuts]], [b"".join(x[a:b].tobytes() for x in (h, *more)) for a, b in cuts]


def _by_range(batches: Iterator[pa.RecordBatch], start: Callable, take: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range: a range's state is made, fed, and closed before the next one."""
    now, state = None, None
    for batch in batches:
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k != now:
                if now is not None:
                    yield from end(now, state)
                now, state = k, start(k)
            yield from take(state, batch, i)
    if now is not None:
        yield from end(now, state)


def _send_hashes(range_bits: int, least: int):
    """(range, hashes) of a task's distinct keys, those of several documents twice."""

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            h = np.sort(np.concatenate([own, own[times > 1]]))
            ranges, parts = _pieces(h, range_bits)
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(parts, pa.binary())], ["range", "hashes"])

        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(_hashes({k for _, k in line_keys(x.as_py(), least) if k}))
                n += len(held[-1])
            if n >= _GATHERED:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    return send


def twice_seen(docs: DataFrame, text_col: str = "text", least: int = MIN_CHARS, hot_times: int = HOT_TIMES) -> tuple[DataFrame, int, int]:
    """(filters, range bits, bits of a range): steps 1 and 2.

    ``filters``, written: range, kind and data; kind 0: chunks (``part``, in order) of the packed
    twice-seen bits; kind 1: a hot hash, with how many sendings held it as ``part``.
    """
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    range_bits = range_bits_for(size, least)
    sent = written(docs.select(text_col).mapInArrow(_send_hashes(range_bits, least), "range int, hashes binary"), "linehashes")
    n = (sent.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 8
    bits = 1 << max(17 - range_bits, 3, int(n * BITS_PER_LINE - 1).bit_length() - range_bits if n else 0)

    def start(_):
        return BloomPair(bits), []

    def take(state, batch, i):
        h = np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
        state[0].add(h)
        state[1].append(h)
        return ()

    def end(k, state):
        packed = np.packbits(state[0].twice, bitorder="little").tobytes()
        chunks = [(0, at // _CHUNK, packed[at : at + _CHUNK]) for at in range(0, len(packed), _CHUNK)]
        seen, times = np.unique(np.concatenate(state[1]), return_counts=True)
        chunks += [(1, int(c), h.tobytes()) for h, c in zip(seen[times >= hot_times], times[times >= hot_times])]
        kinds, parts, data = zip(*chunks)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(chunks), pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["range", "kind", "part", "data"])

    @lean
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_range(batches, start, take, end)

    dealt = sent.repartition(shuffle_width(docs.sparkSession), "range").sortWithinPartitions("range")
    filters = written(dealt.mapInArrow(fill, "range int, kind int, part int, data binary"), "twiceseen")
    discard(sent)
    return filters, range_bits, bits


def broadcast_filter(filters: DataFrame, range_bits: int, bits: int) -> TwiceSeen:
    """All filters on the driver: bits << range_bits bits."""
    ranges: dict[int, bytes] = {}
    for r in filters.filter("kind = 0").sort("range", "part").toLocalIterator():
        ranges[r["range"]] = ranges.get(r["range"], b"") + bytes(r["data"])
    return TwiceSeen(ranges, range_bits, bits)


def suspects_by_range(docs: DataFrame, filters: DataFrame, range_bits: int, bits: int, least: int) -> tuple[DataFrame, np.ndarray]:
    """(lists, hot): for each document (k) the hashes of its lines that their range's filter suspects,
    but for hot ones, which are listed once.  ``docs``: k, text."""
    most = filters.filter("kind = 1").orderBy(F.col("part").desc(), "data").limit(HOT_KEYS).select("data").collect()  # the rest takes the common way
    hot = np.sort(np.array([np.frombuffer(bytes(r["data"]), np.uint64)[0] for r in most], np.uint64))

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array(sorted(set(_hashes({k for _, k in line_keys(x.as_py(), least) if k}).tolist())), np.uint64) for x in batch.column(1)]
            h = np.concatenate(own) if own else np.zeros(0, np.uint64)
            k = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            some = ~np.isin(h, hot)
            order = np.argsort(h[some], kind="stable")
            ranges, parts = _pieces(h[some][order], range_bits, k[some][order])
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([2] * len(parts), pa.int32()), pa.array([0] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["range", "kind", "part", "data"])

    def start(_):
        return []

    def take(chunks, batch, i):
        if batch.column(1)[i].as_py() == 0:
            chunks.append(np.frombuffer(batch.column(3)[i].as_py(), np.uint8))
            return
        both = np.frombuffer(batch.column(3)[i].as_py(), np.uint64).reshape(2, -1)
        if len(chunks) > 1:
            chunks[:] = [np.concatenate(chunks)]
        at = _places(both[0], bits)
        found = _set_bits(chunks[0][at >> np.uint64(3)], at) if chunks else np.zeros(both.shape[1], bool)
        yield pa.RecordBatch.from_arrays([pa.array(both[1][found].view(np.int64)), pa.array(both[0][found].view(np.int64))], ["k", "h"])

    @lean
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_range(batches, start, take, lambda k, state: ())

    met = filters.filter("kind = 0").unionAll(docs.select("k", "text").mapInArrow(send, "range int, kind int, part int, data binary"))
    dealt = met.repartition("range").sortWithinPartitions("range", "kind", "part")
    lists = dealt.mapInArrow(probe, "k long, h long").groupBy("k").agg(F.collect_set("h").alias("maybe"))
    return written(lists, "suspectlists"), hot


def _by_row(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``columns`` of ``docs`` under the names given, with k, a key of each row that holds once it is written,
    by which the table is bucketed."""
    rows = docs.select(F.monotonically_increasing_id().alias("k"), *[F.col(c).alias(n) for n, c in columns.items()])
    size = docs.agg(F.sum(F.octet_length(columns["text"]).cast("long"))).first()[0] or 0
    return bucketed(rows, "linerows", ["k"], max(shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES)))


def _suspect_lines(rows: DataFrame, least: int, seen: TwiceSeen | None, hot: np.ndarray | None) -> DataFrame:
    """(key, id, and k if ``rows`` have it) of lines that ``seen`` suspects, or else the row's list (maybe) or
    the list of hot hashes."""
    listed, columns = seen is None, ["id", "text", *(c for c in ("k", "maybe") if c in rows.columns)]

    def suspected(h: np.ndarray, maybe) -> np.ndarray:
        return np.isin(h, np.array(maybe.as_py() or [], np.int64).view(np.uint64)) | np.isin(h, hot)

    @lean
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, x in enumerate(batch.column(1)):
                own = list({k for _, k in line_keys(x.as_py(), least) if k})
                if listed and own:
                    own = [own[j] for j in np.flatnonzero(suspected(_hashes(own), batch.column(3)[i]))]
                keys.extend(own)
                at.extend([i] * len(own))
            some = range(len(keys)) if listed or not keys else np.flatnonzero(seen.suspects(_hashes(keys)))
            place = pa.array([at[i] for i in some], pa.int32())
            more = [batch.column(2).take(place)] if "k" in columns else []
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), batch.column(0).take(place), *more], ["key", "id", "k"][: 2 + len(more)])

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.select(*columns).mapInArrow(pick, f"key binary, id {kind}" + (", k long" if "k" in columns else "")), "suspects")


class _Lines:
    """What the steps leave: ``decisions`` (key, keeper), ``suspects`` (key, id, and k beyond the filters' bound),
    the filter that was broadcast (``seen``) or the bucketed ``rows``."""

    def __init__(self, docs: DataFrame, columns: dict[str, str], least: int, min_docs: int, max_bits: int, hot_times: int):
        self.docs, self.columns, self.least, self.rows, self.seen = docs, columns, least, None, None
        filters, range_bits, bits = twice_seen(docs, columns["text"], least, hot_times)
        if bits << range_bits <= max_bits:
            self.seen = broadcast_filter(filters, range_bits, bits)
            self.suspects = _suspect_lines(docs.select(*[F.col(columns[c]).alias(c) for c in ("id", "text")]), least, self.seen, None)
        else:
            self.rows = _by_row(docs, columns)
            lists, hot = suspects_by_range(self.rows, filters, range_bits, bits, least)
            self.suspects = _suspect_lines(self.rows.join(lists.hint("shuffle_hash"), "k", "left"), least, None, hot)
        counted = self.suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        self.decisions = written(counted.filter(F.col("n") >= min_docs).select("key", "keeper"), "repeated")

    def with_lists(self) -> DataFrame:
        """The bucketed rows with ``gone``, (key, keeper) of those of their keys that are kept elsewhere."""
        suspects = self.suspects
        if self.rows is None:
            self.rows = _by_row(self.docs, self.columns)
            suspects = _suspect_lines(self.rows, self.least, self.seen, None)
        gone = suspects.join(self.decisions, "key").filter(~F.col("id").eqNullSafe(F.col("keeper")))
        lists = written(gone.groupBy("k").agg(F.collect_list(F.struct("key", "keeper")).alias("gone")), "gone")  # a row's own lines
        return self.rows.join(lists.hint("shuffle_hash"), "k", "left")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, hot_times: int = HOT_TIMES) -> tuple[DataFrame, DataFrame]:
    """(decisions, suspects): key and keeper of every key in at least ``min_docs`` documents, and the
    (key, id) rows that were counted."""
    found = _Lines(docs, {"id": id_col, "text": text_col}, least, min_docs, max_bits, hot_times)
    return found.decisions, found.suspects


def _apply(drop: Callable[[object, bytes], bool], ids, texts, least: int) -> tuple[list[str], list[int], list[int]]:
    kept_text, n_lines, n_dropped = [], [], []
    for i, x in zip(ids, texts):
        lines = line_keys(x, least)
        kept = [line for line, key in lines if not (key and drop(i, key))]
        kept_text.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    return kept_text, n_lines, n_dropped


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    keep: list[str] | None = None,
    digest: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Columns ``keep`` (default: the id) with kept_text, n_lines, n_dropped (long).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at
    least ``least`` code points held by at least ``min_docs`` rows lose their lines everywhere but in
    the largest id that holds them.  The other lines stay as they are.  Null or empty text: one
    empty line.  Each row counts as a document, repeated ids too; a null id is below all others and
    keeps a key only if no other id holds it.  ``digest``: kept_sha256 (lowercase hex of the UTF-8
    text) in place of kept_text, so that no text leaves the executors.
    """
    keep = [id_col] if keep is None else keep
    kept = {f"c{i}": c for i, c in enumerate(keep)}  # names that cannot clash
    found = _Lines(docs, {**kept, "id": id_col, "text": text_col}, least, min_docs, max_bits, HOT_TIMES)
    size = found.decisions.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = f"{fields}, {'kept_sha256' if digest else 'kept_text'} string, n_lines long, n_dropped long"
    width = len(keep)

    def finish(batch: pa.RecordBatch, drop) -> pa.RecordBatch:
        text, n, gone = _apply(drop, batch.column(width).to_pylist(), (x.as_py() for x in batch.column(width + 1)), least)
        if digest:
            text = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in text]
        names = [*keep, "kept_sha256" if digest else "kept_text", "n_lines", "n_dropped"]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names)

    if size <= broadcast_bytes:
        keeper = {bytes(r["key"]): r["keeper"] for r in found.decisions.collect()}

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, lambda i, key: key in keeper and keeper[key] != i)

        source = docs.select(*keep, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        return source.mapInArrow(run, out)

    @lean
    def run_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in enumerate(batch.column(width + 2)):
                own = {g["key"]: g["keeper"] for g in x.as_py() or ()}
                yield finish(batch.slice(at, 1), lambda i, key, own=own: key in own and own[key] != i)

    return found.with_lists().select(*kept, "id", "text", "gone").mapInArrow(run_listed, out)
