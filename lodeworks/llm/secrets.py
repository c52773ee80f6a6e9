"""Secret scans: three fixed patterns, and character-class entropy over sliding windows.

The patterns find what has a known form.  The entropy method then looks at candidate strings, runs of
at least ``WIDTH`` characters of the base64 and hex alphabets: a window of ``WIDTH`` characters slides
over each, its Shannon entropy kept up by the counts of the one character that enters and the one
that leaves.  Each window has a class of its own: hex, base64 (both cases), lower or upper case with
digits (base36, base32).  Windows that reach the threshold of their class make spans, unless the
allow-list knows the string; one without a digit or without a letter has no class.  Spans that lie inside a pattern's span are not repeated.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: patterns, least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # maximal runs, as the plain pattern finds them
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Characters in a window.
WIDTH = 20
#: Least entropy (bits a character) of a window by its class.
THRESHOLDS = {"hex": 3.0, "base64": 3.7, "lower": 3.4, "upper": 3.3}
_LEAST = min(THRESHOLDS.values())
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WIDTH)
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WIDTH + 1)]
#: A word, a number, or both in less than ``WIDTH`` characters (python3, 2nd).
_WORD = r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+|(?:[a-z]{1,15}|[A-Z]{1,15}|[A-Z][a-z]{1,14})[0-9]{1,4}|[0-9]{1,15}(?:[a-z]{1,4}|[A-Z]{1,4}))"
#: Strings that are no secrets though they look random: whole-string patterns.  Repeated groups are possessive,
#: so a candidate of many megabytes is matched in constant memory.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[A-Za-z]++(?:[-_/][A-Za-z]++)*+",  # words and paths of words
    r"[0-9]++(?:[-_/][0-9]++)*+",  # numbers, dates, phone numbers
    r"[-_/+=]*+{0}(?:[-_/+=]++{0})*+[-_/+=]*+".format(_WORD + "(?![A-Za-z0-9])"),  # words and numbers in a row, paths
    r".*(?i:example|placeholder|changeme|your[-_]?(key|token|secret)|x{6,}|0{8,}).*",
    r".*(?:abcdefghij|ABCDEFGHIJ|0123456789).*",  # alphabets
)


def windows_of_entropy(text: str, width: int = WIDTH) -> Iterator[float]:
    """Entropy in bits a character of every window, by incremental counts; a window at a time, so a text of
    any length takes no memory."""
    counts: dict[str, int] = {}
    total, bits = 0.0, math.log2(width)  # total: sum of n log2 n
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= width:
            gone = text[i - width]
            n = counts[gone]
            total += _LOG[n - 1] - _LOG[n]
            counts[gone] = n - 1
        if i >= width - 1:
            yield bits - total / width


#: digit, lower case, upper case, lower and upper case of hex digits: what a character counts as.
_SORTS = {c: (c.isdigit(), c.islower(), c.isupper(), c in "abcdef", c in "ABCDEF") for c in map(chr, range(128))}


def window_classes(text: str, width: int = WIDTH) -> Iterator[str | None]:
    """The class of ``THRESHOLDS`` that every window is judged by, by counts kept up like the entropy's; None:
    not judged."""
    digits = lower = upper = low_hex = high_hex = 0
    for i, c in enumerate(text):
        d, a, b, x, y = _SORTS[c]
        digits, lower, upper, low_hex, high_hex = digits + d, lower + a, upper + b, low_hex + x, high_hex + y
        if i >= width:
            d, a, b, x, y = _SORTS[text[i - width]]
            digits, lower, upper, low_hex, high_hex = digits - d, lower - a, upper - b, low_hex - x, high_hex - y
        if i >= width - 1:
            if not digits or not (lower or upper):
                yield None
            elif width in (digits + low_hex, digits + high_hex):
                yield "hex"
            else:
                yield "base64" if lower and upper else "lower" if lower else "upper"


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Merged windows of high entropy in candidates that the allow-list does not know."""
    spans = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if run.isalpha() or allowed.fullmatch(run):
            continue
        start = m.start()
        for i, (h, kind) in enumerate(zip(windows_of_entropy(run), window_classes(run))):
            if h < _LEAST or kind is None or h < THRESHOLDS[kind]:
                continue
            a, b = start + i, start + i + WIDTH
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def outside(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` (ascending) that lie inside no span of ``base``: one sweep over both, so a
    long text with many of each takes no pairs."""
    held = sorted((s, e) for _, s, e in base)
    out, at, reach = [], 0, -1
    for a, b in spans:
        while at < len(held) and held[at][0] <= a:
            reach = max(reach, held[at][1])
            at += 1
        if reach < b:
            out.append((a, b))
    return out


def find_secrets(text: str | None, allowed: re.Pattern) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): kind, start, end in code points, end exclusive, in order of start."""
    text = text or ""
    base = base_spans(text)
    more = [("entropy", a, b) for a, b in outside(entropy_spans(text, allowed), base)]
    return _ordered(base), _ordered(base + more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(id, base, found): arrays of (kind, start, end) of each whole text; null and empty have none.

    ``base`` are the patterns' spans alone, ``found`` those and the entropy method's.  ``allow``:
    whole-string patterns of candidates to suppress; the patterns' spans always stay.  Spans that start
    together are in order of kind (assign, access, hex, entropy), then of end.  Rows with null or
    repeated ids, of any type, and repeated rows are scanned like any other; an empty table gives no
    rows; other columns are ignored.
    """
    pattern = "|".join(f"(?:{x})" for x in allow) or r"(?!)"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern)
        for batch in batches:
            both = [find_secrets(x.as_py(), allowed) for x in batch.column(1)]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "base", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, base {spans}, found {spans}")


def joined(spans):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

