"""Source divergence against a plain version that prices every term of every group."""

import re
from collections import Counter, defaultdict

from helpers import LONG, lower_az

from lodeworks.llm.divergence import audit, price

WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top=50):
    rows = [(a or "", b or "", WORDS.findall(lower_az(t or ""))) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= least}
        groups = defaultdict(Counter)
        for _, source, words in own:
            groups[source].update(t for t in words if t in kept)

        def prices(counts):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: prices(c) for s, c in groups.items()}
        q = prices(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    """With columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "z") for r in rows], "lang string, source string, text string, doc_id long, term string, n long, p long, item string")


def test_against_the_plain_version(spark):
    rows = [("en", f"s{i % 4}", f"The red fox {'jumps ' * (i % 5)}and été{i % 3}, naïve-{i}") for i in range(40)]
    rows += [("de", f"s{i % 3}", f"Der Fuchs {'springt ' * (i % 3)}über x{i % 2}") for i in range(20)]
    rows += [("en", "big", "fox " * (30 * i)) for i in range(5)] + [("en", "big", LONG)] * 4
    rows += [("en", None, None), (None, "s1", "fox"), (None, None, None), ("en", "", ""), ("fr", "only", "seul"), ("en", "s0", "fox"), ("en", "s0", "fox"), ("en", "none", "\x00 12 [_]")]
    for least in (1, 3, 30):
        got = sorted(map(tuple, audit(frame(spark, rows), least_docs=least).collect()))
        assert got == plain(rows, least)


def test_ties_go_by_bytes(spark):
    rows = [("en", s, w) for s in ("a", "b") for w in ("x é", "x z")] + [("en", "c", "x"), ("en", "𐀀", "x"), ("en", "�", "x")]
    got = sorted(map(tuple, audit(frame(spark, rows), least_docs=1).collect()))
    assert got == plain(rows, 1)


def test_more_terms_than_are_ranked(spark):
    rows = [("en", "a", " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))), ("en", "b", "other")]
    got = sorted(map(tuple, audit(frame(spark, rows), least_docs=1).collect()))
    assert got == plain(rows, 1) and sum(r[1:3] == ("a", "term") for r in got) == 50


def test_prices_stay_exact_beyond_64_bits(spark):
    counts = [(0, 0, 1), (10**12, 10**15, 10**8), (7 * 10**14, 10**15, 3), (10**15, 10**15, 1)]
    df = spark.createDataFrame(counts, "c long, n long, v long")
    got = [r[0] for r in df.select(price(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in counts]


def test_empty_table(spark):
    assert audit(frame(spark, []).limit(0)).count() == 0
