import helpers
import numpy as np
import pytest
import xxhash

from lodeworks.llm import simhash
from lodeworks.llm.components import connected_components
from lodeworks.llm.fingerprint import fingerprint


def plain(text):
    words = helpers.WORD.findall(helpers.lower_az(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", helpers.TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("radius", range(4))
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    near = [base]
    for flips in range(1, 6):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        near.append(x)
    f = np.unique(np.concatenate(near))
    a, b = simhash.close_pairs(f, f, radius)
    want = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in want)))


@pytest.mark.parametrize("block", [2, 256])
def test_links_of_large_groups_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    f = {int(rng.integers(0, 2**62))}
    for _ in range(60):
        f.add(int(rng.choice(list(f))) ^ (1 << int(rng.integers(0, 62))))
    f = sorted(f)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in f], "fp long"), block).collect()
    want = helpers.components(f, [(a, b) for a in f for b in f if a < b and (a ^ b).bit_count() <= 3])
    assert helpers.components(f, [(r["a"], r["b"]) for r in links]) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 103, 200)}


@pytest.mark.parametrize("table", [helpers.documents, helpers.awkward])
def test_near_duplicates(spark, table):
    docs = table(spark)
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    roots = helpers.components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("x"), "component").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, x=f"{f:016x}", component=least.get(roots[f]))) for i, f in rows)


def test_no_documents(spark):
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="unfinished"):
        connected_components(path, rounds=1)
    assert {r["component"] for r in connected_components(path).collect()} == {0}
    stars = spark.createDataFrame([(9, 1), (1, 8), (5, 5), (4, None), (7, 6)], "a long, b long")
    assert {tuple(r) for r in connected_components(stars, rounds=0).collect()} == {(9, 1), (8, 1), (1, 1), (7, 6), (6, 6)}
    assert connected_components(stars.filter("false"), rounds=0).count() == 0


def test_ids_of_any_type_and_very_long_texts(spark):
    words = " ".join(f"w{i}" for i in range(150_000))
    rows = [("b", words), ("a", words), (None, words), ("c", "x" * 3_000_000), ("d", "")]
    got = {(r["doc_id"], r["component"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c"), ("d", "d")}
