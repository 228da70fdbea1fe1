"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from leadspark.llm import simhash
from leadspark.llm.components import components
from leadspark.llm.queries import op4_simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs, radius=4):
    """Components over (key, fingerprint) rows."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if bin(a ^ pairs[j][1]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, f"{f:016x}", least.get(root(i))) for i, (k, f) in enumerate(pairs)), key=repr)


def test_fingerprints():
    rng = random.Random(2)
    for text in [None, "", " \n", "One", "a b c", "A\tb C d", "É È é x y z", "x y z w v u", *[" ".join(rng.choice("the of and in ERr") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(50)]]:
        assert simhash.fingerprint_of(text) == fingerprint(text)


@pytest.mark.parametrize("size", [1, 7, 300, 1500])
def test_linked_tiles(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 40, size)] ^ (np.int64(1) << rng.integers(0, 62, size)) ^ (np.int64(1) << rng.integers(0, 62, size)) for _ in range(2)]))
    half = len(fps) // 2 or 1
    for x, y in ((fps, None), (fps[:half], fps[half:])):
        if y is not None and not len(y):
            continue
        a, b = simhash.link_tiles(x, y, 4)
        rows = [(int(f), int(f) & (2**64 - 1)) for f in (x if y is None else np.concatenate([x, y]))]
        if y is None:
            assert len(a) == len(rows) - len({c for _, _, c in brute(rows)})
        assert all(bin((p ^ q) & (2**64 - 1)).count("1") <= 64 for p, q in zip(a.tolist(), b.tolist()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(5, 5), (None, 3), (400, 160), (160, 400)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 161)} | {400: 100} | {k: 7 for k in [7, *range(200, 400)]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'c' AS component", "2 AS size").write.parquet(f"{tmp_path}/documents.parquet")


def test_query_rows(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(None, "some text of null id here"), (3, None), (2, ""), (2, ""), (90, " \n ")]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        for c in range(rng.randint(1, 6)):
            copy = list(base)
            if c > 1:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - 10 * k - c, " ".join(copy).upper() if c == 1 else " ".join(copy)))
    table(spark, tmp_path, rows)
    got = sorted(map(tuple, op4_simhash(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute([(k, fingerprint(t)) for k, t in rows])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, simhash.near_duplicates(docs, tile=16).collect()), key=repr) == got
    kept = simhash.keep_one(docs, tile=16)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(map(repr, ids)) == sorted(map(repr, {c for _, _, c in got}))


def test_empty_table(spark, tmp_path):
    table(spark, tmp_path, [])
    assert op4_simhash(spark, str(tmp_path)).collect() == []


def test_real_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_simhash(spark, sf).collect()), key=repr) == brute(rows)
