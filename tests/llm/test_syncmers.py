"""Closed syncmers against a brute-force version, and the next document by hand."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from leadspark.llm import syncmers
from leadspark.llm.queries import op9_syncmers


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
    return signed(seed)


def brute(text, k=syncmers.K, s=syncmers.S):
    units = re.findall(r"[一-鿿]|[^\s一-鿿]{1,32}", text or "")
    h = [chain([u]) for u in units]
    if not h:
        return []
    if len(h) < k:
        a = 0
        for x in h:
            a = chain([a, x])
        return [(0, a)]
    out = []
    for i in range(len(h) - k + 1):
        inner = [chain(h[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(h[i : i + k])))
    return out


def sketch(found):
    return sorted({h >> 32 for _, h in found})[: syncmers.SKETCH]


def like(a, b):
    least = sorted(set(a) | set(b))[: syncmers.SKETCH]
    return 1.0 if not least else len(set(a) & set(b) & set(least)) / len(least)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), chain([r[1] or ""])))
    out = []
    for k, (key, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, e, n = (sketch(brute(t)) for t in (text, edited, following))
        show = lambda x: "".join(f"{v & 0xFFFFFFFF:08x}" for v in x)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), round(like(a, e), 9), round(like(a, n), 9)))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'v' AS fingerprint", "1 AS _s").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in op9_syncmers(spark, str(tmp_path)).collect()), key=repr)


def texts(rng, n):
    words = ["w%d" % i for i in range(50)] + ["é中文字", "x" * 70, "A,"]
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 6, 7, 8, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 90])
def test_query_against_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(k * 7 - 100, t) for k, t in enumerate(texts(rng, n))]
    if n > 2:
        rows += [(None, None), (None, "b " * 20), (10_000, ""), (55, "tie one"), (55, "tie two"), (3, "same"), (3, "same"), (2**63 - 1, "top"), (-(2**63), "bottom")]
        rows += [(77, f"hot key {i} " * 9) for i in range(60)]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_other_lengths_and_copies(spark):
    docs = spark.createDataFrame([("a b c d e f g h i j k l m",), ("z y a b c d e f g h",)], "t string")
    for k, s in ((3, 1), (3, 2), (2, 1), (5, 2)):
        got = [[(a.start, a.hash) for a in r[0]] for r in docs.select(syncmers.anchors(F.col("t"), k, s)).collect()]
        assert got == [brute("a b c d e f g h i j k l m", k, s), brute("z y a b c d e f g h", k, s)]


def test_plan_has_no_python_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op9_syncmers(spark, str(tmp_path))
    assert df.collect() == []
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def packed(text):
    return sorted((h >> 32 << 32) | at for at, h in brute(text))


def aligned(a, b):
    merged, offsets = sorted([(x >> 32, x & 0xFFFFFFFF, 0) for x in a] + [(x >> 32, x & 0xFFFFFFFF, 1) for x in b]), {}
    for (h, x, i), (g, y, j) in zip(merged, merged[1:]):
        if h == g and i != j:
            d = (y - x) * (1 if i == 0 else -1)
            offsets[d] = offsets.get(d, 0) + 1
    return max(offsets.values(), default=0) / max(len(a), len(b)) if a or b else 1.0


def test_every_anchor_and_its_place(spark, tmp_path):
    rng = random.Random(5)
    long = lambda: [f"u{rng.randrange(10**9)}" for _ in range(3000)]
    a, b = long(), long()
    b[2000:2060] = a[100:160]  # a passage of 60 words in two long texts
    c = a[1500:] + a[:1500]  # the same text with its halves swapped
    rows = [(9, " ".join(c)), (8, " ".join(a)), (7, " ".join(b)), (6, "to be or not to be that is " * 40), (5, "to be or not to be that is " * 50), (4, ""), (3, "short one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_syncmers(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    for k, r in got.items():
        following = texts[max([x for x in texts if x < k], default=max(texts))]
        third = len(texts[k]) // 3
        own, edited, after = (packed(t) for t in (texts[k], texts[k][: len(texts[k]) - third] + following[:third], following))
        assert r.anchors == own and r.edited_anchors == edited
        assert (round(r.aligned_edited, 9), round(r.aligned_next, 9)) == (round(aligned(own, edited), 9), round(aligned(own, after), 9))
    shared = len({h for _, h in brute(" ".join(a[100:160]))})
    assert shared >= 9 and got[8].near_next * len(set(brute(" ".join(a))) | set(brute(" ".join(b)))) > shared - 1
    assert got[8].aligned_next * max(len(got[8].anchors), len(got[7].anchors)) >= shared
    # moved halves: nearly all anchors are common, half of them at one offset
    assert got[9].near_next > 0.98 and 0.4 < got[9].aligned_next < 0.6
