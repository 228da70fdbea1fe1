"""Packing against the tokenizers library and a brute-force best fit."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadspark.llm.packing import Capacity, pack, plan
from leadspark.llm.queries import op8_best_fit


def brute(lengths, cap):
    """One piece after another, longest first, into the fitting sequence whose remainders have the least norm."""
    limits, open_ = cap.limits, []
    for n in sorted(lengths, reverse=True):
        need = cap.demands(n)
        fit = [b for b in open_ if all(x >= y for x, y in zip(b, need))]
        if fit:
            b = min(fit, key=lambda b: (sum((w / m * (x - y)) ** 2 for w, m, x, y in zip(cap.weights, limits, b, need)), b))
        else:
            open_.append(b := list(limits))
        for i in range(3):
            b[i] -= need[i]
    return len(open_)


CAPS = [Capacity(64), Capacity(64, documents=3), Capacity(64, attention=900), Capacity(64, 4, 1500), Capacity(64, 4, 1500, rule="dot"), Capacity(64, weights=(1.0, 0.0, 0.0))]


@pytest.mark.parametrize("cap", CAPS)
def test_plan_keeps_every_capacity_and_is_no_worse(cap):
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 28) for _ in range(rng.randint(1, 150))]
        runs, opened = plan(Counter(lengths), cap)
        seqs = defaultdict(list)
        for n, rs in runs.items():
            assert sum(r.count for r in rs) == lengths.count(n) and [r.rank for r in rs] == [sum(q.count for q in rs[:i]) for i in range(len(rs))]
            for r in rs:
                for k in range(r.count):
                    seqs[r.sequence + k // r.each].append((r.offset + k % r.each * n, n))
        assert set(seqs) == set(range(opened))
        for places in seqs.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            used = [sum(x) for x in zip(*[cap.demands(n) for _, n in places])]
            assert all(u <= m for u, m in zip(used, cap.limits))
        if cap.rule == "norm":
            assert opened <= brute(lengths, cap) + 1


def test_too_long_piece_is_an_error():
    with pytest.raises(ValueError):
        plan({65: 1}, Capacity(64))


def test_hot_length_and_repeated_rows(spark):
    df = spark.createDataFrame([(i % 7, 10) for i in range(3000)] + [(1, 1024)] * 5, "doc_id int, length long").withColumn("offset", __import__("pyspark").sql.functions.lit("x"))
    rows = pack(df.repartition(8), Capacity()).collect()
    assert len(rows) == 3005 and len({(r.sequence_id, r.offset) for r in rows}) == 3005
    assert len({r.sequence_id for r in rows}) == 5 + -(-3000 // 102)


def check(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(texts)
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(got[key], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 1024)))
        assert all(p.length == 1024 for p in parts[1:]) and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length]))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024


def test_query_rows(spark, tmp_path):
    texts = {1: "Plain words here.", 2: None, 3: "", 4: "long text " * 3000, 5: "a<|endoftext|>b", 6: "né 中文 \n\n x", None: "zz", 8: "w " * 511 + "x"}
    spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    check(op8_best_fit(spark, str(tmp_path)).collect(), texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_best_fit(spark, str(tmp_path)).collect() == []


def test_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_best_fit(spark, sf).collect()
    check(rows, texts)
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
