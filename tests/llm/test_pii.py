"""Personal data: base spans against the plain patterns, reliabilities on planted votes, defined cases."""

import hashlib
import random
import re

import numpy as np

from leadspark.llm import pii
from leadspark.llm.queries import op2_weak_pii


def plain(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    bits = ["a", "é", "@", ".", "-", "b.c", "@x.y", "1", "23", "4.5", "256", ".", " ", "+", "(", ")", "%", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 123-4567", "10.0.0.1", "_", "²", "٣"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(text) == plain(text), repr(text)
    long = "9" * 50_000 + " " + "1a." * 20_000 + " " + "a" * 100_000 + "@ " + "+1" + "(" * 50_000
    assert pii.base_spans(long) == []


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.7, 0.85, 0.6, 0.8])
    votes = np.where(rng.random((20_000, 6)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    prior, got, p = pii.expectation_maximisation(np.zeros(len(rows), int), rows, counts.astype(float))
    assert abs(prior[0] - 0.3) < 0.03 and np.abs(got[0] - right).max() < 0.04


ROWS = [
    (1, "Write to ann.lee@mail.example.com or call +1 (555) 010-9999, phone (555) 123-4567 too."), (2, None), (3, ""), (3, ""), (None, "host 10.1.2.3 login"),
    (4, "card 4539 1488 0343 6467 and order 1234567890123456"), (5, "mail joe (at) site (dot) org please"), (6, "clean text with 2024 and 3.14"), (7, "x" * 70_000 + " a@b.co"),
] + [(100 + i, f"contact m{i}@mail.example.com or phone +49 (30) 555-01{i:02d}; server 10.0.0.{i}") for i in range(60)]


def test_query_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'z' AS spans", "0 AS candidates").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op2_weak_pii(spark, str(tmp_path)).collect(), key=repr)
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        base = plain(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in range(4))
        strings = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(strings).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(strings) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
    assert {r.doc_id: r.spans for r in got}[6] == ""


def test_redaction_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = pii.candidates(docs)
    out = {r.doc_id: r.text for r in pii.redact(pii.decide(found, pii.fit(found))).collect()}
    assert "[EMAIL]" in out[1] and "[PHONE]" in out[1] and "@" not in out[1] and out[6] == dict(ROWS)[6] and out[2] is None
    assert all("@" not in (t or "") for t in out.values())
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_weak_pii(spark, str(tmp_path)).collect() == []
