"""The corpus pipeline, stage by stage against brute-force versions."""

import random

import pytest
import test_lines
import test_packing
import test_simhash

import corpus_pipeline
from leadspark.llm import langid, pii

EN = "the cat and the dog of this house were in that garden with a ball for them to see".split()
DE = "der hund und die katze aus dem haus waren in einem garten mit ball für sie nicht".split()


def documents():
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words, lang = (EN, "en") if k % 3 else (DE, "de")
        text = "\n".join(" ".join(rng.choice(words) + rng.choice(["", "", "ly", "ung"]) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 5)))
        rows.append((k, text, lang if k % 7 else None, "s", len(text)))
    base = rows[10][1].split(" ")
    rows += [(100 + c, " ".join([*base[:5], f"new{c}", *base[6:]]), "en", "t", 5) for c in range(5)]  # near copies
    rows += [(200 + c, rows[20][1], "en", None, 1) for c in range(4)]  # copies
    rows += [(300, "1234 !!", "en", "s", 7), (301, None, "en", "s", None), (302, "", None, "s", 0), (None, "the dog without id and with the cat of this house", "en", "s", 3)]
    rows += [(400, "write to ann@mail.example.com or call +1 (555) 010-9999 for the cat and the dog", "en", "s", 4), (401, "the cat and the dog of that garden here " * 500, "en", "s", 2)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'mine' AS score", "7 AS n_lines").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        before = docs.columns
        docs = function(spark, docs, str(folder))
        if name != "best-fit packing":
            assert docs.columns == before
        docs = corpus_pipeline.stage(docs, "test")
        out.append(docs.collect())
    return spark, folder, out


def test_language_stage(stages):
    _, _, (raw, kept, *_) = stages
    left = {r.doc_id for r in kept}
    assert {300, 301, 302}.isdisjoint(left)
    assert {k for k in range(60)} | {400, 401, None} <= left | set()
    assert {r.doc_id: r.text for r in raw if r.doc_id in left} == {r.doc_id: r.text for r in kept}


def test_line_stage(stages):
    _, _, (_, before, after, *_) = stages
    rows = [(r.doc_id, r.text) for r in before]
    _, group = test_lines.brute(rows)
    left = [" ".join(x.lower().split()) for r in after for x in r.text.split("\n") if x.split()]
    assert sorted(group[x] for x in left) == sorted(set(group.values()))
    assert sorted(repr(r.doc_id) for r in before) == sorted(repr(r.doc_id) for r in after)
    assert all(r.n_chars == len(r.text) and r.score == "mine" and r.n_lines == 7 for r in after)


def test_near_duplicate_stage(stages):
    _, _, (_, _, before, after, *_) = stages
    want = {c for _, _, c in test_simhash.brute([(r.doc_id, test_simhash.fingerprint(r.text)) for r in before])}
    assert sorted(map(repr, (r.doc_id for r in after))) == sorted(map(repr, want))
    texts = {r.doc_id: r for r in before}
    assert all(texts[r.doc_id] == r for r in after)


def test_personal_data_stage(stages):
    _, _, (_, _, _, before, after, _) = stages
    old = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    for r in after:
        assert not pii.base_spans(r.text)
        assert r.text == old[r.doc_id] or pii.base_spans(old[r.doc_id]) or "[" in r.text
    assert "[EMAIL]" in next(r.text for r in after if r.doc_id == 400)


def test_packing_stage_and_run(stages):
    spark, folder, out = stages
    test_packing.check(out[5], {r.doc_id: r.text for r in out[4]})
    assert sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(folder)).collect()) == sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in out[5])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert langid.learn(spark.read.parquet(f"{tmp_path}/documents.parquet")) == {}
