"""Language identification by compression: held-out accuracy and defined cases."""

import zlib

import pytest

from leadspark.llm import langid
from leadspark.llm.queries import op3_compression_language


def test_held_out_accuracy_and_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_compression_language(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
    assert sum(r.accepted for r in rows) / len(rows) > 0.97


def test_labels_of_held_out_rows_are_not_learned(spark):
    keys = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(k, "uno dos tres cuatro cinco" if k in keys else "one two three four five", "es" if k in keys else "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(langid.learn(docs.where(~langid.held_out("doc_id")))) == ["en"]


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (None, "12 34 !!", "fr"), (3, "", None)], [(i, "the cat and the dog of it" if i % 2 else "der hund und die katze ist", "en" if i % 2 else "de") for i in range(40)] + [(100, "das ist und die", None), (100, "das ist und die", None), (101, "the dog of " * 40_000, None), (None, None, "en")]])
def test_defined_cases(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS h").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_compression_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.lang_pred == "und":
            assert r.score == 0 and not r.accepted
    if len(rows) > 10:
        assert {(r.doc_id, r.lang_pred) for r in got if (r.doc_id or 0) >= 100 or r.doc_id is None} == {(100, "de"), (101, "en"), (None, "und")}
