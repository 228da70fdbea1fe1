"""Byte-level BPE against the tiktoken library, and an exact round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from leadspark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def right(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(bpe, text):
    import numpy as np

    return np.frombuffer(bpe.encode(text), "<u4").tolist()


ALPHABETS = ["ab", "a ", " \n\t", "the' llreve sdm", "aé中1 .\n", "0123456789abcdef", "thationing ", "ß'ľL ９١²"]


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(8192, 48), (5, 3), (16, 1), (1, 2)])
def test_trees_of_any_depth_agree_with_the_library(ranks, right, leaf_chars, leaf_bytes):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN, leaf_chars, leaf_bytes)
    rng = random.Random(7)
    for round_ in range(400):
        text = "".join(rng.choice(ALPHABETS[round_ % len(ALPHABETS)]) for _ in range(rng.randrange(0, 200)))
        assert ids(bpe, text) == right(text), repr(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_long_pieces_and_runs(ranks, right):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for text in ["a" * 20_011, " " * 9_000 + "x", "\n" * 8_193, "".join(rng.choice("etaoin") for _ in range(30_000)), "né" * 5_000, "don't we'll " * 3_000]:
        assert ids(bpe, text) == right(text)


def test_query_rows(spark, right, tmp_path):
    rows = [(1, "Hello there, it's 2024."), (2, None), (3, ""), (3, ""), (None, "née  \n x"), (5, "word " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens").write.parquet(f"{tmp_path}/documents.parquet")
    from leadspark.llm.queries import op7_byte_bpe

    got = sorted(map(tuple, op7_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for key, text in rows:
        t = right(text or "")
        want.append((key, len(t), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in t)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from leadspark.llm.queries import op7_byte_bpe

    assert op7_byte_bpe(spark, str(tmp_path)).collect() == []
