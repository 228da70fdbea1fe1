"""Prefix trie: brute force by prefixes, SQL of another engine on odd rows, chains, copies, defined cases."""

import random

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from leadspark.llm import trie
from leadspark.llm.queries import OP12_SQL, op12_zfast_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def against_sql(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS id", "2 AS size").repartition(3).write.parquet(f"{path}/conversations.parquet")
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert differences(op12_zfast_trie(spark, str(path)), con, OP12_SQL) == []


def test_odd_rows_match_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, t, t]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "a", "b", "é" * 3, "x" * 9000])) for c in [None, -250, *range(40), 200, 201, 305] for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(4)]  # copies
    rows += rows[:5]
    against_sql(spark, rows, tmp_path)


def test_chains_and_long_conversations_match_sql(spark, tmp_path):
    # each conversation leaves the one before a turn later; one goes on over several blocks
    rows = [(c, t, "user", f"step {t}" if t < c - 600 else f"own {c} {t}") for c in range(600, 624) for t in range(c - 600 + 2)]
    rows += [(900, t, "user", str(t % 7)) for t in range(260)] + [(c, t, "user", str(t % 7)) for c in (1000, 1100) for t in range(130)]
    against_sql(spark, rows, tmp_path)


def test_blocks_do_not_show(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng = random.Random(8)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(300, 330) for t in range(rng.randint(1, 14))]
    against_sql(spark, rows, tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_zfast_trie(spark, str(tmp_path)).collect() == []


def test_conversation_without_turns_ends_at_the_root(spark, tmp_path):
    # h is 5 for some id without a group's first, so its only turn goes
    import zlib

    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    against_sql(spark, [(c, 0, "user", "gone")], tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_nodes_against_sorted_prefixes(spark, seed):
    """The compacted nodes are the branching and ending prefixes; their handles lie at the two-fattest depths."""
    rng = random.Random(seed)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 11))) for _ in range(60)}
    turns = [(c, d, x.encode() if d else None, 1) for c, t in enumerate(sorted(texts)) for d, x in enumerate(" " + t)]
    paths = trie.stage(trie.prefixes(spark.createDataFrame(turns, "conv_id long, depth long, token binary, chars long")), "paths")
    got = trie.build(paths).collect()
    prefixes = {t[:k] for t in texts for k in range(len(t) + 1)}
    kept = {p for p in prefixes if p and (p in texts or sum(p + x in prefixes for x in "ab") == 2)}
    words = sorted(texts)
    assert {words[r.conv_id][: r.high] for r in got} == kept and len(got) == len(kept)
    for r in got:
        parent = max((words[r.conv_id][:k] for k in range(r.high) if words[r.conv_id][:k] in kept or k == 0), key=len)
        assert r.low == len(parent)
    fat = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 41)], "low long, high long").select("low", "high", trie.fattest("low", "high").alias("f"))
    for r in fat.collect():
        assert r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x)


def test_no_text_is_shuffled(spark):
    turns = trie.tokens(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    assert "text" not in str(turns._jdf.queryExecution().optimizedPlan().output()) and turns.where(F.col("place") < 1).isEmpty()
