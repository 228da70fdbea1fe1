"""One query for each operator over its whole table, as the contracts ask."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import byte_bpe, langid, licenses, lines, packing, pages, pii, repair, shards, simhash, syncmers, topk, trie
from leadspark.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(pii.candidates(docs).drop("text"), "pii-candidates")
    decided = pii.decide(found, pii.fit(found))
    base = F.filter("candidates", lambda c: c["base"])

    def count(kind: int):
        return F.size(F.filter(base, lambda c: c["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return decided.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.learn(docs.where(~langid.held_out("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), dictionaries).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=4, radius=4, seed=42)


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, radius=4, least=0.8).select("doc_id", "text", "n_lines", "n_removed")


def op6_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of every document and their places in sequences of 1,024 tokens; ids end with 2."""
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, capacity=1024)
    return packing.pack(pieces, packing.Capacity(tokens=1024, documents=1024, attention=1024**2))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(_table(spark, sf_dir, "documents"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    placed = shards.shard(docs, 40, size, shards.spread_key("doc_id"))
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(repair.repair(repair.damage(_table(spark, sf_dir, "conversations")), "times"))


def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_positional_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", *[f.name for f in licenses.FIELDS])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_paths": op1_host_paths,
    "op2_weak_pii": op2_weak_pii,
    "op3_compression_language": op3_compression_language,
    "op4_simhash": op4_simhash,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_histogram_topk": op6_histogram_topk,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit": op8_best_fit,
    "op9_syncmers": op9_syncmers,
    "op10_histogram_shards": op10_histogram_shards,
    "op11_survivors": op11_survivors,
    "op12_zfast_trie": op12_zfast_trie,
    "op13_positional_licenses": op13_positional_licenses,
}
# vectors that take part, their integers, and every pair scored; each id counts once
OP6_SQL = """
WITH v AS (
  SELECT vec_id, min([floor(64 * CAST(x AS DOUBLE)) for x in embedding]) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x) OR abs(x) > 1048576]) = 0
  GROUP BY vec_id
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

# CRC-32 of a text of ASCII characters
_CRC32 = (
    "xor(4294967295, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT for x in string_split({0}, '')], "
    "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"
)
_END = "right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"


def _step(kind: str, source: int, role: str = "") -> str:
    """One edit after the ``source``-th of four states ``a``: (cost c, letters e, repaired o, its turns n)."""
    cost, letter, line = {
        "D": ("3", "D", ""), "I": ("2", "I", f"'{role}:'"),
        "K": ("CAST(r.fault = 3 AS INT)", "K", "r.role || ':' || r.text"), "R": ("2 + CAST(r.fault = 3 AS INT)", "R", f"'{role}:' || r.text"),
    }[kind]
    s = f"a[{source}]"
    out = f"{s}.o || CASE WHEN {s}.n > 0 THEN chr(10) ELSE '' END || {line}" if line else f"{s}.o"
    return f"{{'c': {s}.c + {cost}, 'e': {s}.e || '{letter}', 'o': {out}, 'n': {s}.n + {int(bool(line))}}}"


def _best(*found: str) -> str:
    return f"list_sort([x for x in [{', '.join(found)}] if x.c < 1000000000])[1]"


# the four states: nothing kept, after the system turn, after a user turn, after an assistant turn; unreached ones cost a billion
_NONE = "{'c': 1000000000, 'e': '', 'o': '', 'n': 0}"
_USER = [1, 2, 4]


def _kept(condition: str, edit: str) -> str:
    return f"CASE WHEN {condition} THEN {edit} ELSE {_NONE} END"


_SOUND = "r.fault NOT IN (1, 2)"
_ROW = ", ".join([
    _step("D", 1),
    f"coalesce({_best(_step('D', 2), _kept(_SOUND + ' AND r.x = chr(115)', _step('K', 1)))}, {_NONE})",
    f"coalesce({_best(_step('D', 3), *[_kept(_SOUND + ' AND r.x = chr(117)', _step('K', s)) for s in _USER], *[_kept(_SOUND, _step('R', s, 'user')) for s in _USER])}, {_NONE})",
    f"coalesce({_best(_step('D', 4), _kept(_SOUND + ' AND r.x = chr(97)', _step('K', 3)), _kept(_SOUND, _step('R', 3, 'assistant')))}, {_NONE})",
])
# inserts after a row: first to a user turn, then to an assistant turn
_INSERT_USER = f"[a[1], a[2], {_best('a[3]', *[_step('I', s, 'user') for s in _USER])}, a[4]]"
_INSERT_ASSISTANT = f"[a[1], a[2], a[3], {_best('a[4]', _step('I', 3, 'assistant'))}]"


def _apply(state: str, *steps: str) -> str:
    """``steps`` one after the other, each an expression over the states ``a``."""
    for step in steps:
        state = f"list_transform([{state}], lambda a: {step})[1]"
    return state


_START = _apply(f"[{{'c': 0, 'e': '', 'o': '', 'n': 0}}, {_NONE}, {_NONE}, {_NONE}]", _INSERT_USER, _INSERT_ASSISTANT)
OP11_SQL = f"""
WITH kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, k, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copy(k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS place FROM damaged
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen FROM placed
), judged AS (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN {_END} = '' THEN 1 WHEN seen > 1 THEN 2 WHEN {_END} NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM repeats
), grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'x': x, 'fault': fault, 'role': role, 'text': text}} ORDER BY place) AS rows
  FROM judged GROUP BY conv_id
), decoded AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda a, r: {_apply('a', '[' + _ROW + ']', _INSERT_USER, _INSERT_ASSISTANT)}, {_START}) AS a FROM grouped
), ended AS (
  SELECT *, list_sort([x for x in [a[1], a[4]] if x.c < 1000000000])[1] AS w FROM decoded
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost,
  coalesce(w.e, '') AS audit, sha256(coalesce(w.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT *, CAST({_CRC32.format("CAST(c AS VARCHAR)")} % 6 AS BIGINT) AS h FROM own
), rebuilt AS (
  SELECT o.c, list_concat(coalesce(p.l[1:h], []), o.l[h + 1:]) AS l FROM headed o LEFT JOIN own p ON p.c = o.c - o.c % 100
), nodes AS (
  SELECT l[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt) GROUP BY ALL
), children AS (
  SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.k[d].x) ELSE 0 END AS saves
  FROM nodes n LEFT JOIN children c ON c.k = n.k
), above AS (
  SELECT k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT k, n_children, saves, unnest(range(0, d + 1)) AS e FROM valued) GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN above a ON a.k = v.k LEFT JOIN nodes p ON v.d > 0 AND p.k = v.k[1:v.d - 1]
"""

ORACLES: dict[str, str] = {"op6_histogram_topk": OP6_SQL, "op11_survivors": OP11_SQL, "op12_zfast_trie": OP12_SQL}
