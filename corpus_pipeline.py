"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet to the shared folder and read again as the
next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import langid, lines, pii, simhash
from leadspark.llm.queries import packed
from leadspark.session import fresh_path, scratch, stage, unstage


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as of the text now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with a narrow margin go."""
    dictionaries = langid.learn(docs.where(~langid.held_out("doc_id")))
    judged = langid.identify(docs, dictionaries, names=("_lang", "_score", "_accepted"))
    return judged.where("_accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand in an earlier one or earlier in itself, nearly or exactly."""
    return _counted(lines.dedup_lines(docs, counts=False)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id."""
    return simhash.keep_one(docs, words=4, radius=4, seed=42)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    found = stage(pii.candidates(docs, name="_candidates"), "pii-candidates")
    decided = pii.decide(found, pii.fit(found, "_candidates"), "_candidates", "_spans")
    return _counted(pii.redact(decided, spans="_spans")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1,024 tokens."""
    return packed(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

# compression, SimHash and tokenizers have no SQL; tests/llm/test_pipeline.py checks each stage by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and its input, is deleted once its own table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES[:-1]):
        before, path = docs, fresh_path(spark, f"stage-{k}")
        with scratch(spark):
            docs = stage(function(spark, before, sf_dir), f"stage-{k}", path)
        if k:
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
