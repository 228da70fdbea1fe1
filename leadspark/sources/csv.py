"""CSV input: explicit schemas, missing-value texts, file order."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from csv import reader as csv_reader

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.constants import NULL_TOKENS
from leadspark.functions.scalars import parse_ts
from leadspark.session import stage

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_text, _number, _whole, _flag, _time = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()

LEADS_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in {
    "lead_id": _text, "created_at": _time,
    "source": _text, "lead_segment": _text, "company_size": _text, "industry": _text, "funding_stage": _text, "job_role": _text,
    "account_type": _text, "device_type": _text, "employee_growth_band": _text, "region": _text, "first_touch_channel": _text,
    "employee_count": _number, "company_age_years": _number,
    "business_email": _text, "city": _text, "state": _text, "campaign": _text, "browser": _text,
    "annual_revenue_band": _text, "screen_size": _text,
}.items()])

INTERACTIONS_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in {
    "interaction_id": _text, "lead_id": _text, "session_id": _text, "timestamp": _time,
    "event_name": _text, "page_name": _text, "funnel_stage": _text, "form_completed": _flag,
    "time_on_page_seconds": _number, "scroll_depth_percent": _number, "mouse_activity_score": _number,
    "click_count": _whole, "session_number": T.IntegerType(), "is_return_visitor": _text,
    "form_name": _text, "form_step": _text, "utm_source": _text, "utm_medium": _text,
}.items()])


def null_tokens(c: Column) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(~c.isin(NULL_TOKENS), c)


def _typed(c: Column, kind: T.DataType) -> Column:
    """Cast cleaned text; what does not parse becomes null. Whole numbers may be written 3.0."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return parse_ts(c)
    if isinstance(kind, T.DateType):
        return parse_ts(c).cast("date")
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return c.try_cast("double").try_cast(kind)
    return F.trim(c).try_cast(kind)


def _lines(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Lines of text with the file and the place of the split they stand in, in order within a partition."""
    return spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by the text of their header, which executors read: a task per split, done at its first record.

    The driver learns a name and a header per file, no more than it needs to read them.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[str] = []
        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if block:
                    return
                text.append(value)
                if "\n".join(text).count('"') % 2 == 0:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(text)]), pa.array([file])], names=["header", "file"])
                    return

    # a split for itself, as a task looks no further than its first record
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    try:
        found = _lines(spark, path).mapInArrow(first, "header string, file string").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    out: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: r["file"]):
        out.setdefault(row["header"], []).append(row["file"])
    return out


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, row, text): the records of CSV files whose quoted cells hold line breaks, read split by split.

    A line break ends a record if the quotes before it in the file are even in number. So each split counts its quotes,
    sums over the splits before tell which start inside a cell, and each task cuts its lines into records. What a
    split begins or ends with in the middle of a record is put together afterwards. A quote inside a cell must be
    doubled and the cell quoted. ``row`` counts from 0 in each split; line breaks within cells become ``\\n``.
    """
    lines = _lines(spark, files)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    open_splits = {(r["file"], r["block"]) for r in splits.withColumn("before", before).where("before % 2 = 1").select("file", "block").collect()}  # cells that a split cuts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row, text, odd, head = None, 0, [], False, False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "row", "text", "part"])

        def close(part: str) -> None:
            nonlocal row, text, odd, head
            out.append((*here, -1 if head else row, "\n".join(text), part))
            row, text, odd, head = row + (not head), [], False, False

        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != here:
                    if text:
                        close("middle" if head else "begin")
                    here, row = (file, block), 0
                    head = odd = here in open_splits
                text.append(value)
                odd ^= value.count('"') % 2 == 1
                if not odd:
                    close("end" if head else "whole")
                if len(out) >= 4096:
                    yield flush()
        if text:
            close("middle" if head else "begin")
        if out:
            yield flush()

    pieces = stage(lines.mapInArrow(cut, "file string, block long, row long, text string, part string"), "records")
    broken = pieces.where("part <> 'whole'")
    order = W.partitionBy("file").orderBy("block", "row")
    chained = broken.withColumn("chain", F.sum((F.col("part") == "begin").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = chained.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("p"))  # the pieces of one record
    joined = whole.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["row"].alias("row"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("part = 'whole'").drop("part").unionByName(joined)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, time_column: str = "timestamp", multi_line: bool = True) -> DataFrame:
    """A headed CSV as typed columns plus ``ingest_seq``, which orders rows as the files do.

    Columns are found by each file's own header, so their order is free, file by file, and columns of the schema
    that a file lacks (null if another file has them), or of a file that the schema lacks, are skipped. The input's
    time column is named ``ts``. With ``multi_line`` quoted cells may hold line breaks; large files are read by many
    tasks all the same, at the price of a first pass that counts quotes. Turn it off for files without such cells.
    """
    parts = [_read_alike(spark, header, files, schema, time_column, multi_line) for header, files in headers(spark, path).items() if header] or [
        spark.createDataFrame([], T.StructType([T.StructField("ingest_seq", T.StructType())]))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _names(header: str) -> list[str]:
    """The cells of a header; of equal names the first counts."""
    cells = next(csv_reader([header.replace("\n", " ")]))
    return [c if c not in cells[:k] else f"{c}_{k}" for k, c in enumerate(cells)]


def _read_alike(spark: SparkSession, header: str, files: list[str], schema: T.StructType, time_column: str, multi_line: bool) -> DataFrame:
    """Files with the same header."""
    names = _names(header)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    broken = set()
    if multi_line:
        odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        broken = {r["file"] for r in _lines(spark, files).where(odd % 2 == 1).select("file").distinct().collect()}  # of the files that are listed here
    kinds = {f.name: f.dataType for f in schema.fields}
    found = [c for c in names if c in kinds]

    def typed(raw: DataFrame, *order: Column) -> DataFrame:
        columns = [_typed(null_tokens(F.col(f"`{c}`")), kinds[c]).alias("ts" if c == time_column else c) for c in found]
        return raw.select(F.struct(*order).alias("ingest_seq"), *columns)

    parts = []
    plain = [f for f in files if f not in broken]
    if plain:
        # no line of these has an odd number of quotes, so every line is a record and large files may be split
        raw = spark.read.schema(texts).csv(plain, header=True, escape='"', enforceSchema=True)
        parts.append(typed(raw, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    if broken:
        rows = records(spark, sorted(broken)).where("NOT (block = 0 AND row = 0) AND trim(text) <> ''")
        ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        cells = rows.select(F.struct("file", "block", "row").alias("_at"), F.from_csv("text", ddl, {"escape": '"'}).alias("_cells")).select("_at", "_cells.*")
        parts.append(typed(cells, F.col("_at.file"), F.col("_at.block"), F.col("_at.row")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def load_data(spark: SparkSession, leads_path: str, interactions_path: str) -> tuple[DataFrame, DataFrame]:
    """Leads and interactions in the form the operators expect."""
    return read_csv(spark, leads_path, LEADS_SCHEMA), read_csv(spark, interactions_path, INTERACTIONS_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV, nulls as empty cells, timestamps to the microsecond."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = df.write.option("timestampFormat", micros).option("timestampNTZFormat", micros)
    writer.csv(path, header=True, nullValue="", emptyValue="")
