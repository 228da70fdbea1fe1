"""Append columns that Python computes over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


ROWS = 1024  # rows that a Python function holds at once


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that inputs, results and their copies stay small together."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``df`` with the columns ``fields`` appended; columns of the same names are replaced.

    ``make`` runs once per task and returns the function that turns a batch into one list or array per field.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    kept_names = [f.name for f in kept]
    added = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in small(batches):
            columns = [pa.array(values, type=f.type) if not isinstance(values, (pa.Array, pa.ChunkedArray)) else values for values, f in zip(function(batch), added)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept_names] + columns, names=kept_names + [f.name for f in added])

    return df.mapInArrow(run, schema)
