"""Cutting Arrow batches so that what a Python worker holds at once is bounded in bytes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, limit: int = 4 << 20):
    """Slices of the batch with at most so many rows, and bytes in the column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == rows or held + n > limit):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def free_name(df, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df, column: str, make, names: list[str], types: list, rows: int = 512, limit: int = 4 << 20):
    """df with computed columns behind its own. make() runs once for each task and returns a function
    from a list of values of `column` to a list of columns (sequences as long)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*df.schema.fields, *[StructField(n, t) for n, t in zip(names, types, strict=True)]])
    at = df.columns.index(column)
    width = len(df.columns)

    def run(batches):
        kinds = [f.type for f in to_arrow_schema(StructType(schema.fields[width:]))]
        work = make()
        for batch in batches:
            for part in slices(batch, at, rows, limit):
                made = work(part.column(at).to_pylist())
                arrays = [*part.columns, *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)
