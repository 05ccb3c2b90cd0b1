"""Row functions in Python whose memory does not grow with the number of rows that Spark sends at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE = 1_000_000  # bytes of rows that a task holds as Python objects


def rows_to_rows(rows: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that make gives of each row's columns. Long inputs are opened, and outputs handed on, about PIECE bytes at a time."""
    shape = to_arrow_schema(StructType.fromDDL(schema))
    piece = PIECE

    def packed(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ((),) * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            step = max(1, batch.num_rows * piece // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, step).columns), strict=True):
                    for out in make(*row):
                        held.append(out)
                        size += 50 + sum(len(x) for x in out if isinstance(x, str))
                        if size > piece:
                            yield packed(held)
                            held, size = [], 0
            yield packed(held)

    return rows.mapInArrow(run, schema)
