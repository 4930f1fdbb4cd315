"""Ordered folds: what depends on the order of a key's rows, without holding them all."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 8192  # rows of an output batch


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """Each key's rows in order through its own fold: start(key) has step(row) and end(), lists of tuples.

    A key's rows are in one partition, sorted by Spark (which spills), and pass in Arrow batches,
    so a task holds a batch and a fold's state, however many rows a key has. Rows are dicts.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches):
        fold, at, held = None, None, []
        for b in batches:
            for row in b.to_pylist():
                if fold is None or row[key] != at:
                    held += fold.end() if fold is not None else []
                    fold, at = start(row[key]), row[key]
                held += fold.step(row)
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        held += fold.end() if fold is not None else []
        yield batch(held)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
