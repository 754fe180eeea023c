"""Kernels over groups of rows, in Arrow batches and without a pandas frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096  # of a batch that leaves


def map_groups(rows: DataFrame, key: str, order: list[str], kernel: Callable, schema: str) -> DataFrame:
    """``kernel(key, columns) -> rows`` for each group; ``columns`` maps names to arrays in ``order``.

    Groups are dealt to a stated number of tasks, which adaptive execution leaves as it is: kernels cost much more
    time than their few bytes tell. Rows are sorted by Spark, which can spill, and a task holds one
    group at a time.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ([] for _ in out)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, found = [], None, []

        def done() -> list[tuple]:
            whole = pa.Table.from_batches(held)
            return list(kernel(last, {name: whole[name].to_numpy() for name in whole.column_names}))

        for part in batches:
            keys = part.column(part.schema.names.index(key)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if held and keys[a] != last:
                    found += done()
                    held = []
                last = keys[a].item()
                held.append(part.slice(a, b - a))
                if len(found) >= ROWS:
                    yield batch(found)
                    found = []
        if held:
            found += done()
        if found:
            yield batch(found)

    return rows.repartition(tasks, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
