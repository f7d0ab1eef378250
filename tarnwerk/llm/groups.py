"""Group-wise Arrow work without one call per group: sort within partitions, cut at key changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sliced(batches, keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for runs of equal values in the first ``keys`` columns, which hold integers without nulls."""
    held: list[pa.Table] = []
    held_key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        table = pa.Table.from_batches([b])
        for s, e in zip(starts, starts[1:]):
            key = tuple(int(c[s]) for c in columns)
            if key != held_key:
                if held:
                    yield held_key, pa.concat_tables(held)
                held, held_key = [], key
            held.append(table.slice(s, e - s))
    if held:
        yield held_key, pa.concat_tables(held)


def map_groups(df: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``run`` on the rows of each distinct value of ``keys`` (integers); a group must fit in memory."""
    rest = [c for c in df.columns if c not in keys]
    n = len(keys)

    def go(batches):
        for key, table in sliced(batches, n):
            made = run(key, table)
            if made is not None and made.num_rows:
                yield made

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)
