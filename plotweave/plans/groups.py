"""Work on whole groups of rows in Python, many small groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Walk = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray | pa.Array]]


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the keys of a sorted batch change, its first row not counted."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        column = batch.column(key)
        changed |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed) + 1


def over_groups(rows: DataFrame, keys: list[str], order: list[str], walk: Walk, schema: str) -> DataFrame:
    """``walk`` over whole groups of rows with equal ``keys``, each sorted by ``order``.

    ``walk`` gets the columns of some groups and where each group starts, and returns the columns of ``schema``. Groups
    come as they are read, so a task holds one batch and one group; there is no call a group. Keys are not null.
    """
    names = schema_names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
            for batch in whole:
                columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
                found = walk(columns, np.concatenate([[0], _starts(batch, keys)]))
                out = pa.RecordBatch.from_arrays([found[n] if isinstance(found[n], pa.Array) else pa.array(found[n]) for n in names], names)
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
                yield from done(held)
                held = []
            starts = _starts(batch, keys)
            if len(starts):
                last = int(starts[-1])
                yield from done([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from done(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def schema_names(schema: str) -> list[str]:
    """The names of a schema like ``a long, b double``."""
    return [part.split()[0] for part in schema.split(",")]
