"""Arrow batches of rows sorted by a key, taken key by key, and rows put into batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST_ROWS, MOST_BYTES = 4096, 8 << 20


def schema_of(columns: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(columns))


def values(column: pa.Array) -> list:
    if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
    return column.to_pylist()


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Each key with its rows' columns. A key's rows follow each other, from one batch into the next too."""
    last, held = None, None
    for batch in batches:
        columns = {n: values(c) for n, c in zip(batch.schema.names, batch.columns)}
        keys = columns[key]
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
        for lo, hi in zip(cuts, cuts[1:]):
            own = {n: v[lo:hi] for n, v in columns.items()}
            if held is not None and keys[lo] == last:
                for n, v in own.items():
                    held[n] += v
                continue
            if held is not None:
                yield last, held
            last, held = keys[lo], own
    if held is not None:
        yield last, held


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of any number of keys in common batches; a row of more than MOST_BYTES ends one."""
    some: list[tuple] = []
    size = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
    for r in rows:
        some.append(r)
        size += sum(len(v) for v in r if v.__class__ is bytes)
        if len(some) >= MOST_ROWS or size >= MOST_BYTES:
            yield make()
            some, size = [], 0
    if some:
        yield make()
