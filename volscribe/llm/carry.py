"""Running sums and latest values within keys, side by side over ranges of rows.

A window function takes all rows of a key in one task. Here rows are sorted in ranges
that may cut through a key; each range adds up its own, and what earlier ranges hold of
its first key is added afterwards. That is one value for each range and column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from volscribe.llm.common import shuffle_parts
from volscribe.session import written


def _latest(column: pa.Array, start: np.ndarray, before: int | None) -> list[int | None]:
    """For each row the latest value in earlier rows of its key, which begins at ``start``; ``before`` counts for the first key."""
    values, present = np.asarray(column.fill_null(0)), ~np.asarray(column.is_null())
    at = np.maximum.accumulate(np.where(present, np.arange(len(values)), -1))
    at = np.r_[-1, at[:-1]]
    inside = at >= start
    out = np.where(inside, values[at], 0)
    missing = ~inside
    if before is not None:
        out[missing & (start == 0)] = before
        missing &= start != 0
    return pa.array(out, pa.int64(), mask=missing)


def carried(rows: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``sum_c``, for c in ``sums`` the sum from the key's first row to this one, and ``last_c``, for c in ``latest`` the latest value that is not null in rows before this one.

    Rows are in ``order`` within ``key``, an integer that is never null. Sums are 64-bit
    and wrap around. ``rows`` is evaluated twice, so store what is dear.
    """
    own_columns, names = rows.columns, [*(f"sum_{c}" for c in sums), *(f"last_{c}" for c in latest)]
    schema = StructType(rows.schema.fields)
    for name in names:
        schema = schema.add(name, LongType())
    schema = schema.add("range", IntegerType()).add("closing", BooleanType())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, current, state, waiting = TaskContext.get().partitionId(), None, [0] * len(sums) + [None] * len(latest), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield waiting
            keys = np.asarray(batch.column(key))
            new = np.r_[True, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            goes_on = current is not None and keys[0] == current
            if not goes_on:
                state = [0] * len(sums) + [None] * len(latest)
            columns, after = [], []
            for c, before in zip(sums, state, strict=False):
                total = np.cumsum(np.asarray(batch.column(c)).astype(np.int64))
                total = total - np.r_[np.int64(0), total][start] + np.where(start == 0, np.int64(before), np.int64(0))
                columns.append(pa.array(total))
                after.append(total[-1])
            for c, before in zip(latest, state[len(sums) :], strict=True):
                columns.append(_latest(batch.column(c), start, before))
                own = batch.column(c)[-1].as_py()
                after.append(own if own is not None else columns[-1][-1].as_py())
            current, state = keys[-1], after
            closing = np.zeros(len(keys), bool)
            columns += [pa.array(np.full(len(keys), number, np.int32)), pa.array(closing)]
            waiting = pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names, "range", "closing"])
        if waiting is not None:
            closing = np.zeros(waiting.num_rows, bool)
            closing[-1] = True
            yield waiting.set_column(waiting.num_columns - 1, "closing", pa.array(closing))

    ranged = rows.repartitionByRange(shuffle_parts(rows), key, *order).sortWithinPartitions(key, *order).mapInArrow(inside, schema)
    ranged = written(ranged, "ranged")
    # One row for each range.
    held: dict[int, tuple] = {}
    going, values = None, [0] * len(sums) + [None] * len(latest)
    ends = ranged.where("closing").select("range", key, *(f"sum_{c}" for c in sums), *(F.coalesce(c, f"last_{c}") for c in latest))
    firsts = dict(map(tuple, ranged.groupBy("range").agg(F.min(key)).toLocalIterator()))
    for number, last, *own in sorted(map(tuple, ends.toLocalIterator())):
        if going is not None and firsts[number] == going:
            held[number] = (going, values)
            if last == going:
                total = [_wrapped(a + b) for a, b in zip(own, values[: len(sums)], strict=False)]
                own = [*total, *(a if a is not None else b for a, b in zip(own[len(sums) :], values[len(sums) :], strict=True))]
        going, values = last, own

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, keys = np.asarray(batch.column("range")), np.asarray(batch.column(key))
            out = [batch.column(c) for c in own_columns]
            added, there = [np.zeros(len(keys), np.int64) for _ in names], [np.zeros(len(keys), bool) for _ in names]
            for number in np.unique(ranges).tolist():
                if number in held:
                    first, before = held[number]
                    place = (ranges == number) & (keys == first)
                    for column, known, value in zip(added, there, before, strict=True):
                        if value is not None:
                            column[place], known[place] = value, True
            for name, more, known in zip(names, added, there, strict=True):
                column = batch.column(name)
                if name.startswith("sum_"):
                    out.append(pa.array(np.asarray(column) + more))
                else:
                    out.append(pc.coalesce(column, pa.array(more, pa.int64(), mask=~known)))
            yield pa.RecordBatch.from_arrays(out, [*own_columns, *names])

    return ranged.mapInArrow(joined, StructType(schema.fields[:-2]))


def _wrapped(value: int) -> int:
    return (value + 2**63) % 2**64 - 2**63
