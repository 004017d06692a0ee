"""Running sums over rows in order, in two levels, so that no group is one task.

Rows are range-partitioned by group and order, sorted and summed within each partition in the same
stage, and written once. Each partition's first and last rows then say what its last group has come to; a group
that goes on in the next partition brings that along. So a group may hold any share of the rows, and what
is gathered on the driver is two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..shipping import ship
from ..storage import written

ALL = (1 << 64) - 1
LOW = (1 << 32) - 1


def wrapped_sum(a: Column, b: Column) -> Column:
    """Sum of two longs modulo 2**64, by halves, as ``+`` refuses to overflow."""
    low = a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def wrapped_less(a: Column, b: Column) -> Column:
    """``a`` less ``b`` modulo 2**64."""
    return wrapped_sum(wrapped_sum(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def _signed(x: int) -> int:
    return (x & ALL) - (1 << 64) if x & 1 << 63 else x & ALL


def free_names(columns: list[str], *stems: str) -> list[str]:
    """Names that are not among ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem = "_" + stem
        taken.add(stem.lower())
        out.append(stem)
    return out


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether it differs from the one before in any column; nulls are equal."""
    out = np.zeros(max(len(columns[0]) - 1, 0) if columns else 0, bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out |= differ.to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _local(group: list[str], sums: list[str], n_out: int, names: list[str]):
    """Adds each group's sums so far within the partition, the partition, the row's place, whether the row is of its first group, and whether it is its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, first, before, carried, held = TaskContext.get().partitionId(), 0, True, None, np.zeros(len(sums), "i8"), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
            keys = [pa.concat_arrays([b, k]) for b, k in zip(before, keys, strict=True)] if before else [pa.concat_arrays([k.slice(0, 1), k]) for k in keys]
            new = _changes(keys) if keys else np.zeros(n, bool)
            before = [k.slice(len(k) - 1) for k in keys]
            starts = np.flatnonzero(new)
            own_start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for k, name in enumerate(sums):
                v = pc.fill_null(batch.column(batch.schema.get_field_index(name)), 0).to_numpy(zero_copy_only=False).astype("i8")
                total = np.cumsum(v)
                lead = np.r_[0, total][:-1]  # sum before each row
                local = np.where(own_start < 0, total + carried[k], total - lead[np.maximum(own_start, 0)])
                carried[k] = local[-1]
                out.append(pa.array(local))
            head = np.full(n, False)
            if first:
                head[: starts[0] if len(starts) else n] = True
                first = not len(starts)
            marks = [pa.array(np.full(n, part, "i4")), pa.array(np.arange(at, at + n)), pa.array(head)]
            at += n
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(held[0]), False))], names=names)
            held = [*batch.columns[:n_out], *out, *marks]
        if held is not None:
            last = np.arange(len(held[0])) == len(held[0]) - 1
            yield pa.RecordBatch.from_arrays([*held, pa.array(last)], names=names)

    return run


def running(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, str], wraps: bool = False, name: str = "running") -> DataFrame:
    """``df`` with the running sums of long columns, from a group's first row to the row itself.

    ``sums`` names each new column and the column that it sums; null counts as 0. ``order`` should tell rows
    apart: rows that are equal in it and in ``group`` lie in one partition, in any order. With ``wraps`` sums are
    modulo 2**64, else one beyond a long is an error where partitions meet. Null groups are one group.
    """
    spark = df.sparkSession
    ship(spark)
    part, at, head, tail = free_names([*df.columns, *sums], "part", "at", "head", "tail")
    keys = [F.col(g).asc_nulls_first() for g in group] + list(order)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = list(df.schema.fields)
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in sums], T.StructField(part, T.IntegerType()), T.StructField(at, T.LongType()), T.StructField(head, T.BooleanType()), T.StructField(tail, T.BooleanType())])
    scanned = written(ordered.mapInArrow(_local(group, list(sums.values()), len(kept), schema.names), schema), name)
    key = F.struct(*group) if group else F.lit(0)
    ends = scanned.where(F.col(tail) | (F.col(at) == 0)).select(part, at, tail, key.alias("key"), F.col(head).alias("whole"), F.struct(*sums).alias("sums"))
    bring, last, rows = [0] * len(sums), None, []
    for end in sorted(ends.collect(), key=lambda r: (r[part], r[at])):  # two rows a partition
        if end[at] == 0:
            bring = bring if last == (end["key"],) else [0] * len(sums)
            if any(bring):
                rows.append((end[part], *bring))
        if end[tail]:
            bring = [x + (b if end["whole"] else 0) for x, b in zip(end["sums"], bring, strict=True)]
            bring = [_signed(x) for x in bring] if wraps else bring
            last = (end["key"],)
    brought = [f"{c}_brought" for c in sums]
    carry = spark.createDataFrame(rows, T.StructType([T.StructField(part, T.IntegerType()), *[T.StructField(c, T.LongType()) for c in brought]]))
    joined = scanned.join(F.broadcast(carry), part, "left")
    add = wrapped_sum if wraps else lambda a, b: a + b
    return joined.select(*df.columns, *[F.when(F.col(head) & F.col(b).isNotNull(), add(F.col(c), F.col(b))).otherwise(F.col(c)).alias(c) for c, b in zip(sums, brought, strict=True)])
