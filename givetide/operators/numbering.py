"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from givetide.sources.warehouse import settle


def placed_in_order(df: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows range partitioned and sorted by group and order; rows alike in both are told apart by where they were read."""
    keys = [F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_read")]
    placed = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return placed.select(group, *[c for c in df.columns if c != group])


def _number_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the number from 1 within each stretch of equal values of the first column."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n, group = batch.num_rows, batch.column(0)
        if not n:
            continue
        codes = group.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        lengths = np.diff(np.append(starts, n))
        number = np.arange(1, n + 1) - np.repeat(starts, lengths)
        if seen and group[0].as_py() == last:
            number[: lengths[0]] += seen
        last, seen = group[n - 1].as_py(), int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(number.astype(np.int64))], [*batch.schema.names, "_part", "_nth"])


def number_rows(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "sequence", most: int = (1 << 31) - 1) -> DataFrame:
    """Settled rows with their number (int, from 1) within ``group`` in the given order.

    A window by group would gather each group in one task. Here rows are range partitioned by group and order, so a
    group spreads over as many tasks as its rows need, whatever they have in common; rows that agree in all of ``order``
    are numbered in any order. Each partition numbers its own rows in one pass over Arrow batches, without a further
    shuffle, and a group that goes on in the next partition starts there at the rows it had before, a prefix sum over one
    row for each partition and group. Only groups that cross a border have such an offset: fewer than partitions.

    Null groups are numbered as one. A number beyond ``most`` raises an error.
    """
    placed = placed_in_order(df, group, order)
    shape = StructType([*placed.schema.fields, StructField("_part", LongType()), StructField("_nth", LongType())])
    rows = settle(placed.mapInArrow(_number_in_partition, shape))
    earlier = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_piece")).agg(F.max("_nth").alias("_n"))
    offsets = settle(counts.withColumn("_before", F.sum("_n").over(earlier)).filter("_before is not null").drop("_n"))
    number = F.coalesce("_before", F.lit(0)) + F.col("_nth")
    checked = F.when(number <= most, number).otherwise(F.raise_error(F.lit(f"a {group} has more than {most} rows")))
    same = (F.col("_part") == F.col("_piece")) & F.col(group).eqNullSafe(F.col("_group"))
    return rows.join(offsets, same, "left").withColumn(name, checked.cast("int")).select(*df.columns, name)


#: Parts, by hash of their group, in which rows are counted, and rows of a part up to which a window numbers its groups.
PARTS = 1 << 16
MOST_GATHERED = 200_000


def number_groups(df: DataFrame, group: str, order: Sequence[Column | str], counted: DataFrame, name: str = "sequence", most: int = (1 << 31) - 1, gathered: int = MOST_GATHERED) -> DataFrame:
    """The same numbers as of :func:`number_rows`, settled, for rows of which most are in small groups.

    A window numbers the small groups: its shuffle by group is the one that a join by group needs anyway, so the rows move
    once, where range partitions take a shuffle more, a sampling pass and a pass through Python. Groups are counted before, in parts
    by their hash, from ``counted``, which holds the group of every row to be joined; parts of over ``gathered`` rows go
    through :func:`number_rows`, so no task of the window gathers a larger group of ``counted``.
    """
    part = F.pmod(F.xxhash64(group), F.lit(PARTS))
    sizes = counted.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    crowded = [r["_part"] for r in sizes.filter(F.col("_n") > gathered).limit(1001).collect()]
    if len(crowded) > 1000:
        return number_rows(df, group, order, name, most)
    number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    checked = F.when(number <= most, number).otherwise(F.raise_error(F.lit(f"a {group} has more than {most} rows")))
    small = settle(df.filter(~part.isin(crowded)).withColumn(name, checked.cast("int")))
    return small.unionByName(number_rows(df.filter(part.isin(crowded)), group, order, name, most)) if crowded else small
