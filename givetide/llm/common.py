"""What several of the operators share: tables, word hashing, positions and running totals over sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from givetide.sources.warehouse import settle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def about(df: DataFrame, most: int, n: int, *key: str) -> DataFrame:
    """About ``most`` of ``n`` rows, chosen by a hash of their key; never a sort of all, nor a share of each partition."""
    return df.filter(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(max(1, -(-n // most)))) == 0)


def forget(settled: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = settled.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows in a total order over range partitions, settled, with ``part_`` and the position ``pos_`` in it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return settle(
        placed.withColumn("part_", F.shiftright("_at", 33))
        .withColumn("pos_", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at")
    )


def running(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same group that come earlier in ``order``.

    Rows are range partitioned by group and order, so that a group of any size spreads over tasks. Each partition
    adds up its own rows; what earlier partitions hold of the group comes from a prefix sum over one row for each
    partition and group.
    """
    placed = in_order(df, [F.col(group), *order])
    own = Window.partitionBy("part_", group).orderBy("pos_").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col("part_").alias("_part"), F.col(group).alias("_group")).agg(F.sum(value).alias("_sum"))
    base = sums.select("_part", "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    return (
        placed.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
        .join(base, (F.col("part_") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
        .withColumn("before", F.col("_base") + F.col("_own"))
        .drop("_base", "_own", "_part", "_group", "part_", "pos_")
    )


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grown(array: np.ndarray, factor: int, n: int) -> np.ndarray:
    while len(array) < n:
        ratio = np.uint64(pow(factor, len(array), 1 << 64))
        array = np.concatenate([array, array * ratio])
    return array


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:end], all at once by prefix sums of a rolling hash."""
    global _powers, _inverse
    n = len(data)
    _powers, _inverse = _grown(_powers, STEP, n + 1), _grown(_inverse, BACK, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * _powers[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * _inverse[starts])


def hash_word(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


class Words:
    """Words of a batch of texts: hashes in text order, and where each text's words begin.

    ``column`` is an Arrow array of strings, ``inside`` holds for each of the 256 bytes whether it belongs to words.
    ASCII letters are lower-cased. A null text has no words.
    """

    def __init__(self, column, inside: np.ndarray):
        self.data, offsets = bytes_of(column)
        self.data = _LOWER[self.data]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = inside[self.data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        here = word[1:-1]
        begins = np.flatnonzero(here & (~word[:-2] | first[:-1]))
        ends = np.flatnonzero(here & (~word[2:] | first[1:])) + 1
        self.hashes = word_hashes(self.data, begins, ends)
        self.bounds = np.searchsorted(begins, offsets)
        self.counts = np.diff(self.bounds)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


_LOWER = np.frombuffer(LOWER, np.uint8)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow array of strings, end to end, and where each begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str, most: int = 1 << 20):
    """Cut record batches so that each holds about ``most`` bytes of a text column, or one longer text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(sizes[end - 1])


class Finder:
    """Finds which of many hashes are among a fixed few: a bit table first, then binary search."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[hashes >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` that hold one of the hashes, and the place of the first such among the given."""
        at = np.flatnonzero(self.table[x >> self.shift])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        place = np.searchsorted(self.hashes, x[at])
        good = place < len(self.hashes)
        good[good] = self.hashes[place[good]] == x[at[good]]
        return at[good], self.order[place[good]]


#: Bytes that are not ASCII white space, and letters, digits and bytes beyond ASCII.
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
WORD_BYTES = np.array([b >= 128 or bytes([b]).isalnum() for b in range(256)])
