"""Best-fit-decreasing packing of indivisible groups of documents into shards."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.llm.common import in_order
from givetide.sources.warehouse import settle

#: Items per shard that the packing sees at most, besides groups that are large on their own.
GRAIN = 256


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: items by falling size, each into the bin with the least room that still holds it.

    Bins are kept in a sorted structure by remaining room, so that the tightest is found by binary search. An item
    beyond the capacity gets a bin of its own.
    """
    room: list[tuple[int, int]] = []
    bins, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen, opened = max(capacity, sizes[i]), opened, opened + 1
        bins[i] = chosen
        insort(room, (left - sizes[i], chosen))
    return bins


def packed(sizes: list[int], shards: int) -> list[int]:
    """Bins of the smallest capacity at which best fit needs no more than ``shards`` bins, found by bisection."""
    low, high = -(-sum(sizes) // shards), max(sum(sizes), 1)
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(sizes, middle), default=0) < shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, high)


def shard_documents(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes; equal texts stay together.

    A document weighs the UTF-8 bytes of its text plus 8. Groups of equal texts are indivisible. A group above one
    ``grain``-th of the mean shard is an item of its own; there are at most shards x grain of those. Smaller groups
    are bundled by hash into shards x grain parcels, so that the packing sees a bounded number of items at any
    corpus size. Items by falling size go to the tightest shard with room, at the smallest capacity that does with
    ``shards`` shards. A group larger than the mean makes its shard larger; it is not split.

    Null texts are one group and weigh 8, as do empty texts, which are another. Equal rows are separate documents. Slots count
    the documents of a shard from 0 by id, nulls first. An empty table gives no rows. Only the two named columns
    are read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group"),
    )
    rows = settle(rows)
    parcel = F.pmod(F.xxhash64("group"), F.lit(shards * grain)).cast("int")
    groups = settle(rows.groupBy("group").agg(F.sum("size").alias("size")))
    limit = -(-(groups.agg(F.sum("size")).first()[0] or 0) // (shards * grain))
    large = groups.filter(F.col("size") > limit).select("group", F.lit(-1).alias("parcel"), "size")
    small = groups.filter(F.col("size") <= limit).groupBy(parcel.alias("parcel")).agg(F.sum("size").alias("size"))
    items = large.unionByName(small.select(F.lit("").alias("group"), "parcel", "size"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "parcel", "group"], ascending=[False, True, True])
        return frame.assign(shard=packed(frame["size"].tolist(), shards))[["group", "parcel", "shard"]]

    bins = settle(items.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(pack, "group string, parcel int, shard int"))
    of_group = bins.filter("parcel < 0").select("group", F.col("shard").alias("_large"))
    of_parcel = bins.filter("parcel >= 0").select(F.col("parcel").alias("_parcel"), F.col("shard").alias("_small"))
    placed = (
        rows.withColumn("_parcel", parcel)
        .join(F.broadcast(of_group), "group", "left")  # at most shards x grain rows
        .join(F.broadcast(of_parcel), "_parcel", "left")  # the same
        .withColumn("shard", F.coalesce("_large", "_small"))
        .select("doc_id", "size", "text_crc32", "shard")
    )
    placed = in_order(placed, [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32")])
    held = placed.groupBy(F.col("part_").alias("_part"), F.col("shard").alias("_shard")).agg(F.count(F.lit(1)).alias("_n"), F.min("pos_").alias("_first"))
    earlier = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return placed.join(held, (F.col("part_") == F.col("_part")) & (F.col("shard") == F.col("_shard"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_base") + F.col("pos_") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
