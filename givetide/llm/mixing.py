"""Mixing sources to target weights by weighted sampling with exponential keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import running
from givetide.sources.warehouse import settle

#: Weights of the sources in code point order, repeated; and how often a document may be taken.
WEIGHTS = (1, 2, 3)
MOST = 3


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to ``target``: all words shared by weight, none above ``most`` times its size.

    The common level, target per weight, is where capped and uncapped targets add up to all words. Sources ordered
    by cap per weight reach their caps one after another, so running sums of caps and weights give the level.
    """
    ranked = running(sizes.withColumn("all_", F.lit(0)).withColumn("one_", F.lit(1)), "all_", [F.col("source").asc_nulls_last()], "one_")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", "all_", weight.cast("long").alias("weight")).withColumn("cap", most * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    capped = running(weighed, "all_", order, "cap").withColumnRenamed("before", "caps_before")
    passed = settle(running(capped, "all_", order, "weight").withColumnRenamed("before", "weights_before"))
    total, weights_sum = passed.agg(F.sum("source_size")).scalar(), passed.agg(F.sum("weight")).scalar()
    open_weight = weights_sum - F.col("weights_before")
    reached = F.col("caps_before") * F.col("weight") + F.col("cap") * open_weight >= total * F.col("weight")
    level = passed.filter(reached).agg(F.min_by((total - F.col("caps_before")) / open_weight, F.struct(F.col("caps_before"), F.col("weights_before")))).scalar()
    target = F.least(F.col("weight") * level, F.col("cap").cast("double"))
    return settle(passed.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes: ``taken``, a multiple of its size.

    A source whose target holds its whole size several times gives that many complete epochs. The rest of the target
    is a weighted sample without replacement: documents by rising -ln(u) / w, where u is uniform by the hash of the
    id and w the weight in ``quality`` (doc_id, weight; 1 where absent), are taken while the running sum of their
    sizes stays nearest to the rest. So a source misses its target by no more than half a document.

    Null texts and texts without words have size 0 and taken 0. Null sources are one source, the last. Rows with
    null or equal ids are separate documents; equal ids share u and are ordered by size and text hash. Weights of 0, null or below
    count as absent. An empty table gives no rows. Reruns agree.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"))
    if quality is not None:
        w = quality.filter("weight > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(w, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = settle(rows.withColumn("key", -F.log(uniform) / F.coalesce("weight", F.lit(1.0))).drop("weight"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(settle(sizes), weights, most).withColumnRenamed("source", "_source")
    placed = running(rows, "source", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")], "size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("epochs") < most) & (F.col("before") + F.col("size") / 2 <= rest)
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epochs", epochs)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + extra.cast("int"))).cast("long").alias("taken"), "tie")
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: 2 for good, a half for bad."""
    return labels.filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    Of rows with equal ids and texts each is counted on its own: the mix's decisions are summed over them and dealt
    out in order. Texts without words are taken as often as their source has complete epochs, at least once, as they cost nothing.
    """
    decided = mix(docs, quality, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    epochs = F.greatest(F.lit(1), F.least(F.lit(MOST), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))))
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest(F.col("size"), F.lit(1))).otherwise(epochs).cast("int")
    decided = decided.withColumn("times", times).groupBy("doc_id", "source", "tie").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    decided = settle(decided.select(F.struct("doc_id", "source", "tie").alias("of"), F.struct(F.col("_times").alias("times"), F.col("_rows").alias("rows")).alias("decided")))
    # The caller's columns travel as one, so that their names meet no others.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("tie")).alias("key"),
    )
    joined = packed.join(decided.filter("decided.times > 0"), F.col("key").eqNullSafe(F.col("of")))
    once = joined.filter("decided.rows = 1")
    # Equal rows are interchangeable: one of them carries what the mix takes of all.
    many = joined.filter("decided.rows > 1").dropDuplicates(["key"])
    return once.unionByName(many).select("row", F.explode(F.sequence(F.lit(1), F.col("decided.times").cast("int")))).select("row.*")
