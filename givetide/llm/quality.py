"""Quality classifier: a modified Kneser-Ney model of trusted text, and perplexity limits for each language.

The grams are runs of four bytes, of all 256, so a language in a script of its own is told from its junk however rare
it is. The model holds the grams that trusted text has, in sorted arrays; each distinct gram of a piece of text is
looked up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.llm.collocations import load, sieve_of
from givetide.llm.common import bytes_of, pieces
from givetide.sources.warehouse import settle

ORDER = 4
CLASSES = 256
#: One in so many trusted documents is held out for the limits, and the quantile of their perplexity that is the limit.
HELD_OUT = 5
QUANTILE = 0.999
#: Bytes of average trusted text that a short document's perplexity is drawn towards; held-out documents needed for
#: a limit of a language's own.
PRIOR_BYTES = 40
LEAST_HELD_OUT = 50
#: Distinct grams that a task holds before it hands their counts on.
MOST_HELD = 1 << 21
#: Bits of the table of wanted ids (8 MB), of which a row has one.
ID_BITS = 26


def coded(column, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a batch's bytes with three line ends before each text, where each byte is, and texts' bounds."""
    data, offsets = bytes_of(column)
    lead = ORDER - 1
    padded = np.full(len(data) + lead * (len(offsets) - 1), classes[10], np.uint32)
    at = np.arange(len(data)) + lead * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    padded[at] = classes[data]
    return padded, at, offsets


def gram_index(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    context = (padded[at - 3] << np.uint32(8) | padded[at - 2]) << np.uint32(8) | padded[at - 1]
    return context << np.uint32(8) | padded[at]


def byte_classes(texts: DataFrame) -> np.ndarray:
    """Class of each of the 256 bytes, one for each, by how often they occur."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in pieces(batches, "text"):
            total += np.bincount(bytes_of(batch.column("text"))[0], minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": np.arange(256, dtype=np.int32), "n": total})

    counts = texts.mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows
    often = np.zeros(256, np.int64)
    for r in counts:
        often[r["byte"]] = r["n"]
    classes = np.zeros(256, np.uint32)
    classes[np.argsort(-often, kind="stable")] = np.arange(256)
    return classes


def gram_counts(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """(gram, n) of trusted text: counted in each task, then added up by gram.

    New counts are merged into those held once they are as many, so a task's work is in proportion to its text.
    """

    def merged(counts):
        gram, place = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
        return gram, np.bincount(place, np.concatenate([n for _, n in counts]), len(gram)).astype(np.int64)

    def handed_on(gram, total):
        for i in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_pydict({"gram": gram[i : i + 100_000].astype(np.int64), "n": total[i : i + 100_000]})

    def count(batches):
        held, waiting = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0
        for batch in pieces(batches, "text"):
            padded, at, _ = coded(batch.column("text"), classes)
            held.append(np.unique(gram_index(padded, at), return_counts=True))
            waiting += len(held[-1][0])
            if waiting > len(held[0][0]):
                held, waiting = [merged(held)], 0
                if len(held[0][0]) > MOST_HELD:
                    yield from handed_on(*held[0])
                    held = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        yield from handed_on(*merged(held))

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(order, gram, share, gamma): the discounted share of each seen gram, and the weight left by its context.

    The highest order has raw counts; each lower one counts the distinct bytes that precede its grams. Discounts for
    counts of one, two and more come from the numbers of grams seen one to four times.
    """
    levels = []
    current = counts
    for order in range(ORDER, 0, -1):
        current = settle(current)
        seen = current.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        n1, n2, n3, n4 = [float(x or 0) for x in seen.first()]
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d1, d2, d3 = [min(max(k - (k + 1) * y * b / a if a else k * y, 0.1), k - 0.1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.floor(F.col("gram") / CLASSES).cast("long")
        by = Window.partitionBy(context)
        levels.append(
            current.select(
                F.lit(order).alias("order"),
                "gram",
                ((F.col("n") - discount) / F.sum("n").over(by)).alias("share"),
                (F.sum(discount).over(by) / F.sum("n").over(by)).alias("gamma"),
            )
        )
        current = current.groupBy((F.col("gram") % CLASSES ** (order - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


class Model:
    """Seen grams and contexts of each order, sorted, with the share of each gram and the weight its context leaves."""

    def __init__(self, order: np.ndarray, gram: np.ndarray, share: np.ndarray, gamma: np.ndarray):
        self.levels = []
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(order == k)
            own = own[np.argsort(gram[own])]
            seen = gram[own].astype(np.uint32)
            context, first = np.unique(seen >> np.uint32(8), return_index=True)
            self.levels.append((seen, share[own], context, gamma[own][first]))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each of the given sorted grams given its context, interpolated from the lowest order up."""
        p = np.full(len(gram), 1 / CLASSES)
        for k, (seen, share, context, gamma) in enumerate(self.levels, 1):
            low = gram & np.uint32(CLASSES**k - 1)
            p *= _found(context, gamma, low >> np.uint32(8), 1.0)
            p += _found(seen, share, low, 0.0)
        return -np.log2(p)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], missing) if len(keys) else np.full(len(wanted), missing)


def dense(order: np.ndarray, gram: np.ndarray, share: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Bits of all 256 bytes after each seen context of three, context by context; for checks of the model."""
    model = Model(order, gram, share, gamma)
    contexts = model.levels[-1][2]
    return model.bits((contexts[:, None] << np.uint32(8) | np.arange(CLASSES, dtype=np.uint32)).reshape(-1))


_models: dict[str, Model] = {}


def _model(path: str) -> Model:
    """The model, built once by each worker from the settled shards."""
    if path not in _models:
        import pyarrow.parquet as pq

        from givetide.llm.tokens import open_files

        files, folder = open_files(path)
        rows = pq.read_table(folder, filesystem=files)
        _models.clear()
        _models[path] = Model(*[rows.column(c).to_numpy() for c in ("order", "gram", "share", "gamma")])
    return _models[path]


def trusted_ids(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents for training, and of those held out. Trusted: good and not toxic."""
    good = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .filter("quality = 1 and toxic = 0")
        .withColumn("fold", F.xxhash64("doc_id", F.lit("fold")))
    )
    good = settle(good)
    held = F.pmod("fold", F.lit(HELD_OUT)) == 0
    return good.filter(~held).select("doc_id"), good.filter(held).select("doc_id")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is among the distinct ``ids``.

    Rows that a bit table of the ids rules out never leave their task, so about the wanted texts are shuffled, and not all.
    The join settles the rest exactly. It is never a broadcast: the ids grow with the documents, and a plan that changes with
    their number says nothing of larger ones.
    """
    hashes = ids.select(F.xxhash64("doc_id").alias("a"))
    _, table = sieve_of(hashes, ID_BITS)

    def sift(batches):
        [sieve] = load(table)
        for batch in batches:
            found = sieve.has(batch.column("_hash").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(found)).drop_columns(["_hash"])

    hashed = rows.filter("doc_id is not null").withColumn("_hash", F.xxhash64("doc_id"))
    return hashed.mapInArrow(sift, rows.schema).join(ids.hint("merge"), "doc_id", "left_semi")


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, limit, rejected) of every document row.

    The model is trained on all documents labelled good and not toxic but one in ``HELD_OUT``, chosen by hash of the
    id. Perplexity is per byte of the whole text. A language's limit is the given
    quantile of all held-out trusted documents of that language; languages with fewer than ``LEAST_HELD_OUT`` of those share the limit of
    all. Short texts prove little, so ``PRIOR_BYTES`` bytes of average trusted text are added to each before it is compared.

    Null and empty texts have null perplexity and are kept. A null language is one of its own. Equal rows get equal
    results. Without trusted documents nothing is rejected and limits are null. An empty table gives no rows.
    Labels with null or unknown ids are ignored; repeated labels count as the worst of them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored, limits = _scored(rows, labels, quantile)
    return _limited(scored, limits).select("doc_id", "lang", "n_bytes", "perplexity", "limit", "rejected")


def keep_documents(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with their columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    _, limits, path, classes = _fitted(rows, labels, quantile, only_held=True)
    if limits is None:
        return docs
    own, of_all, mean = limits
    limit_of = dict(own.collect())  # one row for each language with enough trusted documents
    bits = _bits(path, classes)

    def keep(batches):
        for batch in pieces(batches, "text"):
            n, total = bits(batch.column("text"))
            limit = np.array([limit_of.get(lang, of_all) for lang in batch.column("lang").to_pylist()])
            rejected = (n > 0) & ((total + PRIOR_BYTES * mean) / (n + PRIOR_BYTES) > limit)
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def _bits(path: str, classes: np.ndarray):
    def bits(column) -> tuple[np.ndarray, np.ndarray]:
        padded, at, offsets = coded(column, classes)
        gram, place = np.unique(gram_index(padded, at), return_inverse=True)
        n, each = np.diff(offsets), np.append(_model(path).bits(gram)[place], 0.0)
        # Summed by text, so that a text's bits don't depend on its batch: one at a limit must meet it in every pass.
        return n, np.where(n > 0, np.add.reduceat(each, offsets)[:-1], 0.0)

    return bits


def _fitted(rows: DataFrame, labels: DataFrame, quantile: float, only_held: bool = False):
    """Scores, limits, model and classes; with ``only_held`` scores of the trusted documents held out, which set the limits."""
    train, held = trusted_ids(labels)
    if train.isEmpty():
        return rows.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("bits")), None, None, None
    # Read twice: settled, so that texts are shuffled once and their shuffle files go before the model is built.
    texts = settle(only(rows.select("doc_id", "text"), train).select("text"))
    classes = byte_classes(texts)
    model = kneser_ney(gram_counts(texts, classes)).repartition(16, "gram")
    from givetide.sources.warehouse import run_folder
    import uuid

    path = f"{run_folder(rows.sparkSession)}/kneser-ney-{uuid.uuid4().hex}"
    model.write.parquet(path)
    bits = _bits(path, classes)

    def score(batches):
        for batch in pieces(batches, "text"):
            n, total = bits(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(n), pa.array(total)], names=["doc_id", "lang", "n_bytes", "bits"])

    asked = only(rows, held) if only_held else rows
    scored = settle(asked.mapInArrow(score, "doc_id long, lang string, n_bytes long, bits double"))
    trusted = scored.filter("n_bytes > 0") if only_held else settle(scored.filter("n_bytes > 0").join(held, "doc_id", "left_semi"))
    mean = trusted.agg(F.sum("bits") / F.sum("n_bytes")).first()[0]
    if mean is None:
        return scored, None, None, None
    rate = (F.col("bits") + PRIOR_BYTES * mean) / (F.col("n_bytes") + PRIOR_BYTES)
    of_all = trusted.agg(F.percentile_approx(rate, quantile, 100_000)).first()[0]
    own = trusted.groupBy("lang").agg(F.percentile_approx(rate, quantile, 100_000).alias("own"), F.count(F.lit(1)).alias("n"))
    own = settle(own.filter(F.col("n") >= LEAST_HELD_OUT).select(F.col("lang").alias("_lang"), "own"))
    return scored, (own, of_all, mean), path, classes


def _scored(rows: DataFrame, labels: DataFrame, quantile: float):
    scored, limits, _, _ = _fitted(rows, labels, quantile)
    return scored, limits


def _limited(scored: DataFrame, limits) -> DataFrame:
    if limits is None:
        return scored.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("limit"), F.lit(False).alias("rejected"))
    own, of_all, mean = limits
    placed = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce(F.col("own"), F.lit(of_all))
    rate = (F.col("bits") + PRIOR_BYTES * mean) / (F.col("n_bytes") + PRIOR_BYTES)
    return placed.select(
        *scored.columns,
        F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"),
        F.pow(F.lit(2.0), limit).alias("limit"),
        ((F.col("n_bytes") > 0) & (rate > limit)).alias("rejected"),
    )
