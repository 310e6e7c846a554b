"""N-gram Jaccard join: a forest of R-trees over count vectors, with exact verification.

A document is the set of hashes of its distinct shingles. Two sets with sizes a and b whose Jaccard similarity is at
least t differ in at most (1 - t) / (1 + t) x (a + b) shingles. Shingles are hashed into groups and a set becomes the
vector of its group counts; the overlap of two sets is at most the sum of the smaller counts.

The forest's upper level must spread over a cluster without losing a pair, so it is degenerate boxes: groups are laid
out in k segments, k above the number of differences, so that two similar sets agree exactly in at least one segment.
Over the sets that agree in a segment, an R-tree over the count vectors is joined with itself: pairs of boxes, then
pairs of points, survive if the sum of coordinate minima reaches the overlap they need. The components of surviving
pairs are few and small; within each, the same join runs once more, and now surviving pairs are verified by
intersection. Pairs already connected need no second look, so a group of thousands of near copies costs few of those.
Segments in which the same sets agree are joined once, so two long near copies exchange their vectors once, whatever
the number of segments that they share.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.llm.common import NOT_BLANK, Words, forget, mixed, pieces
from givetide.llm.decontaminate import grams
from givetide.llm.graph import components
from givetide.sources.warehouse import settle

#: Least coordinates of a count vector, and more for a set of more shingles, so that unrelated large sets stay apart;
#: points in a leaf of an R-tree; growth of the size bands.
GROUPS = 64
GROUPS_PER_SHINGLE = 0.16
LEAF = 32
BAND = 1.4
#: Shingles that a task holds of one component, and sets that it holds of one segment: larger ones are joined chunk by chunk.
CHUNK = 1_000_000
CROWD = 20_000
#: Candidates that are broadcast to the texts at most (48 bytes each); more of them meet the texts in a shuffled join.
MOST_BROADCAST = 500_000


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a batch, end to end, and where each set begins.

    With fewer words than ``width``, the whole sequence is the one shingle.
    """
    shingles = grams(words.hashes, width)
    bounds, begins, ends = [0], words.bounds[:-1].tolist(), words.bounds[1:].tolist()
    found = []
    for begin, end in zip(begins, ends, strict=True):
        n = end - begin
        if n >= width:
            s = np.sort(shingles[begin : end - width + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = mixed(grams(words.hashes[begin:end], n) + np.uint64(n))
        else:
            s = shingles[:0]
        found.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(bounds)


class Bands:
    """Size bands, and how many segments the sets of a band are cut into, for a similarity of num / den."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        self.upper, self.segments, self.spare = [], [], []
        low, high = 1, max(1, num // (den - num))
        while True:
            differ = (den - num) * 2 * high // (den + num)
            spare = 0 if not differ else 2 + math.ceil(1.8 * (differ + 1) * math.exp(-low / (differ + 3)))
            self.upper.append(high)
            self.segments.append(differ + 1 + spare)
            self.spare.append(spare)
            if high >= most:
                break
            low, high = high + 1, max(high + 1, int(high * BAND))
        self.upper, self.segments, self.spare = np.array(self.upper), np.array(self.segments), np.array(self.spare)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands of the given sizes, and of the largest sets they can be similar to: equal, or the next ones."""
        return np.searchsorted(self.upper, sizes), np.searchsorted(self.upper, sizes * self.den // self.num)


_S1, _S2, _S3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)


def _sums(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2**64 by target, from exact sums of their halves."""
    low = np.bincount(to, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(to, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def signatures(sets: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each set; hashes of its segments, end to end, and the set each belongs to."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = _sums(mixed(sets ^ _S1), owner, len(sizes))
    spread = mixed(sets ^ _S2)
    first, last = bands.of(sizes)
    keys, of = [], []
    for step in range(int((last - first).max(initial=0)) + 1):
        band = first + step
        chosen = np.flatnonzero((band <= last) & (sizes > 0))
        k = np.zeros(len(sizes), np.int64)
        k[chosen] = bands.segments[band[chosen]]
        base = np.cumsum(k) - k
        mine = k[owner] > 0
        segment = base[owner[mine]] + (sets[mine] % k[owner[mine]].astype(np.uint64)).astype(np.int64)
        total = int(k.sum())
        filled = np.bincount(segment, minlength=total)
        belongs = np.repeat(np.arange(len(sizes)), k)
        number = np.arange(total) - base[belongs]
        key = mixed(_sums(spread[mine], segment, total) + mixed((band[belongs] << 32 | number).astype(np.uint64) ^ _S3))
        empty = np.bincount(belongs[filled == 0], minlength=len(sizes))
        # Sets with few empty segments agree with any similar set in a segment that is not empty.
        used = (filled > 0) | (empty > bands.spare[np.minimum(band, len(bands.spare) - 1)])[belongs]
        keys.append(key[used])
        of.append(belongs[used])
    return whole, np.concatenate(keys), np.concatenate(of)


class Forest:
    """Union-find over the members of a tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if (up == p).all():
                return p[at]
            p[:] = up

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def groups_of(sizes: np.ndarray) -> np.ndarray:
    """Coordinates of the vectors of sets of these sizes: powers of two, so that vectors fold onto shorter ones."""
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) * GROUPS_PER_SHINGLE)).astype(np.int64).clip(0))


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    """Number of a set's shingles in each group."""
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def packed(vector: np.ndarray) -> bytes:
    """A vector as it is stored: a byte for each count, or four where one of them needs more, and their number last."""
    wide = vector.max(initial=0) > 255
    return vector.astype(np.int32 if wide else np.uint8).tobytes() + (b"\x04" if wide else b"\x01")


def folded(vectors: list[bytes], groups: int) -> np.ndarray:
    """Stored vectors with as many coordinates as the shortest of them."""
    counts = [np.frombuffer(v, np.int32 if v[-1] == 4 else np.uint8, (len(v) - 1) // v[-1]) for v in vectors]
    return np.stack([c.reshape(-1, groups).sum(axis=0, dtype=np.int32) for c in counts])


def linked(sizes: np.ndarray, vectors: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """The least member that each point is connected with, by an R-tree joined with itself.

    Pairs whose bound admits a similarity of num / den are connected; with ``sets``, if their intersection confirms it.
    """
    n = len(sizes)
    forest = Forest(n)
    # Leaves hold points of nearly equal size that are close in the coordinate that varies most.
    spread = int(np.argmax(vectors.var(axis=0))) if n > LEAF else 0
    order = np.lexsort((vectors[:, spread], np.searchsorted(np.geomspace(1, max(2, sizes.max()), 200), sizes)))
    leaves = [order[i : i + LEAF] for i in range(0, n, LEAF)]
    boxes = np.stack([vectors[leaf].max(axis=0) for leaf in leaves])
    least, most = np.array([sizes[leaf].min() for leaf in leaves]), np.array([sizes[leaf].max() for leaf in leaves])

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        bound = np.minimum(vectors[a][:, None], vectors[b][None]).sum(axis=2)
        needed = num * (sizes[a][:, None] + sizes[b][None])
        survive = bound * (den + num) >= needed
        if a is b:
            survive &= np.tri(len(a), k=-1, dtype=bool)
        survive &= forest.roots(a)[:, None] != forest.roots(b)[None]
        x, y = np.nonzero(survive)
        for i, j in zip(a[x[(o := np.argsort(-bound[x, y], kind="stable"))]].tolist(), b[y[o]].tolist(), strict=True):
            if forest.root(i) != forest.root(j) and (
                sets is None or np.intersect1d(sets[i], sets[j], assume_unique=True).size * (den + num) >= num * (sizes[i] + sizes[j])
            ):
                forest.join(i, j)

    def descend(a: tuple[int, int], b: tuple[int, int]) -> None:
        """Join the leaves of two subtrees, given as ranges of leaves, as long as their boxes may hold a pair."""
        box = np.minimum(boxes[a[0] : a[1]].max(axis=0), boxes[b[0] : b[1]].max(axis=0)).sum()
        low, high = least[a[0] : a[1]].min(), most[a[0] : a[1]].max()
        other_low, other_high = least[b[0] : b[1]].min(), most[b[0] : b[1]].max()
        if box * (den + num) < num * (low + other_low) or high * den < other_low * num or other_high * den < low * num:
            return
        if a == b:
            if a[1] - a[0] == 1:
                verify(leaves[a[0]], leaves[a[0]])
                return
            m = (a[0] + a[1]) // 2
            descend((a[0], m), (a[0], m))
            descend((m, a[1]), (m, a[1]))
            descend((a[0], m), (m, a[1]))
        elif a[1] - a[0] == 1 and b[1] - b[0] == 1:
            verify(leaves[a[0]], leaves[b[0]])
        elif a[1] - a[0] >= b[1] - b[0]:
            m = (a[0] + a[1]) // 2
            descend((a[0], m), b)
            descend((m, a[1]), b)
        else:
            m = (b[0] + b[1]) // 2
            descend(a, (b[0], m))
            descend(a, (m, b[1]))

    descend((0, len(leaves)), (0, len(leaves)))
    return forest.roots(np.arange(n))


def _crowd_links(num: int, den: int):
    """Links of the sets that share a segment, from rows sorted by segment and chunk; one bucket of rows at a time."""

    def links(table: pa.Table) -> pa.RecordBatch:
        key, low, high, ids, sizes = [table.column(c).to_numpy() for c in ("key", "low", "high", "set_id", "n")]
        vectors = table.column("vector").to_pylist()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        starts = np.flatnonzero(new)
        bucket = np.cumsum(new) - 1
        first = starts[bucket]
        ends = np.append(starts[1:], len(ids))
        # Each bucket is compared at the coordinates of its shortest vector.
        shortest = np.minimum.reduceat(groups_of(sizes), starts)
        good = np.zeros(len(ids), bool)
        for groups in np.unique(shortest).tolist():
            of = np.flatnonzero(shortest[bucket] == groups)
            step = max(1, (1 << 21) // groups)
            for i in range(0, len(of), step):
                at = of[i : i + step]
                heads, place = np.unique(first[at], return_inverse=True)
                bound = np.minimum(folded([vectors[j] for j in at.tolist()], groups), folded([vectors[j] for j in heads.tolist()], groups)[place]).sum(axis=1)
                good[at] = bound * (den + num) >= num * (sizes[at] + sizes[first[at]])
        out_a, out_b = [ids[first[good & ~new]]], [ids[good & ~new]]
        # Where all are near the first, they are connected; elsewhere every pair counts.
        for i in np.flatnonzero((np.bincount(bucket, ~good) > 0) & (ends - starts > 2)).tolist():
            part = slice(starts[i], ends[i])
            root = linked(sizes[part], folded(vectors[part], int(shortest[i])), num, den)
            moved = np.flatnonzero(root != np.arange(len(root)))
            out_a.append(ids[part][root[moved]])
            out_b.append(ids[part][moved])
        return pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    def join(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(c)[-1] for c in ("key", "low", "high")]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(("key", "low", "high"), last, strict=True):
                same &= batch.column(c).to_numpy() == v.as_py()
            if same.all():
                continue  # the bucket may go on; its chunks bound it
            table = pa.Table.from_batches(held)
            cut = table.num_rows - int(same.sum())
            yield links(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return join


def jaccard_components(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_root: bool = False) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id, component_id) of every row; other columns are ignored.

    Words are runs without ASCII white space, ASCII letters lower-cased; a set holds the distinct shingles of
    ``width`` words, or the whole sequence if there are fewer. Rows are linked when den x intersection >= num x union;
    component_id is the least id that links reach. Equal sets are one member of the join, so a third of all rows may
    be copies of one text. Null or empty texts, and texts without words, have size 0, no set and their own id.
    Null ids are ignored when the least is taken; a component of null ids has a null id. Equal ids are separate rows.
    An empty table gives no rows.

    Sets and segments are compared by 64-bit hashes; pairs are verified on the shingles' own 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text"))
    bands = Bands(num, den)

    def sketch(batches):
        for batch in pieces(batches, "text"):
            sets, bounds = shingle_sets(Words(batch.column("text"), NOT_BLANK), width)
            whole, keys, of = signatures(sets, bounds, bands)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(batch.num_rows + 1))
            sizes = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(whole.view(np.int64), mask=sizes == 0),
                    pa.array([packed(count_vector(sets[a:b], g)) for a, b, g in zip(bounds[:-1].tolist(), bounds[1:].tolist(), groups_of(sizes).tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys[order].view(np.int64))),
                ],
                names=["doc_id", "text_id", "n_shingles", "set_id", "vector", "keys"],
            )

    keyed = settle(rows.mapInArrow(sketch, "doc_id long, text_id long, n_shingles long, set_id long, vector binary, keys array<long>"))
    sketched = settle(keyed.drop("keys"))
    members = sketched.filter("set_id is not null")
    # The widest shuffle of all is that by key: what the rows were cut into, and the shuffle by set, are deleted before it.
    distinct = settle(keyed.filter("set_id is not null").select("set_id", "keys").dropDuplicates(["set_id"]))
    forget(keyed)
    one = distinct.select("set_id", F.explode("keys").alias("key"))
    # Near copies agree in many segments. Buckets of the same sets, told by their number and the exclusive or of their
    # hashes, are one bucket from here on; two that share this by chance only meet more sets than they need to.
    together = Window.partitionBy("key")
    counted = one.select("set_id", F.count(F.lit(1)).over(together).alias("many"), F.bit_xor(F.xxhash64("set_id")).over(together).alias("same"))
    crowded = counted.filter("many > 1").select("set_id", "many", F.xxhash64("many", "same").alias("key"))
    many = settle(crowded.dropDuplicates(["key", "set_id", "many"]))
    forget(distinct)
    points = members.select(F.col("set_id").alias("_set"), F.col("n_shingles").alias("n"), "vector").dropDuplicates(["_set"])
    chunked = many.withColumn("chunks", F.ceil(F.col("many") / CROWD).cast("int"))
    own = F.pmod(F.xxhash64("set_id", F.lit("crowd")), F.col("chunks")).cast("int")
    crowds = (
        chunked.select("key", "set_id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("key", "set_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(points, F.col("set_id") == F.col("_set"))
        .select("key", "low", "high", "set_id", "n", "vector")
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "set_id")
    )
    trees = settle(components(crowds.mapInArrow(_crowd_links(num, den), "a long, b long")))
    forget(many)
    joined = components(_links(rows, members, trees, width, num, den))
    of_set = members.groupBy("set_id").agg(F.min("doc_id").alias("least_id"))
    of_set = settle(of_set.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    of_root = of_set.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of_set.join(of_root, "root").select(F.col("set_id").alias("_set"), "component_id", "root")
    found = sketched.select("doc_id", "text_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("_set"), "left").select(
        "doc_id", "text_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root"
    )
    return found if with_root else found.drop("root")


def _links(rows: DataFrame, members: DataFrame, trees: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the similar sets of each tree."""
    spark = rows.sparkSession
    of_tree = trees.select(F.col("node").alias("set_id"), F.col("root").alias("tree"))
    held = members.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_id")).alias("row"), F.first("n_shingles").alias("n")).join(of_tree, "set_id")
    held = settle(held.select("set_id", "tree", "n", F.col("row.doc_id").alias("_doc"), F.col("row.text_id").alias("_text")))
    weight = settle(held.groupBy("tree").agg(F.sum("n").alias("total")))
    total = weight.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, -(-total // CHUNK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (CHUNK // 8))))
    held = held.join(weight, "tree").withColumn("chunks", F.ceil(F.col("total") / CHUNK).cast("int"))
    if held.count() <= MOST_BROADCAST:
        held = F.broadcast(held)
    texts = rows.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_id") == F.col("_text"))).dropDuplicates(["set_id"])
    own = F.pmod(F.xxhash64("set_id", F.lit("chunk")), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = texts.withColumn("own", own).select("set_id", "tree", "text", "chunks", "own", other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # Small trees share a task; a pair of chunks of a large one has its own.
    group = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("tree"), F.lit(tasks))).otherwise(F.xxhash64("tree", low, high))
    placed = placed.select("set_id", "tree", "text", low.cast("int").alias("low"), high.cast("int").alias("high"), group.alias("group"))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, tree in frame.groupby(["tree", "low", "high"], sort=False):
            ids, sets = tree["set_id"].to_numpy(), []
            for batch in pieces([pa.RecordBatch.from_pydict({"text": pa.array(tree["text"], pa.string())})], "text"):
                found, bounds = shingle_sets(Words(batch.column("text"), NOT_BLANK), width)
                sets += [found[bounds[i] : bounds[i + 1]] for i in range(batch.num_rows)]
            sizes = np.array([len(x) for x in sets])
            groups = int(groups_of(sizes).min())
            root = linked(sizes, np.stack([count_vector(x, groups) for x in sets]), num, den, sets)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            out_a.append(ids[moved])
            out_b.append(ids[root[moved]])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return placed.groupBy("group").applyInPandas(join, "a long, b long")


def keep_one(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` (with columns doc_id and text) for each component: the one with the least id.

    Among equal ids the least text hash decides, and of fully equal rows one stays. Rows without words all stay.
    Rows with a null id stay only where their component has no other id.
    """
    found = jaccard_components(docs, width=width, num=num, den=den, with_root=True)
    alone = found.filter("set_id is null")
    first = found.filter("set_id is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_id")).alias("row"))
    kept = settle(first.select(F.col("row.doc_id").alias("_id"), F.col("row.text_id").alias("_text"), F.lit(True).alias("_one")))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash")
    )
    joined = packed.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left_semi")
    one = joined.dropDuplicates(["_doc", "_hash"]).select("row.*")
    empty = settle(alone.select(F.col("text_id").alias("_text")).distinct())
    return one.unionByName(packed.join(empty, F.col("_hash") == F.col("_text"), "left_semi").select("row.*"))
