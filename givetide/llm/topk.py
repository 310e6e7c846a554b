"""Exact top-k inner product search: a ball tree in each shard, searched by branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.llm.common import about
from givetide.sources.warehouse import settle

#: Vectors in a shard, points in a leaf, and queries that meet a shard in one task.
SHARD = 4096
LEAF = 128
QUERIES = 20_000
#: Pivots that place vectors in shards at most, a sample of the vectors themselves.
MOST_PIVOTS = 1024


class BallTree:
    """Balls around ever smaller halves of the points; a query's score in a ball is at most q.c + |q| r."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.nodes: list[tuple[int, int] | np.ndarray] = []
        self.centres, self.radii = [], []
        self._split(np.arange(len(ids)))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.leaves = [self.points[n] if isinstance(n, np.ndarray) else None for n in self.nodes]

    def _split(self, at: np.ndarray) -> int:
        node = len(self.nodes)
        p = self.points[at]
        centre = p.mean(axis=0)
        self.nodes.append(at)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((p - centre) ** 2).sum(axis=1).max())))
        if len(at) > LEAF:
            far = p[((p - centre) ** 2).sum(axis=1).argmax()]
            other = p[((p - far) ** 2).sum(axis=1).argmax()]
            by = np.argsort(p @ (other - far), kind="stable")
            half = len(at) // 2
            left = self._split(np.sort(at[by[:half]]))
            right = self._split(np.sort(at[by[half:]]))
            self.nodes[node] = (left, right)
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        norms = np.sqrt((queries**2).sum(axis=1))
        exact = queries @ self.centres.T + norms[:, None] * self.radii[None]
        return exact + 1e-6 * (1 + np.abs(exact))

    def search(self, query: np.ndarray, own: int, k: int, least: float, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of this shard that are not below ``least``, the kth score known so far."""
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if isinstance(self.nodes[node], tuple):
                for child in self.nodes[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            found = self.leaves[node] @ query
            good = np.flatnonzero(found >= least)
            if len(good):
                at = self.nodes[node][good]
                other = self.ids[at] != own
                scores, ids = np.concatenate([scores, found[good[other]]]), np.concatenate([ids, self.ids[at[other]]])
                if len(scores) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    least = max(least, scores.min())
        return scores, ids


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


_FOUND = "query_id long, vec_id long, score long"


def _rows(query: int, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.full(len(ids), query), "vec_id": ids, "score": scores.astype(np.int64)})


_KINDS = ["kind", "shard", "length", "query_id", "vec_id", "score", "centre", "radius"]


def _kind(kind: str, n: int, **columns: list) -> pd.DataFrame:
    """Rows of one kind, with nulls in the columns of the others."""
    return pd.DataFrame({c: pd.Series(columns.get(c, [None] * n), dtype=object) for c in ("query_id", "vec_id", "score", "centre", "radius")}).assign(kind=kind)


def _searched(tree: BallTree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
    bounds = tree.bounds(queries)
    found = [_rows(i, *tree.search(q, i, k, t, b)) for i, q, t, b in zip(ids.tolist(), queries, least.tolist(), bounds, strict=True)]
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query among all other rows.

    Components x become floor(scale * x); scores are exact integers as long as their absolute values stay below 2**53.
    Queries are the rows whose id is divisible by ``every``; ties go to the smaller id. A row with fewer than k
    candidates gets all of them. Vectors that are null, empty or hold null or non-finite components, and rows with a null id,
    take no part. Vectors of different lengths are not compared. Rows with a query's own id are never its candidates;
    if an id repeats, its least vector is the query, and each of its rows is a candidate of others. An empty table
    gives no rows. Only the two named columns are read.

    Vectors are placed with the nearest of at most ``MOST_PIVOTS`` sampled pivots, and crowded places are split by
    hash, so that shards hold about ``shard`` vectors at any scale. A query first searches its own shard. Its kth score there goes
    with it to the others: shards whose bounding ball cannot reach it are skipped, and the rest start from it.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(vector_col)
    whole = ~F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & value.isNotNull() & (F.size(value) > 0) & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )
    n = rows.count()
    pivots = sorted(about(rows, min(MOST_PIVOTS, max(1, -(-n // shard))), n, "vec_id").select("vec_id", "v").limit(4 * MOST_PIVOTS).collect())
    by_length: dict[int, list[np.ndarray]] = {}
    for r in pivots:
        by_length.setdefault(len(r["v"]), []).append(np.array(r["v"]))
    by_length = {length: np.stack(v) for length, v in by_length.items()}

    def place(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            values = batch.column("v")
            lengths = np.diff(values.offsets.to_numpy())
            flat, starts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                near = np.zeros(len(at), np.int64)
                if length in by_length:
                    p = by_length[length]
                    points = flat[starts[at][:, None] + np.arange(length)]
                    near = ((p**2).sum(axis=1)[None] - 2 * points @ p.T).argmin(axis=1)
                out[at] = length * 4 * MOST_PIVOTS + near
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["vec_id", "v", "place"])

    placed = settle(rows.mapInArrow(place, "vec_id long, v array<double>, place long"))
    crowd = placed.groupBy(F.col("place").alias("_place")).agg(F.ceil(F.count(F.lit(1)) / shard).alias("cells"))
    placed = placed.join(crowd, F.col("place") == F.col("_place")).select(
        "vec_id", "v", F.size("v").alias("length"), F.xxhash64("place", F.pmod(F.xxhash64("vec_id"), F.col("cells"))).alias("shard")
    )
    placed = settle(placed)

    def at_home(frame: pd.DataFrame) -> pd.DataFrame:
        ids, points = frame["vec_id"].to_numpy(), _matrix(frame["v"])
        tree = BallTree(points, ids)
        asks = frame[frame["vec_id"] % every == 0].copy()
        asks["first"] = [tuple(v) for v in asks["v"]]
        asks = asks.sort_values(["vec_id", "first"]).drop_duplicates("vec_id")
        out = [_kind("shard", 1, centre=[tree.centres[0]], radius=[tree.radii[0]])]
        if len(asks):
            found = _searched(tree, asks["vec_id"].to_numpy(), _matrix(asks["v"]), np.full(len(asks), -np.inf), k)
            out.append(_kind("found", len(found), **{c: found[c].tolist() for c in found}))
            out.append(_kind("query", len(asks), query_id=asks["vec_id"].tolist(), centre=asks["v"].tolist()))
        return pd.concat(out).assign(shard=frame["shard"].iloc[0], length=points.shape[1])[_KINDS]

    kinds = "kind string, shard long, length int, query_id long, vec_id long, score long, centre array<double>, radius double"
    home = settle(placed.groupBy("shard").applyInPandas(at_home, kinds))
    # A repeated id may ask in several shards; its least vector decides which of them is the query's own.
    asks = home.filter("kind = 'query'").select("shard", "length", "query_id", F.col("centre").alias("v"))
    one = settle(asks.groupBy("query_id").agg(F.min(F.struct("v", "shard", "length")).alias("row")))
    own = one.select(F.col("query_id").alias("_asked"), F.col("row.shard").alias("_home"))
    found = home.filter("kind = 'found'").join(own, (F.col("query_id") == F.col("_asked")) & (F.col("shard") == F.col("_home"))).select("query_id", "vec_id", "score")
    kth = found.groupBy(F.col("query_id").alias("_query")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    kth = kth.select("_query", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("least"))
    asks = one.select("query_id", "row.v", "row.length", F.col("row.shard").alias("home")).join(kth, F.col("query_id") == F.col("_query"), "left")
    balls = settle(home.filter("kind = 'shard'").select("shard", "length", "centre", "radius"))
    balls_path = balls.inputFiles()[0].rsplit("/", 1)[0] if n else ""

    def reach(batches):
        """Each query with the shards that it has to search: balls are read block by block."""
        import pyarrow.dataset as ds

        from givetide.llm.tokens import open_files

        for batch in batches:
            queries = batch.to_pandas()
            if queries.empty:
                continue
            files, path = open_files(balls_path)
            for block in ds.dataset(path, filesystem=files, format="parquet").to_batches(batch_size=4096):
                held = block.to_pandas()
                for length in set(held["length"]) & set(queries["length"]):
                    b, q = held[held["length"] == length], queries[queries["length"] == length]
                    points = _matrix(q["v"])
                    top = points @ _matrix(b["centre"]).T + np.sqrt((points**2).sum(axis=1))[:, None] * b["radius"].to_numpy()[None]
                    least = q["least"].astype("float64").fillna(-np.inf).to_numpy()
                    into = (top + 1e-6 * (1 + np.abs(top)) >= least[:, None]) & (q["home"].to_numpy()[:, None] != b["shard"].to_numpy()[None])
                    i, j = np.nonzero(into)
                    if len(i):
                        out = q.iloc[i].assign(shard=b["shard"].to_numpy()[j])
                        out["least"] = least[i]
                        yield pa.RecordBatch.from_pandas(out[["shard", "query_id", "v", "least"]], schema=sent, preserve_index=False)

    sent = pa.schema([("shard", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("least", pa.float64())])
    if not n:
        others = spark.createDataFrame([], _FOUND)
    else:
        pairs = settle(asks.select("query_id", "v", "length", "home", "least").repartition(parts, "query_id").mapInArrow(reach, "shard long, query_id long, v array<double>, least double"))
        blocks = pairs.groupBy(F.col("shard").alias("_shard")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        blocked = pairs.join(blocks, F.col("shard") == F.col("_shard")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        copies = placed.join(blocks, F.col("shard") == F.col("_shard")).select("shard", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def away(frame: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if frame.empty or queries.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            tree = BallTree(_matrix(frame["v"]), frame["vec_id"].to_numpy())
            return _searched(tree, queries["query_id"].to_numpy(), _matrix(queries["v"]), queries["least"].to_numpy(), k)

        by = ("shard", "block")
        others = copies.groupBy(*by).cogroup(blocked.select("shard", "block", "query_id", "v", "least").groupBy(*by)).applyInPandas(away, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
