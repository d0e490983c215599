"""Exact top-k by inner product: a ball tree in each shard, searched best bound first under a shared k-th score."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch
from rasterloom.session import ship_package

SHARD_ROWS = 8192  #: vectors that one task holds
MIN_SHARDS = 32
BLOCK_QUERIES = 1024  #: queries that meet a shard at once
LEAF = 48
SECOND = 8  #: after the first shard, queries meet one shard in so many, then the others

HITS = "query_id bigint, vec_id bigint, score bigint"


def whole_vector(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null for a null vector or one with a null or non-finite component.

    Components too large for a long are taken as the largest long of their sign.
    """
    top = float(2**62)
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    floor = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(top)), F.lit(-top))))
    return F.when(embedding.isNotNull() & finite, floor)


class BallTree:
    """Balls over the rows of ``points``, split at the median of the widest component; a leaf is a run of rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.centers, self.radii, self.least, self.span, self.kids = [], [], [], [], []
        self._build(np.arange(len(ids)), leaf, rows := [])
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.ids, self.points = self.ids[rows], self.points[rows]
        self.centers, self.radii, self.least = np.array(self.centers), np.array(self.radii), np.array(self.least)

    def _build(self, rows: np.ndarray, leaf: int, out: list[np.ndarray]) -> None:
        todo = [(rows, -1, 0)]
        at = 0
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.radii)
            if parent >= 0:
                self.kids[parent][side] = me
            p = self.points[rows].astype(np.float64)
            center = p.mean(axis=0)
            self.centers.append(center)
            self.radii.append(float(np.sqrt(((p - center) ** 2).sum(axis=1).max())))
            self.least.append(int(self.ids[rows].min()))
            spread = p.max(axis=0) - p.min(axis=0)
            if len(rows) <= leaf or not spread.any():
                # Rows that are all alike make one leaf of any size.
                self.kids.append(None)
                self.span.append((at, at + len(rows)))
                at += len(rows)
                out.append(rows)
                continue
            self.kids.append([-1, -1])
            self.span.append(None)
            half = np.argsort(p[:, int(spread.argmax())], kind="stable")
            middle = len(rows) // 2
            todo.append((np.sort(rows[half[middle:]]), me, 1))
            todo.append((np.sort(rows[half[:middle]]), me, 0))

    def search(self, query_id: int, q: np.ndarray, k: int, floor: float, exact: bool, bounds: np.ndarray) -> list[tuple[int, int]]:
        """The best ``k`` as (score, vec_id), of those that may beat the shared score ``floor``; not the query itself.

        Nodes are taken by falling upper bound; one below the k-th score (or at it, with no smaller id)
        ends the search, as all others are below it too.
        """
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < kth:
                break
            kids = self.kids[node]
            if kids is not None:
                for c in kids:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ q
            hits = np.flatnonzero(scores >= kth)
            if len(hits) > k + 1:  # ids rise within a leaf, so a stable sort breaks ties by id
                hits = hits[np.argsort(-scores[hits], kind="stable")[: k + 1]]
            for i in hits:
                if self.ids[a + i] != query_id:
                    item = (int(scores[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search_shard(k: int):
    """Cogrouped by shard and dimension: the vectors of the one, the queries (with their k-th score so far) of the other."""

    def search(key, vectors, queries):
        import pyarrow as pa

        out_q, out_v, out_s = [], [], []
        dim = key[1].as_py() if hasattr(key[1], "as_py") else key[1]
        if vectors.num_rows and queries.num_rows and dim:
            points, asked = _matrix(vectors["vec"], dim), _matrix(queries["vec"], dim)
            most = float(np.abs(points).max()) * float(np.abs(asked).max()) * dim
            exact = most < 2.0**53
            kind = np.float64 if exact else np.int64 if most < 2.0**62 else object
            tree = BallTree(vectors["vec_id"].to_numpy(), points.astype(kind))
            asked64 = asked.astype(np.float64)
            norms = np.sqrt((asked64**2).sum(axis=1))
            # The margin covers rounding of the bound.
            bounds = asked64 @ tree.centers.T + norms[:, None] * tree.radii[None, :]
            bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * (tree.radii + np.sqrt((tree.centers**2).sum(axis=1)))[None, :]) + 1e-6
            floors = queries["kth"].to_numpy(zero_copy_only=False).astype(np.float64)
            typed = asked.astype(kind)
            for i, query in enumerate(queries["query_id"].to_pylist()):
                floor = floors[i] if np.isfinite(floors[i]) else -np.inf
                for score, vec in tree.search(query, typed[i], k, floor, exact, bounds[i]):
                    out_q.append(query), out_v.append(vec), out_s.append(max(-(2**63), min(2**63 - 1, score)))
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return search


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """Each query's k best hits with their rank, by score, then the smaller id; each task keeps only k a query before they meet."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.select("query_id", "vec_id", "score", F.row_number().over(best).alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_top_k(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
    shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, block: int = BLOCK_QUERIES, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: exact top ``k`` of ``vectors`` for every row of ``queries`` (both with id and embedding).

    Vectors lie in shards of about ``shard_rows`` by the hash of their id; copies of one vector in a
    shard are searched as its ``k + 1`` smallest ids, since no others can be in a result. First each
    query meets one shard only; the k-th score it finds there is shared with its search of one shard in
    ``SECOND``, and the k-th of all these with its search of the rest; balls whose bound is below it are
    never opened. Queries go to the shards in blocks, so a task
    holds one shard and one block. Invalid vectors (null, or with null or non-finite components) take
    no part, nor do null ids; vectors of another length than the query's aren't candidates; scores
    beyond a long are cut to it. A query with fewer candidates gets those there are; a repeated row
    is a candidate of its id like any other, but an id is never its own candidate.
    """
    ship_package(spark)
    scratch = Scratch(spark, "topk")

    def ready(df: DataFrame) -> DataFrame:
        valid = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), whole_vector(F.col(f"`{embedding}`"), scale).alias("vec"))
        return valid.where("vec IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("vec"))

    # A repeated query row is one query, or its hits would count twice.
    asked = scratch.save(ready(queries).select(F.col("vec_id").alias("query_id"), "vec", "dim").dropDuplicates(["query_id", "vec"]))
    points = scratch.save(ready(vectors))
    shards = max(min_shards, -(-points.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    sharded = points.select(by_id.alias("shard"), "dim", "vec_id", "vec")
    # Of a shard's copies the k + 1 smallest ids suffice.
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    sharded = sharded.groupBy("shard", "dim", "vec").agg(ids.alias("ids")).select("shard", "dim", F.explode("ids").alias("vec_id"), "vec")
    sharded = scratch.save(sharded)
    scratch.drop(points)
    pilot = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int")
    first = asked.withColumn("shard", pilot).withColumn("kth", F.lit(None).cast("double"))

    def meet(points: DataFrame, queries: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search_shard(k), HITS)

    hits = scratch.save(meet(sharded, first, ("shard", "dim")))
    copies = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block_of = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != pilot)

    def beat(hits: DataFrame, turn: Column) -> DataFrame:
        """The best of ``hits`` and of the shards of this ``turn``, which are searched under the k-th score of ``hits``."""
        kth = top_k(hits, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        known = asked.join(kth.select("query_id", F.when(F.col("n") >= k, F.col("kth").cast("double")).alias("kth")), "query_id", "left")
        spread = known.select("query_id", "vec", "dim", "kth", block_of, F.explode(others).alias("shard")).where(turn)
        return top_k(hits.unionByName(meet(copies.where(turn), spread, ("shard", "dim", "block"))), k)

    second = F.col("shard") % SECOND == 0
    return beat(scratch.save(beat(hits, second).drop("rank")), ~second)
