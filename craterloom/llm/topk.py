"""Exact top-k inner-product search: one ball tree per shard, best-first branch and bound.

A shard is up to SHARD_ROWS vectors of one input partition.  Its tree is built once, where the vectors
lie, and written to the shared folder.  Queries are packed into blocks of about QUERY_BLOCK; blocks and
trees are dealt by shard, so that a task reads a tree and then streams the blocks past it.  The plan
does not grow with the number of shards or blocks.

For a block the inner-product bound of every node (centre product plus query norm times radius) comes
from one matrix product; each query then opens nodes in the order of their bounds and stops at the
first that can't reach its kth score.  The current kth score is shared: it starts from a bounded
sample of all shards, rises as leaves are scored, and after a first wave, one shard in FIRST_WAVE, the
kth best of all that these found goes with the queries to all other shards.  The shards' lists (k rows
at most for a query and shard) meet in one ranking.

Defined results
---------------
* Components become floor(scale * x), x as double; scores are integer inner products, exact in 64 bits.
* A null vector, an empty one, or one with a null, NaN or infinite component takes no part, nor does
  a row with a null id.  Vectors are compared with vectors of the same length.
* A candidate is every row whose id is not the query's.  Repeated rows are candidates each; a query
  id that occurs on several rows is searched once, with its smallest vector.
* Equal scores go to the smaller id.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterloom.llm.core import tidy, written

QUERY_BLOCK, SHARD_ROWS = 8192, 1 << 16
LEAF = 96
#: Rows, about, of the sample from which each query's kth score starts; each row has the same chance.
SAMPLE = 4096
#: One shard in so many is searched first; with fewer shards there is one wave.
FIRST_WAVE = 8
#: Shards whose numbers (16 bytes each) may be broadcast to the query blocks.
FEW_SHARDS = 100_000


class BallTree:
    """Nodes (centre, radius, first, last) over a permutation of the rows of x; children of i at left[i], left[i] + 1."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        centre, radius, first, last, left = [], [], [], [], []

        def node(a: int, b: int) -> int:
            own = x[self.order[a:b]]
            c = own.mean(0)
            centre.append(c)
            radius.append(float(np.sqrt(((own - c) ** 2).sum(1).max())))
            first.append(a)
            last.append(b)
            left.append(-1)
            return len(left) - 1

        todo = [node(0, len(x))]
        while todo:
            i = todo.pop()
            a, b = first[i], last[i]
            if b - a <= leaf or radius[i] == 0:
                continue
            own = x[self.order[a:b]]
            p = own[((own - centre[i]) ** 2).sum(1).argmax()]
            q = own[((own - p) ** 2).sum(1).argmax()]
            side = own @ (q - p)
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
            left[i] = node(a, a + half)
            node(a + half, b)
            todo += [left[i], left[i] + 1]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last, self.left = first, last, left


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class Shard:
    """A ball tree with its vectors and ids in the tree's order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.tree = BallTree(x.astype(np.float64), leaf)
        self.ids, self.x = ids[self.tree.order], _small(x[self.tree.order])
        del self.tree.order

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """For each query its rows (id, score, row id) that can be in its k best; floor: a score that k rows reach."""
        tree, ids = self.tree, self.ids
        # doubles where all inner products are exact that way, else 64-bit integers
        exact = np.float64 if float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(self.x.astype(np.float64)).max(initial=0)) * self.x.shape[1] < 2**52 else np.int64
        rows, qx, qf = self.x.astype(exact), q.astype(exact), q.astype(np.float64)
        norm = np.sqrt((qf**2).sum(1))
        for lo in range(0, len(q), 512):
            bound = qf[lo:lo + 512] @ tree.centre.T + norm[lo:lo + 512, None] * tree.radius
            bound += 1e-9 * np.abs(bound) + 0.5  # rounding
            for i in range(len(bound)):
                ub, at, least = bound[i], qx[lo + i], floor[lo + i]
                mine = query_ids[lo + i]
                scores, found = [], []
                heap = [(-ub[0], 0)]
                while heap and -heap[0][0] >= least:
                    n = heapq.heappop(heap)[1]
                    if (child := tree.left[n]) >= 0:
                        for c in (child, child + 1):
                            if ub[c] >= least:
                                heapq.heappush(heap, (-ub[c], c))
                        continue
                    a, b = tree.first[n], tree.last[n]
                    s = rows[a:b] @ at
                    keep = np.flatnonzero((s >= least) & (ids[a:b] != mine))
                    if len(keep):
                        scores.append(s[keep])
                        found.append(ids[a:b][keep])
                        if sum(map(len, scores)) > 4 * k:
                            scores, found = _best(scores, found, k)
                            least = max(least, scores[0][-1])
                if scores:
                    scores, found = _best(scores, found, k)
                    yield mine, scores[0], found[0]


def _best(scores: list, found: list, k: int):
    s, v = np.concatenate(scores), np.concatenate(found)
    order = np.lexsort((v, -s))[:k]
    return [s[order]], [v[order]]


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    return df.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _by_length(batch: pa.RecordBatch):
    """Rows of a batch (id, v) by the length of their vectors: length, the rows' places, ids and a matrix."""
    v = batch["v"]
    lengths = np.diff(v.offsets.to_numpy())
    flat, ids, first = v.values.to_numpy(zero_copy_only=False), batch["id"].to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, ids[at], flat[(first[:-1][at][:, None] + np.arange(n))]


def _shards(rows: DataFrame, leaf: int, shard_rows: int) -> DataFrame:
    """shard, length, payload: the trees of each partition's vectors."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def tree(n: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(c) for c in zip(*held.pop(n)))
            made += 1
            payload = pickle.dumps(Shard(ids, x, leaf), 5)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + made - 1], pa.int64()), pa.array([n], pa.int32()), pa.array([payload], pa.binary())], ["shard", "length", "payload"])

        for b in batches:
            for n, _, ids, x in _by_length(b):
                held.setdefault(n, []).append((ids, _small(x)))
                if sum(len(i) for i, _ in held[n]) >= shard_rows:
                    yield tree(n)
        for n in list(held):
            yield tree(n)

    return rows.mapInArrow(tidy(run), "shard long, length int, payload binary")


def _blocks(asked: DataFrame, blocks: int, k: int, sample) -> DataFrame:
    """block, length, payload: queries with the score that their kth best has at least."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            floors = b["floor"].to_numpy(zero_copy_only=False)  # null: NaN
            for n, at, ids, q in _by_length(b):
                floor = np.where(np.isnan(floors[at].astype(np.float64)), -np.inf, floors[at].astype(np.float64))
                near = sample.value.get(n)
                if near is not None and len(near[0]) > k:
                    for lo in range(0, len(q), 512):
                        s = (q[lo:lo + 512] @ near[1].T).astype(np.float64)
                        s[ids[lo:lo + 512, None] == near[0]] = -np.inf
                        floor[lo:lo + 512] = np.maximum(floor[lo:lo + 512], np.partition(s, -k, axis=1)[:, -k])
                made += 1
                payload = pickle.dumps((ids, _small(q), floor), 5)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + made], pa.int64()), pa.array([n], pa.int32()), pa.array([payload], pa.binary())], ["block", "length", "payload"])

    return asked.repartition(blocks, "id").mapInArrow(tidy(run), "block long, length int, payload binary")


def _searched(shards: DataFrame, blocks: DataFrame, few: bool, k: int) -> DataFrame:
    """query_id, vec_id, score: what the shards found for the blocks.  A shard's tree comes before its blocks."""
    def run(batches):
        shard, lists = None, []

        def batch():
            out = [np.concatenate(c) for c in zip(*lists)]
            lists.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

        for b in batches:
            for seq, payload in zip(b["seq"].to_pylist(), b["payload"]):
                if seq < 0:
                    shard = pickle.loads(payload.as_py())
                    continue
                for mine, s, v in shard.search(*pickle.loads(payload.as_py()), k):
                    lists.append((np.full(len(s), mine), v, s.astype(np.int64)))
                    if len(lists) == 500:
                        yield batch()
        if lists:
            yield batch()

    numbers = shards.select("shard", "length")
    asked = blocks.join(F.broadcast(numbers) if few else numbers, "length").select("shard", F.col("block").alias("seq"), "payload")
    stream = shards.select("shard", F.lit(-1).cast("long").alias("seq"), "payload").unionByName(asked)
    return stream.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(tidy(run), "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
          query_block: int = QUERY_BLOCK, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, first_wave: int = FIRST_WAVE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row of df."""
    spark = df.sparkSession
    rows = _vectors(df, id_col, vector_col, scale)
    asked = written(_vectors(df.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards = written(_shards(rows, leaf, shard_rows), "trees")
    n, n_shards = asked.count(), shards.count()
    drawn = rows.sample(min(1.0, SAMPLE / max(1, df.count())), seed=7).toArrow().combine_chunks().to_batches()
    near = spark.sparkContext.broadcast({length: (ids, x) for b in drawn for length, _, ids, x in _by_length(b)})
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = F.pmod(F.xxhash64("shard"), F.lit(first_wave)) == 0
    # a block is what one Arrow batch of a partition holds
    blocks = lambda floors: _blocks(floors, max(1, -(-n // query_block)), k, near)
    search = lambda wave, floors: _searched(shards.where(wave), blocks(floors), n_shards <= FEW_SHARDS, k)
    start = asked.withColumn("floor", F.lit(None).cast("double"))
    if n_shards < first_wave:
        out = search(F.lit(True), start)
    else:
        begun = written(ranked(search(first, start)).drop("rank"), "found")
        kth = begun.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("floor")).where(F.col("m") == k)
        risen = asked.join(kth.select(F.col("query_id").alias("id"), F.col("floor").cast("double").alias("floor")), "id", "left")
        out = begun.unionByName(search(~first, risen))
    return ranked(out).select("query_id", "rank", "vec_id", "score")


def op10_ball_tree_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose vec_id is divisible by 20, against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
