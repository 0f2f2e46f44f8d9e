"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id, and each shard becomes one ball tree. Queries go through the trees
in blocks: nodes are visited in order of their upper bound, the inner product with the centre plus the query's norm
times the radius, and left out where it lies below the query's current k-th score. A block first searches one shard;
the k-th scores found there go with it to all other shards.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import clamp, cut

NONE = np.iinfo(np.int64).min


def build(ids: np.ndarray, x: np.ndarray, leaf: int = 128) -> dict:
    """A ball tree: points by leaf, ascending by id there; for each node its centre, radius, and children or range."""
    order, nodes = np.argsort(ids, kind="stable"), []

    def split(at: np.ndarray, to: list) -> int:
        p = x[at].astype(np.float64)
        centre = p.mean(axis=0)
        far = np.sqrt(((p - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([centre, far.max() * (1 + 1e-9) + 1e-9, -1, -1, len(to), len(to)])
        if len(at) <= leaf:
            to.extend(np.sort(at))
            nodes[me][5] = len(to)
            return me
        # across the line between the point farthest from the centre and the one farthest from that
        a = p[far.argmax()]
        b = p[((p - a) ** 2).sum(axis=1).argmax()]
        half = np.argsort(p @ (b - a), kind="stable")
        nodes[me][2] = split(at[half[: len(at) // 2]], to)
        nodes[me][3] = split(at[half[len(at) // 2 :]], to)
        return me

    to: list = []
    ids, x = ids[order], x[order]
    split(np.arange(len(ids)), to)
    t = np.array(to)
    centres, radii, left, right, first, last = map(np.array, zip(*nodes, strict=True))
    return {"ids": ids[t], "x": x[t], "centres": centres, "radii": radii, "left": left, "right": right, "first": first, "last": last}


def search(tree: dict, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best in the tree, best first, ties to the smaller id; NONE where there are fewer.

    A vector with the query's own id is left out. floor: scores below which a query needs none.
    """
    n, big = len(ids), max(1, abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(1, abs(int(tree["x"].max(initial=0))), abs(int(tree["x"].min(initial=0)))) * max(1, q.shape[1])
    exact = np.float64 if big < 1 << 53 else np.int64
    x, qx, qf = tree["x"].astype(exact), q.astype(exact), q.astype(np.float64)
    top, who = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
    floor = np.full(n, NONE, np.int64) if floor is None else floor.copy()
    bound = qf @ tree["centres"].T + np.sqrt((qf**2).sum(axis=1))[:, None] * tree["radii"]
    bound += np.abs(bound) * 1e-9 + 1e-6
    heap = [(-bound[:, 0].max(initial=-np.inf), 0, np.arange(n))]
    while heap:
        _, node, live = heapq.heappop(heap)
        live = live[bound[live, node] >= floor[live]]
        if not len(live):
            continue
        if tree["left"][node] >= 0:
            for child in (tree["left"][node], tree["right"][node]):
                if len(some := live[bound[live, child] >= floor[live]]):
                    heapq.heappush(heap, (-bound[some, child].max(), int(child), some))
            continue
        a, b = tree["first"][node], tree["last"][node]
        s = (qx[live] @ x[a:b].T).astype(np.int64)
        s[ids[live][:, None] == tree["ids"][a:b]] = NONE
        best = np.argsort(-s.astype(np.float64) if exact is np.float64 else ~s, axis=1, kind="stable")[:, :k]
        s, w = np.hstack([top[live], np.take_along_axis(s, best, 1)]), np.hstack([who[live], tree["ids"][a:b][best]])
        w[s == NONE] = np.iinfo(np.int64).max
        best = np.lexsort((w, ~s), axis=1)[:, :k]
        top[live], who[live] = np.take_along_axis(s, best, 1), np.take_along_axis(w, best, 1)
        floor[live] = np.maximum(floor[live], top[live, k - 1])
    return top, who


def _matrix(t: pa.Table, name: str, dim: int) -> np.ndarray:
    return np.asarray(t.column(name).combine_chunks().flatten(), np.int64).reshape(-1, dim)


def usable(v: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of each query with the largest inner products, exactly.

    Both tables: vec_id long, v array<long>. A vector is no candidate of a query with its id; equal scores go to the
    smaller id; with fewer than k candidates all are returned. Rows with a null id or null v take no part, and only
    vectors of a query's own length are its candidates. A repeated query row is answered once, a repeated candidate
    row is as many candidates. Empty tables give no rows; other columns are not read.
    """
    dim = F.size("v").alias("dim")
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v", dim)
    queries = queries.where("vec_id is not null and v is not null").select("vec_id", "v", dim).dropDuplicates(["vec_id", "v"])
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def plant(key: tuple, t: pa.Table) -> pa.Table:
        tree = build(np.asarray(t.column("vec_id")), _matrix(t, "v", key[0].as_py()))
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "tree": [pickle.dumps(tree)]}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())]))

    def bundle(key: tuple, t: pa.Table) -> pa.Table:
        b = (np.asarray(t.column("vec_id")), _matrix(t, "v", key[0].as_py()), None)
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "queries": [pickle.dumps(b)]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("queries", pa.binary())]))

    trees = cut(vectors.withColumn("shard", dealt(shards, "shard")).groupBy("dim", "shard").applyInArrow(plant, "dim int, shard int, tree binary"))
    bundles = queries.withColumn("block", dealt(blocks, "block")).groupBy("dim", "block").applyInArrow(bundle, "dim int, block int, queries binary")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q, _ = pickle.loads(r["queries"])
                top, who = search(pickle.loads(r["tree"]), ids, q, k) if r["tree"] else (np.full((len(ids), k), NONE, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([pickle.dumps((ids, q, top, who))], pa.binary())], ["dim", "block", "queries"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for r in batch.to_pylist():
                ids, q, top, who = pickle.loads(r["queries"])
                if r["tree"]:
                    top, who = search(pickle.loads(r["tree"]), ids, q, k, top[:, k - 1])
                found = top != NONE
                key = np.repeat(np.arange(len(ids)), found.sum(axis=1))
                nth = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in q], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[key]), pa.array(nth[key]), pa.array(who[found]), pa.array(top[found])], ["query_id", "q", "vec_id", "score"])

    home = F.pmod("block", F.lit(shards)).cast("int")
    started = cut(bundles.withColumn("shard", home).join(trees, ["dim", "shard"], "left").select("dim", "block", "queries", "tree").mapInArrow(first, "dim int, block int, queries binary"))
    every = trees.select("dim", "shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = every.join(started, ["dim", "block"]).where(F.col("shard") != home).select("queries", "tree")
    pairs = pairs.unionByName(started.select("queries", F.lit(None).cast("binary").alias("tree"))).repartition(clamp(shards * blocks, 1, 1 << 16))
    best = pairs.mapInArrow(others, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    v = e.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return top_k(v, v.where("vec_id % 50 = 0"))


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
