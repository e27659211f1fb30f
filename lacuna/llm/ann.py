"""Approximate nearest neighbours by permutations: inverted files of near pivots, footrule ranking, exact rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 128, 32  #: pivots, and how many of the nearest a vector is posted under
SHARD, SHARDS = 4096, 16  #: vectors in a shard, and the fewest shards
QUERY_BLOCK = 4096  #: queries that meet a shard at once
RERANK, RERANK_LEAST = 0.25, 160  #: share of a shard's vectors, and the fewest, measured exactly for a query; ties are all kept
_OUT = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b, for ranking."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties by the pivots' order."""
    return np.argsort(distances(vectors, pivots), axis=1, kind="stable")[:, : min(prefix, len(pivots))].astype(np.int16)


class Posts:
    """Inverted files of one shard: for each pivot the vectors that hold it, and at which place."""

    def __init__(self, perms: np.ndarray, pivots: int):
        self.n, self.prefix = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.row, self.place = order // self.prefix, order % self.prefix
        self.edges = np.searchsorted(flat[order], np.arange(pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a permutation prefix to each vector's; a pivot missing from a prefix counts as next after it."""
        m, near = self.prefix, np.zeros(self.n)
        for place, pivot in enumerate(perm.tolist()):
            at = slice(self.edges[pivot], self.edges[pivot + 1])
            near[self.row[at]] += (m - place) + (m - self.place[at]) - np.abs(place - self.place[at])
        return m * (m + 1) - near


def search(ids: np.ndarray, vectors: np.ndarray, perms: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, q_perms: np.ndarray, k: int, pivots: int, rerank: float = RERANK):
    """The k nearest of a shard for each query: query_id, vec_id, score."""
    posts, found = Posts(perms, pivots), []
    c = min(len(ids), max(RERANK_LEAST, int(rerank * len(ids)), k + 1))
    for qid, q, perm in zip(q_ids.tolist(), queries, q_perms, strict=True):
        rule = posts.footrule(perm)
        near = np.flatnonzero(rule <= np.partition(rule, c - 1)[c - 1])
        near = near[ids[near] != qid]
        d = np.sqrt(((vectors[near] - q) ** 2).sum(axis=1))
        best = np.lexsort((ids[near], d))[:k]
        found.append((np.full(len(best), qid), ids[near[best]], d[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    vec = F.col("vec")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0))


def nearest(df: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: float = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other rows of each row for which `queries` (a condition on vec_id) holds.

    Null, zero and non-finite vectors and rows without an id take no part, nor do vectors of another length than the
    most common one. Rows that share an id count once, with the smallest of their vectors. Ties go to the smaller id. An
    empty table, or one without valid vectors, gives no rows. The pivots are a bounded sample, the vectors with the
    smallest hashed ids; every vector is posted.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect() if n else []
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = np.unique(np.array([r["vec"] for r in sample], np.float64), axis=0)
    shards = max(SHARDS, -(-n // SHARD))
    n_queries = rows.filter(queries).count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def post(batches):
        for b in batches:
            if b.num_rows:
                perms = permutations(_matrix(b.column(2)), pivots)
                flat = pa.array(perms.ravel().astype(np.int16))
                offsets = pa.array(np.arange(len(perms) + 1) * perms.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "asked", "vec", "perm"])

    indexed = rows.select("vec_id", F.coalesce(queries, F.lit(False)).alias("asked"), "vec").mapInArrow(post, "vec_id long, asked boolean, vec array<double>, perm array<short>")
    block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(7)), F.lit(blocks))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    base = indexed.withColumn("own", shard)
    posted = base.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("own") * blocks + b))).select("cell", "vec_id", "vec", "perm")
    asked = base.filter("asked").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * blocks + block("vec_id")))).select("cell", "vec_id", "vec", "perm")
    n_pivots = len(pivots)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for t in (left, right):
            t = t.combine_chunks()
            ids = t["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            if len(ids):
                vec, perm = (_matrix(t[c].chunk(0))[order] for c in ("vec", "perm"))
                parts.append((ids[order], vec, perm.astype(np.int64)))
        found = search(*parts[0], *parts[1], k, n_pivots, rerank) if len(parts) == 2 else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    hits = posted.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(meet, _OUT)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
