"""Exact top-k search by inner product with norm-bucketed retrieval.

Items are grouped by length (classes of a fixed ratio), large classes split by hash. Each
query first meets one bucket of long items; its k-th score there is a lower bound for the
whole search. A bucket then matters to a query only if bound / (query length * longest
item) is at most 1. That quotient is the bucket's local cosine threshold: where it is high,
items are sieved by the intervals it leaves to the query's largest coordinates, else by
length alone. What is left is verified by exact integer products.

Queries meet items in blocks: a task holds one block of queries and one bucket, both of
bounded size, however long or popular a class is. Pruned pairs of block and bucket are never shuffled.

Vectors that are null, or hold null or non-finite components, take no part, nor do
rows without an id; vectors of different dimension do not meet. A query's own id is not
its result. Ties go to the smaller id. Repeated ids are separate items. Components and
products beyond 64 bits saturate. Empty tables give no rows; a query with no candidates has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import table
from meshloom.session import store_once

FOUND = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, vec (array of long: floor(scale * component)) and norm of the vectors that take part."""
    v = F.col(f"`{vector}`")

    def unfit(x: Column) -> Column:
        d = x.cast("double")
        return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))

    return (
        df.filter(v.isNotNull() & F.col(f"`{id_column}`").isNotNull() & ~F.coalesce(F.exists(v, unfit), F.lit(False)))
        .select(
            F.col(f"`{id_column}`").cast("long").alias("id"),
            F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"),
        )
        .withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    )


def bucketed(items: DataFrame, ratio: float, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Items with dim, class and part; and a table with a row a bucket: its rows and longest item."""
    classed = items.withColumn("dim", F.size("vec")).withColumn(
        "class", F.when(F.col("norm") > 0, F.floor(F.ln("norm") / -math.log(ratio))).otherwise(-1).cast("int")
    )
    parts = classed.groupBy("dim", "class").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("parts"))
    placed = classed.join(parts, ["dim", "class"]).withColumn("part", F.pmod(F.xxhash64("id", "vec"), "parts").cast("int"))
    placed = placed.select("dim", "class", "part", "id", "vec", "norm")
    buckets = placed.groupBy("dim", "class", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.max("norm").alias("longest")
    )
    return placed, buckets


class Bucket:
    """The items of a bucket, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.norms = ids[order], norms[order]
        self.whole = vectors[order]
        self.exact = self.whole.astype(np.float64)
        self.unit = self.exact / np.maximum(self.norms, 1e-300)[:, None]

    def candidates(self, query: np.ndarray, norm: float, bound: float, focus: int, steep: float) -> np.ndarray:
        """Places of the items that may reach ``bound``."""
        if not np.isfinite(bound) or bound <= 0 or norm == 0 or not len(self.ids):
            return np.arange(len(self.ids))
        slack = 1e-9
        need = bound / norm * (1 - slack)
        reach = int(np.searchsorted(-self.norms, -need, side="right"))
        cosine = bound / (norm * self.norms[0]) if self.norms[0] else np.inf
        if not reach or cosine < steep:
            return np.arange(reach)
        # An item needs at least this cosine: its angle to each axis differs from the query's by no more than
        # the angle of that cosine.
        theta = min(1.0, cosine) * (1 - slack)
        unit, keep = query / norm, np.ones(reach, dtype=bool)
        for f in np.argsort(-np.abs(unit))[:focus]:
            room = math.sqrt(max(0.0, (1 - theta**2) * (1 - unit[f] ** 2))) + slack
            x = self.unit[:reach, f]
            if unit[f] > -theta:
                keep &= x >= theta * unit[f] - room
            if unit[f] < theta:
                keep &= x <= theta * unit[f] + room
        return np.flatnonzero(keep)

    def scores(self, at: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        if norm * (self.norms[0] if len(self.norms) else 0) < 2.0**52:
            return (self.exact[at] @ query.astype(np.float64)).astype(np.int64)
        products = (self.whole[at].astype(object) * query.astype(object)).sum(axis=1)
        limits = np.iinfo(np.int64)
        return np.array([min(max(int(p), limits.min), limits.max) for p in products], dtype=np.int64)


def search_block(queries: pd.DataFrame, items: pd.DataFrame, k: int, focus: int, steep: float) -> pd.DataFrame:
    """The best ``k`` of one bucket for each query of one block."""
    out: list[tuple[int, int, int]] = []
    if len(queries) and len(items) and len(items["vec"].iloc[0]):
        bucket = Bucket(items["id"].to_numpy(), np.stack(items["vec"].to_numpy()), items["norm"].to_numpy())
        rows = zip(queries["id"].tolist(), queries["vec"], queries["norm"].tolist(), queries["bound"].tolist(), strict=True)
        for query_id, vector, norm, bound in rows:
            bound = -np.inf if bound is None or np.isnan(bound) else bound
            at = bucket.candidates(vector, norm, bound, focus, steep)
            at = at[bucket.ids[at] != query_id]
            score = bucket.scores(at, vector, norm)
            best = np.lexsort((bucket.ids[at], -score))[:k]
            out += [(query_id, int(bucket.ids[at[b]]), int(score[b])) for b in best if score[b] >= bound]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_products(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    ratio: float = 0.9,
    bucket_rows: int = 16384,
    block_rows: int = 2048,
    focus: int = 3,
    steep: float = 0.6,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best items of every query.

    Both tables have id, vec and norm, as ``integer_vectors`` gives them.
    """
    placed, buckets = bucketed(items, ratio, bucket_rows)
    placed, buckets = store_once(placed, "items"), store_once(buckets, "buckets")
    blocks = max(1, math.ceil(queries.count() / block_rows))
    asked = queries.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    key = ["dim", "class", "part", "block"]

    def met(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
        """Results of the given pairs of block and bucket."""
        # Both sides derive from the same tables: names of their own keep the keys apart.
        left = bounds.join(pairs, ["dim", "block"]).select(
            *[F.col(c).alias(f"asked_{c}") for c in key], "id", "vec", "norm", "bound"
        )
        right = placed.join(pairs, ["dim", "class", "part"]).select(*key, "id", "vec", "norm")
        return (
            left.groupBy(*[f"asked_{c}" for c in key])
            .cogroup(right.groupBy(*key))
            .applyInPandas(lambda q, i: search_block(q, i, k, focus, steep), FOUND)
        )

    longest = Window.partitionBy("dim").orderBy(F.col("rows") > 16 * k, "longest", "class", "part")
    first = buckets.withColumn("_seed", F.row_number().over(longest) == F.count(F.lit(1)).over(Window.partitionBy("dim")))
    # One row a block and dimension, and one a bucket: n / bucket_rows rows.
    pairs = asked.select("dim", "block").distinct().join(first, "dim")
    seeds = store_once(met(pairs.filter("_seed"), asked.withColumn("bound", F.lit(None).cast("double"))), "seeds")
    bound = seeds.groupBy("query_id").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    bound = bound.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("bound").cast("double"))
    bounded = asked.join(bound, "id", "left")
    # The shortest item that any query of a block still needs.
    need = bounded.groupBy("dim", "block").agg(
        F.min(F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)).alias("need")
    )
    rest = pairs.filter("not _seed").join(need, ["dim", "block"]).filter("longest >= need")
    found = seeds.unionByName(met(rest, bounded))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_norm_buckets(spark, sf_dir):
    items = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_products(items.filter("id % 50 = 0"), items)


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
