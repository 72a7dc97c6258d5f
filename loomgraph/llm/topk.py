"""Exact top-k by inner product: tiles of queries against shards of vectors, then a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.runtime import stage, table


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): vectors as floor(scale * x) of doubles; vectors with a null, NaN or infinity are left out."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v")
    )


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (ids, matrix), rows in order of id."""
    lists = rows["v"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids, sizes = rows["vec_id"].to_numpy(), np.diff(lists.offsets.to_numpy())
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(size)] = ids[at], lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; by doubles, which BLAS multiplies, where no sum can leave their whole numbers."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T  # Python's whole numbers, which don't wrap
    if max(abs(x) for x in exact.reshape(-1)) >= 2**63 - 1:
        raise OverflowError("an inner product is beyond a 64-bit number")
    return exact.astype(np.int64)


_NONE = np.iinfo(np.int64).min


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores, ties to the smaller id; ``_NONE`` is no score."""
    bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), _NONE)
    row, col = np.nonzero((scores >= bound[:, None]) & (scores > _NONE))
    return _first_k(row, ids[row, col], scores[row, col], k)


def _first_k(row, ids, scores, k):
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], scores[keep]


def tile_top(queries: pa.Table, shard: pa.Table, k: int, rows: int = 8192, tile: int = 512) -> pa.Table:
    """The k best of a shard for each query, ties to the smaller id; ``rows`` by ``tile`` products at a time.

    Rows of the query's own id are taken out before the selection, however many there are, and vectors of
    another length than the query's have no product with it.
    """
    out = []
    if queries.num_rows and shard.num_rows:
        known = _by_length(shard)
        for size, (q_ids, q) in _by_length(queries).items():
            if size not in known:
                continue
            ids, c = known[size]
            for a in range(0, len(q), tile):
                own, found = q_ids[a : a + tile], (np.empty(0, np.int64),) * 3
                for b in range(0, len(c), rows):
                    part, scores = ids[b : b + rows], _products(q[a : a + tile], c[b : b + rows])
                    low, high = np.searchsorted(part, own, "left"), np.searchsorted(part, own, "right")
                    for i in np.flatnonzero(high > low):
                        scores[i, low[i] : high[i]] = _NONE
                    got = _best(scores, np.broadcast_to(part, scores.shape), k)
                    found = _first_k(*(np.concatenate(x) for x in zip(found, got, strict=True)), k)
                out.append((own[found[0]], found[1], found[2]))
    flat = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table([pa.array(x, pa.int64()) for x in flat], names=["query_id", "vec_id", "score"])


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 20_000, tile_rows: int = 20_000, fan: int = 8
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors but its own id.

    Scores are inner products of floor(scale * x); ties go to the smaller id.  Queries are dealt to
    tiles and vectors to shards of bounded size; every tile meets every shard in a task of its own,
    and the lists of shards merge ``fan`` at a time.  A query meets vectors of its own length only.  Null ids
    and vectors that are null, empty or not finite take no part.  A repeated query id keeps its least vector
    and meets none of the rows of its id; a repeated vector id keeps all its rows.  A score that no long
    holds is an error.  No rows give no rows; other columns are ignored.
    """
    base = stage(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    asked = stage(whole_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, m = base.count(), asked.count()
    shards, tiles = max(1, -(-n // shard_rows)), max(1, -(-m // tile_rows))
    if shards * tiles < 6:  # few rows: still a task for each core of a small cluster
        shards = 6
    serial = F.monotonically_increasing_id()
    dealt = base.select("vec_id", "v", F.pmod(F.xxhash64(serial), F.lit(shards)).alias("shard")).select(
        "vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    )
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile")).select(
        "vec_id", "v", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    )

    def meet(key, q, c):
        top = tile_top(q, c, k)
        return top.append_column("shard", pa.array(np.full(top.num_rows, key[0].as_py()), pa.int64()))

    lists = (
        asked.groupBy("shard", "tile")
        .cogroup(dealt.groupBy("shard", "tile"))
        .applyInArrow(meet, "query_id long, vec_id long, score long, shard long")
    )
    best = F.row_number()
    while shards > 1:
        shards = -(-shards // fan)
        merged = lists.withColumn("shard", F.floor(F.col("shard") / fan))
        over = W.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = merged.withColumn("rank", best.over(over)).where(F.col("rank") <= k)
    ranked = lists.drop("rank").withColumn("rank", best.over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five nearest of all ``embeddings`` to each whose vec_id is divisible by 50; nulls as in ``exact_top_k``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(rows, rows.where("vec_id % 50 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
