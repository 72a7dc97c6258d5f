"""Search has no limit on the number of queries."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import retrieval

MANY = 10_001


def test_vector_search_in_blocks(spark):
    r = np.random.default_rng(3)
    rec, ask = r.integers(-3, 4, (50, 3)).astype(float), r.integers(1, 5, (MANY, 3)).astype(float)
    records = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rec)] + [(99, None)], "record_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "query_id long, vector array<double>")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    scores = np.round(unit(ask) @ unit(rec).T, 6)
    want = {(i, n, int(c)) for i in range(MANY) for n, c in enumerate(np.lexsort((np.arange(50), -scores[i]))[:3], 1)}
    got = retrieval.vector_search(queries, records, k=3, shard_rows=20).select("query_id", "rank", "record_id").collect()
    assert len(got) == 3 * MANY and {tuple(x) for x in got} == want
    assert retrieval.vector_search(queries.limit(0), records).count() == 0 and retrieval.vector_search(queries.limit(5), records.limit(0)).count() == 0


def test_lexical_search_in_blocks(spark):
    queries = spark.range(MANY).select(F.col("id").alias("query_id"), F.concat(F.lit("word"), (F.col("id") % 3).cast("string")).alias("query"))
    records = spark.createDataFrame([(7, "a word0 here"), (8, "word1"), (9, "word0 again")], "record_id long, text string")
    got = retrieval.lexical_search(queries, records).select("query_id", "record_id", "score", "rank").collect()
    want = {(i, c, 7.0, n) for i in range(MANY) for n, c in enumerate({0: (7, 9), 1: (8,)}.get(i % 3, ()), 1)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
