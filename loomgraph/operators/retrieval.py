"""Retrieval for batches of queries: search, fusion, reranking, context.

Every frame is keyed by query_id.  Substring searches broadcast at most ``BLOCK_QUERIES`` queries of a checked size; more
are dealt to blocks of about that size, each of which meets each shard of the records in a task of its own.  Vector
search always deals queries to blocks and records to shards.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import blank_to_null, first_filled
from loomgraph.runtime import stage

# Words that are no keywords.
EN_STOPWORDS = ["a", "an", "the", "is", "are", "was", "were", "be", "to", "of", "for", "and", "or", "in", "on", "at", "with", "by", "from", "what", "how", "why", "when", "where", "which", "who"]
ZH_STOPWORDS = ["对", "请", "一下", "一个", "这个", "那个", "我们", "你们", "他们", "是否", "什么", "怎么", "如何"]
# Weights of sources.
FUSION_WEIGHTS = {"vector": 1.0, "graph": 1.2, "keyword": 0.8, "vision": 1.0}
RERANK_WEIGHTS = {"vector": 1.0, "graph": 1.1, "keyword": 0.9, "vision": 1.0}
TURN_ORDER = ["vector", "graph", "keyword", "vision"]


#: Queries that one task of word search holds.
BLOCK_QUERIES = 10_000


#: Bytes of queries that are broadcast at most; more are dealt to blocks that meet shards of records.
BROADCAST_BYTES = 32_000_000


class _Needles:
    """Strings to look for, each with the queries that want it: one pass over a text finds all that occur in it."""

    def __init__(self, queries: pd.DataFrame):
        self.ids, self.size = queries["query_id"].to_numpy(), np.maximum(queries["_t"].map(len).to_numpy(), 1)
        wanted: dict[str, list[int]] = {}
        for i, words in enumerate(queries["_t"]):
            for w in filter(None, words):
                wanted.setdefault(w, []).append(i)
        whole: dict[str, list[int]] = {}
        for i, q in enumerate(queries["_q"]):
            if q:
                whole.setdefault(q, []).append(i)
        self.words, self.whole = ([np.array(x.get(w, ()), np.int64) for w in {**wanted, **whole}] for x in (wanted, whole))
        self.find = ahocorasick.Automaton()
        for n, w in enumerate({**wanted, **whole}):
            self.find.add_word(w, n)
        self.find.make_automaton()

    def scores(self, text: str, per_word: float, per_whole: float) -> np.ndarray:
        out = np.zeros(len(self.ids))
        found = list({n for _, n in self.find.iter(text)}) if len(self.find) else []
        if found:
            hits = np.concatenate([self.words[n] for n in found])
            out += per_word * np.bincount(hits, minlength=len(out)) / self.size
            out[np.concatenate([self.whole[n] for n in found])] += per_whole
        return out

    def best(self, records: pd.DataFrame, k: int, per_word: float, per_whole: float, bonus: bool) -> list[pd.DataFrame]:
        """Each query's k best of the records, 256 records at a time; only what was found counts."""
        out = []
        for a in range(0, len(records), 256):
            part = records.iloc[a : a + 256].sort_values("record_id", kind="stable")
            base = np.stack([self.scores(t or "", per_word, per_whole) for t in part["_x"]])
            score = np.where(base > 0, np.round(base + (part["_bonus"].to_numpy()[:, None] if bonus else 0.0), 6), -1.0)
            at = np.argsort(-score, axis=0, kind="stable")[:k]
            top = np.take_along_axis(score, at, 0)
            row, query = np.nonzero(top > 0)
            out.append(pd.DataFrame({"query_id": self.ids[query], "record_id": part["record_id"].to_numpy()[at[row, query]], "score": top[row, query], "text": part["text"].to_numpy()[at[row, query]]}))
        return out


def _best_of(lists: list[pd.DataFrame], k: int) -> pd.DataFrame:
    one = pd.concat(lists).sort_values(["score", "record_id"], ascending=[False, True], kind="stable")
    return one.groupby("query_id", sort=False).head(k)


def substring_search(queries: DataFrame, records: DataFrame, k: int, per_word: float, per_whole: float, bonus: bool = False, block: int = BLOCK_QUERIES, shard_rows: int = 20_000) -> DataFrame:
    """(query_id, record_id, score, text): for each part of the records each query's k best, to be merged.

    queries: query_id, _t (strings), _q (one string or null); records: record_id, text, _x (text to search), _bonus.  A record's score is
    ``per_word`` times the share of the strings that occur in it, ``per_whole`` if _q does, and its bonus if either is
    positive.  Every string of all queries is looked for in one pass over a record.  Queries of a checked number and size are
    broadcast and records stay where they are; more queries are dealt to blocks, each of which meets each shard of records in
    a task of its own.  A text must be a string, queries with no string find nothing, and no rows give no rows.
    """
    shape = f"query_id {dict(queries.dtypes)['query_id']}, record_id {dict(records.dtypes)['record_id']}, score double, text string"
    asked = stage(queries.select("query_id", "_t", "_q"), "queries")
    found = records.select("record_id", "text", "_x", "_bonus")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("_t", " ")) + F.length(F.coalesce("_q", F.lit("")))), F.lit(0)).alias("chars")).first()
    if size.n <= block and size.chars <= BROADCAST_BYTES:
        known = queries.sparkSession.sparkContext.broadcast(asked.toPandas())

        def run(parts):
            needles, best = None, []
            for pdf in parts:
                needles = needles or _Needles(known.value)
                best = [_best_of(best + needles.best(pdf, k, per_word, per_whole, bonus), k)] if len(pdf) and len(known.value) else best
            yield from best

        return found.mapInPandas(run, shape)
    base = stage(found, "records")
    blocks, shards = max(1, -(-size.n // block)), max(1, -(-base.count() // shard_rows))
    blocks = max(blocks, -(-size.chars // BROADCAST_BYTES))

    def meet(q, r):
        empty = pd.DataFrame({"query_id": q["query_id"][:0], "record_id": r["record_id"][:0], "score": np.empty(0), "text": r["text"][:0]})
        return _best_of(_Needles(q).best(r, k, per_word, per_whole, bonus), k) if len(q) and len(r) else empty

    return _deal(asked, "block", blocks, "shard", shards).groupBy("block", "shard").cogroup(_deal(base, "shard", shards, "block", blocks).groupBy("block", "shard")).applyInPandas(meet, shape)


def _deal(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
    """Rows dealt to ``n`` parts by hash, each copied for the ``m`` parts that it meets."""
    return df.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def extract_keywords(queries: DataFrame, max_keywords: int = 12) -> DataFrame:
    """keywords, the first half high and the rest low (R1); Han characters tell the language."""
    q = F.trim(F.coalesce("query", F.lit("")))
    zh = q.rlike("[一-鿿]")
    zh_words = F.filter(F.split(q, r"[，。！？；：、（）()\[\]\s,.;:!?]+"), lambda w: (F.length(w) >= 2) & ~w.isin(ZH_STOPWORDS))
    en_words = F.filter(F.regexp_extract_all(q, F.lit(r"([A-Za-z][A-Za-z0-9_\-]{1,})"), 1), lambda w: ~F.lower(w).isin(EN_STOPWORDS))
    words = F.when(zh, zh_words).otherwise(en_words)
    first = F.filter(F.col("_w"), lambda w, i: ~F.exists(F.slice("_w", 1, i), lambda v: F.lower(v) == F.lower(w)))
    half = F.greatest(F.lit(1), F.floor(F.size("keywords") / 2).cast("int"))
    out = queries.withColumn("language", F.when(zh, "zh").otherwise("en")).withColumn("_w", words).withColumn("keywords", F.slice(first, 1, max(1, max_keywords))).drop("_w")
    return out.withColumn("high", F.slice("keywords", 1, half)).withColumn("low", F.when(F.size("keywords") > half, F.slice("keywords", half + 1, F.size("keywords"))).otherwise(F.array().cast("array<string>")))


def lexical_search(queries: DataFrame, records: DataFrame, k: int = 10) -> DataFrame:
    """+5 for the whole query as a substring, +2 times the share of its tokens that occur; positive scores only (R2).

    Null texts and blank queries find nothing; ties go to the smaller record_id.
    """
    q = queries.select("query_id", F.lower(F.trim("query")).alias("_q")).withColumn("_t", F.array_distinct(F.filter(F.split("_q", r"\s+"), lambda w: w != ""))).where("_q != ''")
    rows = records.where(F.col("text").isNotNull()).select("record_id", "text", F.lower("text").alias("_x"), F.lit(0.0).alias("_bonus"))
    return top_k(substring_search(q, rows, k, 2.0, 5.0), k, F.desc("score"), "record_id")


def vector_search(queries: DataFrame, records: DataFrame, k: int = 10, block_rows: int = 2_000, shard_rows: int = 20_000) -> DataFrame:
    """Cosine over all records, for any number of queries.

    Each block of queries meets each shard of records in a task of its own, which keeps k per query; then one merge.
    Null vectors take no part.
    """
    asked = stage(queries.select("query_id", "vector").where("vector is not null"), "queries")
    base = stage(records.select("record_id", "vector").where("vector is not null"), "records")
    blocks, shards = max(1, -(-asked.count() // block_rows)), max(1, -(-base.count() // shard_rows))
    unit = lambda col: (v := np.stack(col.to_numpy()).astype(np.float64)) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def meet(q, c):
        got = [pd.DataFrame({"query_id": q["query_id"][:0], "record_id": c["record_id"][:0], "score": np.empty(0)})]
        if len(q) and len(c):
            c = c.sort_values("record_id", kind="stable")
            rec, v, asks, names = c["record_id"].to_numpy(), unit(c["vector"]).T, unit(q["vector"]), q["query_id"].to_numpy()
            for a in range(0, len(names), 256):
                scores = np.round(asks[a : a + 256] @ v, 6)
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(scores, at, 1)
                got.append(pd.DataFrame({"query_id": np.repeat(names[a : a + 256], at.shape[1]), "record_id": rec[at].reshape(-1), "score": best.reshape(-1)}))
        return pd.concat(got[1:] or got)

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, record_id {dict(records.dtypes)['record_id']}, score double"
    found = _deal(asked, "block", blocks, "shard", shards).groupBy("block", "shard").cogroup(_deal(base, "shard", shards, "block", blocks).groupBy("block", "shard")).applyInPandas(meet, kinds)
    return top_k(found, k, F.desc("score"), "record_id")


def graph_search(queries: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """Low keywords in entity texts, high ones in relation texts; hits per keyword plus a little for length."""

    def search(df, ident, text, words, kind):
        rows = df.select(ident.alias("record_id"), F.trim(text).alias("text")).where("text != ''").withColumns({"_x": F.lower("text"), "_bonus": F.least(F.length("text"), F.lit(200)) / 2000})
        q = queries.select("query_id", F.transform(F.col(words), F.lower).alias("_t"), F.lit(None).cast("string").alias("_q")).where(F.size("_t") > 0)
        return substring_search(q, rows, k, 1.0, 0.0, True).select("query_id", F.col("record_id").alias("result_id"), "score", "text", F.lit(kind).alias("result_type"))

    e = search(entities, F.concat(F.lit("entity:"), "entity_id"), F.concat_ws(" ", "entity_id", "entity_name", "description"), "low", "entity")
    r = search(relations, F.concat(F.lit("relation:"), "source_entity", F.lit("->"), "target_entity", F.lit(":"), F.coalesce("relation_id", F.lit(""))), F.concat_ws(" ", "source_entity", "target_entity", "description", "keywords"), "high", "relation")
    return top_k(e.unionAll(r), k, F.desc("score"), "result_id")


def result_key(df: DataFrame) -> Column:
    """result, record, chunk or own id, else a hash of the text."""
    ids = [F.col(c) for c in ("result_id", "record_id", "chunk_id", "id") if c in df.columns]
    return F.coalesce(*([first_filled(*ids)] if ids else []), F.sha1(F.coalesce("text", F.lit("")).cast("binary")))


def fuse_results(rows: DataFrame, method: str = "max_score", k: int = 10, min_score: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Results of several sources as one list per query: max_score, weighted_sum or round_robin."""
    rows = rows.withColumn("key", result_key(rows))
    weight = F.lit(1.0)
    for s, w in (weights or FUSION_WEIGHTS).items():
        weight = F.when(F.col("source") == s, F.lit(w)).otherwise(weight)
    by_source = rows.groupBy("query_id", "key", "source").agg(F.max("score").alias("best"), F.max_by("text", "score").alias("text"))
    total = F.sum(F.col("best") * weight) if method == "weighted_sum" else F.max("best")
    turn = F.lit(len(TURN_ORDER))
    for i, s in reversed(list(enumerate(TURN_ORDER))):
        turn = F.when(F.col("source") == s, F.lit(i)).otherwise(turn)
    fused = by_source.groupBy("query_id", "key").agg(F.round(total, 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("text", "best").alias("text"), F.min(turn).alias("_turn")).where(F.col("score") >= min_score)
    if method == "round_robin":
        fused = fused.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_turn").orderBy(F.desc("score"), "key")))
        return top_k(fused, k, "_n", "_turn", "key").drop("_n", "_turn")
    return top_k(fused, k, F.desc("score"), "key").drop("_turn")


def fusion_summary(rows: DataFrame, fused: DataFrame) -> DataFrame:
    """Inputs, distinct results and outputs per query."""
    n = rows.withColumn("key", result_key(rows)).groupBy("query_id").agg(F.count("*").alias("inputs"), F.count_distinct("key").alias("distinct_results"), *[F.count_if(F.col("source") == s).alias(f"from_{s}") for s in TURN_ORDER])
    return n.join(fused.groupBy("query_id").agg(F.count("*").alias("outputs")), "query_id", "left").withColumn("duplicates_removed", F.col("inputs") - F.col("distinct_results"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\w一-鿿]+"), lambda w: w != ""))


def rerank(candidates: DataFrame, queries: DataFrame, k: int = 8, threshold: float = 0.0) -> DataFrame:
    """Stage 1 (R9): weighted score, overlap, graph, first-of-source, modality and similarity terms.

    candidates: query_id, key, source, score, text, pos (input order), optionally modality and similarity.
    """
    weight = F.lit(1.0)
    for s, w in RERANK_WEIGHTS.items():
        weight = F.when(F.col("source") == s, F.lit(w)).otherwise(weight)
    c = candidates.join(queries.select("query_id", _tokens(F.col("query")).alias("_q")), "query_id")
    overlap = F.when((F.size("_q") > 0) & (F.size(_tokens(F.col("text"))) > 0), F.size(F.array_intersect("_q", _tokens(F.col("text")))) / F.size("_q")).otherwise(0.0)
    first = F.row_number().over(W.partitionBy("query_id", "source").orderBy("pos")) == 1
    score = F.col("score") * weight + overlap * 0.12 + overlap * overlap * 0.08 + F.when(F.col("source") == "graph", 0.15).otherwise(0.0) + F.when(first, 0.06).otherwise(0.0)
    if "modality" in candidates.columns:
        score = score + F.when(F.col("modality").isin("image", "table", "chart", "equation"), 0.05).otherwise(0.0)
    if "similarity" in candidates.columns:
        score = score + F.coalesce(0.1 * F.greatest(F.lit(0.0), F.col("similarity")), F.lit(0.0))
    scored = c.withColumn("rerank_score", F.round(score, 6)).drop("_q").where(F.col("rerank_score") >= threshold)
    return top_k(scored, k, F.desc("rerank_score"), "pos")


def blend_model_scores(ranked: DataFrame, model: DataFrame, n: int = 20) -> DataFrame:
    """0.65 of stage 1 and 0.35 of a given model score for the first n."""
    got = ranked.join(model.select("query_id", "key", "model_score"), ["query_id", "key"], "left")
    both = F.when((F.col("rank") <= n) & F.col("model_score").isNotNull(), F.round(0.65 * F.col("rerank_score") + 0.35 * F.col("model_score"), 6)).otherwise(F.col("rerank_score"))
    return got.withColumn("rerank_score", both).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


def build_context(results: DataFrame, max_results: int = 8, max_chars: int = 4000, separator: str = "\n\n") -> DataFrame:
    """(query_id, context, used): best first, texts once, blocks until the budget is reached."""
    once = results.where(blank_to_null(F.col("text")).isNotNull()).groupBy("query_id", F.sha1(F.col("text").cast("binary")).alias("_h")).agg(F.max(F.struct("score", "key", "text", "source")).alias("_r")).select("query_id", "_r.*")
    ranked = top_k(once, max_results, F.desc("score"), "key")
    block = F.format_string("[%d] (%s, %.4f)\n%s", "rank", "source", "score", "text")
    w = W.partitionBy("query_id").orderBy("rank")
    sized = ranked.withColumn("_b", block).withColumn("_n", F.sum(F.length("_b") + F.when(F.col("rank") > 1, len(separator)).otherwise(0)).over(w)).where(F.col("_n") <= max(256, max_chars))
    return sized.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "_b"))).getField("_b"), separator).alias("context"), F.count("*").alias("used"))
