"""Registered queries on blocks, rules in text and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog import BLOCKS_SQL, HITS_SQL, _hits, _questions, text_blocks
from loomgraph.operators import content, extraction, retrieval
from loomgraph.registry import query
from loomgraph.runtime import table

SPACE = "[ \\t\\n\\x0B\\f\\r]+"

# Blocks


@query("""SELECT conv_id AS doc_id, turn AS seq, 'mineru_block_' || turn AS block_id, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS type, sha1(coalesce(nullif(trim(text), ''), '')) AS h FROM conversations""")
def turn_blocks(spark, sf_dir):
    """Turns as blocks without ids, their text under another name."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.col("text").alias("content"))
    return content.normalize_blocks(c).select("doc_id", "seq", "block_id", "type", F.sha1(F.col("text").cast("binary")).alias("h"))


@query(f"""WITH {BLOCKS_SQL} SELECT 'route' AS what, CASE type WHEN 'table' THEN 'table_pipeline' ELSE 'text_pipeline' END AS name, count(*) AS n FROM b WHERE type <> 'header' GROUP BY 2
UNION ALL SELECT 'type', type, count(*) FROM b WHERE type <> 'header' GROUP BY 2 UNION ALL SELECT 'left_out', 'discarded', count(*) FROM b WHERE type = 'header' HAVING count(*) > 0""")
def route_totals(spark, sf_dir):
    """C8."""
    blocks = text_blocks(spark, sf_dir)
    return content.route_summary(blocks, content.route_blocks(blocks))


def _captions(blocks):
    """Text lines as descriptions of the tables on their page."""
    return blocks.where("type = 'text'").select("doc_id", F.lit("table").alias("type"), "page_idx", F.col("seq").alias("pos"), F.concat(F.lit("p/"), (F.col("seq") % 3).cast("string")).alias("img_path"), F.col("text").alias("description"))


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT doc_id, seq // 10 AS page, arg_min(text, seq) AS description FROM b WHERE type = 'text' GROUP BY ALL)
SELECT b.doc_id, b.seq, description FROM b LEFT JOIN d ON d.doc_id = b.doc_id AND page = b.seq // 10 WHERE type = 'table'""")
def table_captions(spark, sf_dir):
    """C6."""
    blocks = text_blocks(spark, sf_dir)
    return content.attach_descriptions(blocks.where("type = 'table'"), _captions(blocks)).select("doc_id", "seq", "description")


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT doc_id, seq // 10 AS page, seq % 3 AS k, text, seq FROM b WHERE type = 'text'),
e AS (SELECT doc_id, page, k, arg_min(text, seq) AS t FROM d GROUP BY ALL), p AS (SELECT doc_id, page, arg_min(text, seq) AS t FROM d GROUP BY ALL)
SELECT b.doc_id, b.seq, coalesce(e.t, p.t) AS description FROM b LEFT JOIN e ON e.doc_id = b.doc_id AND e.page = b.seq // 10 AND k = b.seq % 3
LEFT JOIN p ON p.doc_id = b.doc_id AND p.page = b.seq // 10 WHERE type = 'table'""")
def table_captions_by_path(spark, sf_dir):
    """Paths differ in case and slashes."""
    blocks = text_blocks(spark, sf_dir)
    bare = blocks.where("type = 'table'").withColumn("text", F.lit(None).cast("string")).withColumn("img_path", F.concat(F.lit("P\\"), (F.col("seq") % 3).cast("string")))
    return content.resolve_description(bare, _captions(blocks)).select("doc_id", "seq", "description")


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT type, len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) AS n FROM b WHERE type <> 'header'),
s AS (SELECT type, n, unnest(range(0, n, 40)) AS a FROM w WHERE n > 0)
SELECT CASE type WHEN 'table' THEN 'table_pipeline' ELSE 'text_pipeline' END AS pipeline, type AS content_type, count(*) AS chunks, CAST(sum(least(50, n - a)) AS BIGINT) AS tokens FROM s GROUP BY type""")
def chunk_totals(spark, sf_dir):
    """C10, C11, C13."""
    routed = content.route_blocks(text_blocks(spark, sf_dir))
    chosen = routed.withColumn("chosen", content.select_chunk_text(routed))
    return content.chunk_summary(content.chunk_by_tokens(chosen, "chosen", 50, 10))


@query("""SELECT conv_id, turn, 'chunk_' || substr(sha1(concat_ws('|', role, conv_id, turn, substr(sha1(text), 1, 16))), 1, 24) AS chunk_id FROM conversations""")
def turn_chunk_ids(spark, sf_dir):
    """C12."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", content.chunk_id(F.col("role"), F.col("conv_id").cast("string"), F.col("turn"), F.col("text")).alias("chunk_id"))


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT *, CASE type WHEN 'table' THEN 'table_pipeline' ELSE 'text_pipeline' END AS p FROM b WHERE type <> 'header' AND trim(text) <> '')
SELECT doc_id, seq, CASE p WHEN 'table_pipeline' THEN 'rows' ELSE 'dense' END AS strategy, 'emb_' || substr(sha1(concat_ws('|', p, type, seq // 10, seq, substr(sha1(trim(text)), 1, 16))), 1, 24) AS record_id FROM r""")
def block_records(spark, sf_dir):
    """C14, C15."""
    routed = content.route_blocks(text_blocks(spark, sf_dir)).withColumn("chunk_index", F.col("seq"))
    return content.embedding_records(routed, {"text_pipeline": "dense", "table_pipeline": "rows"}).select("doc_id", "seq", "strategy", "record_id")


@query("""SELECT vec_id AS record_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN CAST(embedding[len(embedding)] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM embeddings""")
def reused_vectors(spark, sf_dir):
    """C17: even records were stored again later, turned round; every third was never stored."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    stored = e.where("record_id % 3 != 0").withColumn("written_at", F.lit(1))
    again = stored.where("record_id % 2 = 0").withColumn("vector", F.reverse("vector")).withColumn("written_at", F.lit(2))
    return content.resume_vectors(e.select("record_id"), stored.unionByName(again)).select("record_id", F.get("vector", F.lit(0)).cast("double").alias("first"))


@query(f"""WITH {BLOCKS_SQL}, x AS (SELECT doc_id, seq, seq // 10 AS page, text, len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda v: v <> '')) AS n FROM b WHERE type IN ('text', 'title')),
j AS (SELECT t.doc_id, t.seq, x.seq AS pos, x.text, sum(n) OVER (PARTITION BY t.doc_id, t.seq ORDER BY x.seq) AS upto FROM b t JOIN x ON x.doc_id = t.doc_id AND abs(x.page - t.seq // 10) <= 1 WHERE t.type = 'table')
SELECT doc_id, seq, sha1(string_agg(text, chr(10) ORDER BY pos)) AS h FROM j WHERE upto <= 200 GROUP BY doc_id, seq""")
def table_contexts(spark, sf_dir):
    """C18."""
    return content.context_window(text_blocks(spark, sf_dir), 1, 200).select("doc_id", "seq", F.sha1(F.col("context").cast("binary")).alias("h"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, seq, 'Table on page ' || (seq // 10) || ': ' || substr(text, 1, 200) AS sentence FROM b WHERE type = 'table'""")
def table_sentences(spark, sf_dir):
    """C19."""
    t = text_blocks(spark, sf_dir).where("type = 'table'")
    return t.select("doc_id", "seq", content.rule_descriptions(t).alias("sentence"))


# Rules in text: statements about parts and lines, as blocks


def _statements(rows, doc: str, seq: str, text):
    return rows.select(F.col(doc).alias("doc_id"), F.col(seq).alias("seq"), F.concat_ws("-", F.lit("b"), doc, seq).alias("block_id"), F.lit(0).alias("page"), text.alias("text"))


def _size_limits(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("size <= "), size, F.when(F.col("p_size") % 2 == 0, "mm").otherwise(""), F.lit(", 直径不大于"), size, F.lit("cm"))
    return extraction.extract_limits(_statements(table(spark, sf_dir, "part"), "p_partkey", "p_size", text))


@query("""SELECT p_partkey AS doc_id, 'size' AS parameter, '<=' AS operator, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_size % 2 = 0 THEN 'mm' ELSE '' END AS unit FROM part
UNION ALL SELECT p_partkey, '直径', '<=', CAST(p_size AS DOUBLE), 'cm' FROM part""")
def size_limits(spark, sf_dir):
    """X1."""
    return _size_limits(spark, sf_dir).select("doc_id", "parameter", "operator", "value", "unit")


@query("""SELECT p_partkey AS doc_id, 'warning' AS level, 'missing_unit' AS code FROM part WHERE p_size % 2 <> 0""")
def limits_without_unit(spark, sf_dir):
    """X12."""
    return extraction.validate_limits(_size_limits(spark, sf_dir)).select("doc_id", "level", "code")


@query("""SELECT p_partkey AS doc_id, 0 AS match_no, 'Al' || p_size AS material FROM part UNION ALL SELECT p_partkey, 1, 'Q' || p_size FROM part""")
def part_materials(spark, sf_dir):
    """X2."""
    text = F.concat(F.lit("use Al"), "p_size", F.lit(" or Q"), "p_size")
    return extraction.extract_materials(_statements(table(spark, sf_dir, "part"), "p_partkey", "p_size", text)).select("doc_id", "match_no", "material")


def _lines(spark, sf_dir):
    """An order may have a line number twice.  Most haven't, so rows are dealt before and not grouped by the tasks that read them."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey", "l_linenumber").distinct()


def _line_steps(spark, sf_dir):
    name = F.when(F.col("l_linenumber") % 4 == 1, "先制孔").when(F.col("l_linenumber") % 4 == 2, "再铆接").when(F.col("l_linenumber") % 4 == 3, "note").otherwise("装配")
    return extraction.extract_steps(_statements(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", name))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_linenumber % 4 WHEN 1 THEN '制孔' WHEN 2 THEN '铆接' ELSE '装配' END AS name FROM lineitem WHERE l_linenumber % 4 <> 3),
n AS (SELECT *, 'step_' || row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS step_id FROM s)
SELECT doc_id, seq, step_id, name, coalesce(lag(step_id) OVER w, '') AS before, coalesce(lead(step_id) OVER w, '') AS next_step FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
def line_steps(spark, sf_dir):
    """X5."""
    return _line_steps(spark, sf_dir).select("doc_id", "seq", "step_id", "name", "before", "next_step")


@query("""SELECT o_orderkey AS doc_id, '' AS step_id, 'no_steps' AS error FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 4 <> 3)""")
def orders_without_steps(spark, sf_dir):
    """X11."""
    return extraction.validate_steps(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), _line_steps(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_linenumber % 4 WHEN 1 THEN '' || l_linenumber WHEN 2 THEN (l_linenumber - 1) || '.1' WHEN 3 THEN (l_linenumber + 2) || '.1' ELSE '1' END AS section_id FROM lineitem),
f AS (SELECT doc_id, section_id AS parent, min(seq) AS opened FROM s GROUP BY ALL)
SELECT doc_id, seq, section_id, 'duplicate_id' AS error FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY seq) AS n FROM s) WHERE n > 1
UNION ALL SELECT s.doc_id, seq, section_id, 'missing_parent' FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND parent = split_part(section_id, '.', 1) WHERE contains(section_id, '.') AND (opened IS NULL OR opened >= seq)""")
def section_faults(spark, sf_dir):
    """X6, X10."""
    n = F.col("l_linenumber")
    ident = F.when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, F.concat((n - 1).cast("string"), F.lit(".1"))).when(n % 4 == 3, F.concat((n + 2).cast("string"), F.lit(".1"))).otherwise("1")
    lines = _statements(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", F.concat(ident, F.lit(" title")))
    return extraction.validate_sections(extraction.extract_sections(lines))


@query("""SELECT p_partkey AS doc_id, 'forbid_pair' AS kind, 'Al' || p_size AS a, 'weld' AS b, NULL AS op, NULL AS value FROM part
UNION ALL SELECT p_partkey, 'thickness_limit', 'thickness_mm', NULL, 'lt', CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT p_partkey, 'temperature_limit', 'temperature_c', NULL, 'lte', p_size * 10.0 FROM part""")
def part_rules(spark, sf_dir):
    """X9."""
    text = F.format_string("禁止 材料:Al%d 工艺:weld\n厚度≤%d\n淬火温度 < %d", F.col("p_size"), F.col("p_size"), F.col("p_size") * 10)
    return extraction.extract_rules(_statements(table(spark, sf_dir, "part"), "p_partkey", "p_size", text)).select("doc_id", "kind", "a", "b", "op", "value")


@query("""WITH f AS (SELECT p_partkey AS object_id, 'big' AS constraint_id, 'threshold' AS reason FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'dull', 'text_must_not' FROM part WHERE contains(p_type, 'STEEL')
UNION ALL SELECT p_partkey, 'pair', 'forbid_pair' FROM part WHERE p_brand = 'Brand#11' AND p_size = 7)
SELECT *, false AS ok FROM f UNION ALL SELECT object_id, '__aggregate__', string_agg(constraint_id, ',' ORDER BY constraint_id), false FROM f GROUP BY object_id""")
def parts_against_rules(spark, sf_dir):
    """X13."""
    p = table(spark, sf_dir, "part")
    parts = p.select(F.col("p_partkey").alias("object_id"), F.lit("part").alias("type"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand").alias("attributes"), F.col("p_type").alias("text"))
    kinds = "constraint_id string, type string, kind string, a string, b string, key string, op string, value double"
    rules = [("big", "part", "threshold", None, None, "size", "lte", 40.0), ("dull", None, "text_must_not", "STEEL", None, None, None, None), ("pair", "part", "forbid_pair", "Brand#11", "7", None, None, None), ("other", "order", "text_must_not", "a", None, None, None, None)]
    return extraction.filter_by_rules(parts, spark.createDataFrame(rules, kinds))


@query("""WITH t AS (SELECT l_orderkey AS id, list(lower(l_returnflag) ORDER BY l_linenumber, l_returnflag) AS s FROM lineitem GROUP BY l_orderkey), m AS (SELECT id, s, unnest(range(1, len(s))) AS i FROM t)
SELECT DISTINCT id, 'forbidden: a -> r' AS error FROM m WHERE s[i] = 'a' AND s[i + 1] = 'r'
UNION ALL SELECT id, 'n must come before r' FROM t WHERE list_contains(s, 'r') AND coalesce(list_position(s, 'n'), 0) > list_position(s, 'r')""")
def return_flag_faults(spark, sf_dir):
    """A trajectory is an order's flags by line."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).getField("l_returnflag").alias("states"))
    return extraction.validate_transitions(li, spark.createDataFrame([("A", "R")], "from_state string, to_state string"), spark.createDataFrame([("N", "R")], "first string, second string"))


# Retrieval


@query("""WITH q AS (SELECT item_id AS query_id, regexp_extract_all(trim(text), '([A-Za-z][A-Za-z0-9_\\-]{1,})', 1) AS raw FROM benchmark),
w AS (SELECT query_id, list_filter(raw, lambda w: NOT list_contains(['a','an','the','is','are','was','were','be','to','of','for','and','or','in','on','at','with','by','from','what','how','why','when','where','which','who'], lower(w))) AS ws FROM q),
k AS (SELECT query_id, list_filter(ws, lambda w, i: NOT list_contains(list_transform(ws[1 : i - 1], lambda v: lower(v)), lower(w)))[1 : 12] AS ks FROM w)
SELECT query_id, array_to_string(ks, ' ') AS keywords, CAST(len(ks[1 : greatest(1, len(ks) // 2)]) AS INTEGER) AS high FROM k""")
def benchmark_keywords(spark, sf_dir):
    """R1."""
    return retrieval.extract_keywords(_questions(spark, sf_dir)).select("query_id", F.array_join("keywords", " ").alias("keywords"), F.size("high").alias("high"))


def _whole_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("""WITH q AS (SELECT item_id AS query_id, lower(trim(text)) AS q FROM benchmark), t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS ws FROM q WHERE q <> ''),
d AS (SELECT doc_id AS record_id, lower(text) AS x FROM documents),
s AS (SELECT query_id, record_id, round((CASE WHEN contains(x, q) THEN 5.0 ELSE 0.0 END) + 2.0 * len(list_filter(ws, lambda w: contains(x, w))) / len(ws), 6) AS score FROM t, d),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, record_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def benchmark_lexical_whole(spark, sf_dir):
    """R2: benchmark_lexical under the name that it had while that one read beginnings only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return retrieval.lexical_search(_whole_questions(spark, sf_dir), docs).select("query_id", "record_id", "score", "rank")


@query("""WITH q AS (SELECT item_id AS query_id, regexp_extract_all(trim(text), '([A-Za-z][A-Za-z0-9_\\-]{1,})', 1) AS raw FROM benchmark),
w AS (SELECT query_id, list_filter(raw, lambda w: NOT list_contains(['a','an','the','is','are','was','were','be','to','of','for','and','or','in','on','at','with','by','from','what','how','why','when','where','which','who'], lower(w))) AS ws FROM q),
k AS (SELECT query_id, list_filter(ws, lambda w, i: NOT list_contains(list_transform(ws[1 : i - 1], lambda v: lower(v)), lower(w)))[1 : 12] AS ks FROM w)
SELECT query_id, array_to_string(ks, ' ') AS keywords, CAST(len(ks[1 : greatest(1, len(ks) // 2)]) AS INTEGER) AS high FROM k""")
def benchmark_keywords_whole(spark, sf_dir):
    """Likewise."""
    return retrieval.extract_keywords(_whole_questions(spark, sf_dir)).select("query_id", F.array_join("keywords", " ").alias("keywords"), F.size("high").alias("high"))


@query("""WITH e AS (SELECT 'entity:c' || c_custkey AS result_id, 'c' || c_custkey || ' ' || c_name || ' ' || c_mktsegment AS text FROM customer),
h AS (SELECT r_regionkey AS query_id, result_id, text, len(list_filter(['building', '00' || r_regionkey], lambda w: contains(lower(text), w))) / 2.0 AS share, 'entity' AS result_type FROM e, region
UNION ALL SELECT r.r_regionkey, 'relation:' || n_name || '->' || n.r_name || ':r' || n_nationkey, n_name || ' ' || n.r_name || ' located in', 1.0, 'relation' FROM region r, (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) n
WHERE contains(lower(n_name || ' ' || n.r_name || ' located in'), lower(r.r_name))),
s AS (SELECT *, round(share + least(length(text), 200) / 2000.0, 6) AS score FROM h WHERE share > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS INTEGER) AS rank FROM s)
SELECT query_id, result_id, result_type, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def region_graph_hits(spark, sf_dir):
    """R4."""
    region = table(spark, sf_dir, "region")
    asked = region.select(F.col("r_regionkey").alias("query_id"), F.array(F.lit("building"), F.concat(F.lit("00"), "r_regionkey")).alias("low"), F.array("r_name").alias("high"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"), F.col("c_mktsegment").alias("description"))
    within = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_entity"), F.col("r_name").alias("target_entity"), F.concat(F.lit("r"), "n_nationkey").alias("relation_id"), F.lit(None).cast("string").alias("description"), F.lit("located in").alias("keywords"))
    return retrieval.graph_search(asked, people, within).select("query_id", "result_id", "result_type", "score", "rank")


@query(f"""WITH {HITS_SQL}, f AS (SELECT query_id, key, max(best) AS score FROM b GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM f WHERE score >= 0) SELECT query_id, key, score, rank FROM r WHERE rank <= 10""")
def fused_max(spark, sf_dir):
    """R5."""
    return retrieval.fuse_results(_hits(spark, sf_dir)).select("query_id", "key", "score", "rank")


@query(f"""WITH {HITS_SQL} SELECT query_id, count(*) AS inputs, count(DISTINCT key) AS distinct_results, count(*) FILTER (source = 'graph') AS from_graph, nullif(least(10, count(DISTINCT key) FILTER (score >= 0)), 0) AS outputs,
count(*) - count(DISTINCT key) AS duplicates_removed FROM h GROUP BY query_id""")
def fusion_totals(spark, sf_dir):
    """R8."""
    hits = _hits(spark, sf_dir)
    return retrieval.fusion_summary(hits, retrieval.fuse_results(hits)).select("query_id", "inputs", "distinct_results", "from_graph", "outputs", "duplicates_removed")


RERANK_SQL = """c AS (SELECT user_id AS query_id, 'r' || (event_id % 37) AS key, event_id AS pos, event_id % 3 AS src, round(value, 2) AS v, CASE WHEN event_id % 37 = user_id % 37 THEN 1.0 ELSE 0.5 END AS o FROM events),
s AS (SELECT *, round(v * CASE src WHEN 0 THEN 1.1 WHEN 1 THEN 0.9 ELSE 1.0 END + o * 0.12 + o * o * 0.08 + CASE src WHEN 0 THEN 0.15 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY query_id, src ORDER BY pos) = 1 THEN 0.06 ELSE 0 END, 6) AS rerank_score FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS INTEGER) AS rank FROM s WHERE rerank_score >= 0)"""


def _reranked(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("Text "), (F.col("user_id") % 37).cast("string")).alias("query")).distinct()
    pos = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.concat(F.lit("r"), (F.col("event_id") % 37).cast("string")).alias("key"), F.when(F.col("event_id") % 3 == 0, "graph").when(F.col("event_id") % 3 == 1, "keyword").otherwise("vector").alias("source"), F.round("value", 2).alias("score"), F.concat(F.lit("text "), (F.col("event_id") % 37).cast("string")).alias("text"))
    return retrieval.rerank(pos, asked, 8)


@query(f"""WITH {RERANK_SQL} SELECT query_id, key, pos, CAST(rerank_score AS DOUBLE) AS rerank_score, rank FROM r WHERE rank <= 8""")
def reranked_hits(spark, sf_dir):
    """R9."""
    return _reranked(spark, sf_dir).select("query_id", "key", "pos", "rerank_score", "rank")


@query(f"""WITH {RERANK_SQL}, m AS (SELECT query_id, pos, rank AS old, CASE WHEN rank <= 4 AND key <> 'r5' THEN round(0.65 * rerank_score + 0.35 * CAST(substr(key, 2) AS INTEGER), 6) ELSE rerank_score END AS x FROM r WHERE rank <= 8)
SELECT query_id, pos, CAST(x AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, old) AS INTEGER) AS rank FROM m""")
def blended_hits(spark, sf_dir):
    """The model knows every key but one."""
    ranked = _reranked(spark, sf_dir)
    model = ranked.select("query_id", "key").distinct().where("key != 'r5'").withColumn("model_score", F.substring("key", 2, 9).cast("double"))
    return retrieval.blend_model_scores(ranked, model, 4).select("query_id", "pos", "rerank_score", "rank")


@query(f"""WITH {HITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, source DESC) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM o WHERE n = 1),
t AS (SELECT query_id, rank, '[' || rank || '] (' || source || ', ' || printf('%.4f', score) || ')' || chr(10) || 'text ' || substr(key, 2) AS block FROM r WHERE rank <= 8),
u AS (SELECT *, sum(length(block) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM t)
SELECT query_id, sha1(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS h, count(*) AS used FROM u WHERE upto <= 256 GROUP BY query_id""")
def user_contexts(spark, sf_dir):
    """Eight blocks don't fit into the budget."""
    hits = _hits(spark, sf_dir).withColumnRenamed("record_id", "key")
    return retrieval.build_context(hits, 8, 256).select("query_id", F.sha1(F.col("context").cast("binary")).alias("h"), "used")


@query("""SELECT p_partkey AS doc_id, 0 AS match_no, 'Reamer' AS tool_name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 1, '夹具' FROM part WHERE p_size % 2 = 0""")
def part_tools(spark, sf_dir):
    """Either case, and two tools of one block."""
    text = F.when(F.col("p_size") % 2 == 0, "a Reamer in a 夹具").otherwise("by hand")
    return extraction.extract_tools(_statements(table(spark, sf_dir, "part"), "p_partkey", "p_size", text)).select("doc_id", "match_no", "tool_name")


@query("""SELECT p_partkey AS doc_id, '尺寸检查 ' || p_size AS inspection_text FROM part WHERE p_size > 25""")
def part_inspections(spark, sf_dir):
    """X4."""
    text = F.concat(F.when(F.col("p_size") > 25, " 尺寸检查 ").otherwise(" size "), F.col("p_size").cast("string"))
    return extraction.extract_inspections(_statements(table(spark, sf_dir, "part"), "p_partkey", "p_size", text)).select("doc_id", "inspection_text")
