"""Registered queries for the library's own operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import audit, content, extraction, graphmerge, retrieval, tableprep, timeseries
from loomgraph.plans.pattern import Graph, Link, Node, Prop, Where, select
from loomgraph.registry import queries, oracle_sql, query  # noqa: F401  (the catalogue is read from here)
from loomgraph.runtime import stage, table

# Triples made of the star schema: the mappings serve the pattern, audit and load queries.

CUSTOMER = tableprep.Mapping("customer", "Customer", [("text", "urn:x#customer/"), "c_custkey"], {"custName": (["c_name"], "string"), "segment": (["c_mktsegment"], "string"), "balance": (["c_acctbal"], "double")}, {"inNation": "nation"})
NATION_REF = tableprep.Mapping("nation", "Nation", [("text", "urn:x#nation/"), "c_nationkey"])
NATION = tableprep.Mapping("nation", "Nation", [("text", "urn:x#nation/"), "n_nationkey"], {"nationName": (["n_name"], "string")}, {"inRegion": "region"})
REGION_REF = tableprep.Mapping("region", "Region", [("text", "urn:x#region/"), "n_regionkey"])
ORDER = tableprep.Mapping("order", "Order", [("text", "urn:x#order/"), "o_orderkey"], {"total": (["o_totalprice"], "double"), "status": (["o_orderstatus"], "string")}, {"placedBy": "customer"})
CUSTOMER_REF = tableprep.Mapping("customer", "Customer", [("text", "urn:x#customer/"), "o_custkey"])


def star_triples(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """Triples of three tables; ``only``: the predicates that are read beside types, so that no others are made."""
    parts = (("customer", [CUSTOMER, NATION_REF]), ("nation", [NATION, REGION_REF]), ("orders", [ORDER, CUSTOMER_REF]))
    # a pattern reads the triples once for each of its parts, one predicate at a time
    return stage(tableprep.tables_to_triples([(table(spark, sf_dir, t), m) for t, m in parts], only), "triples", ["p"])


SPEND = Node("order", "Order", [Prop("total", "total"), Prop("status", "status", where=[Where("in", ["F", "O"])])], [Link("placedBy", Node("customer", "Customer", links=[Link("inNation", Node("nation", props=[Prop("nationName", "n_name")]))]))])


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F', 'O') GROUP BY n_name""")
def nation_order_spend(spark, sf_dir):
    """Q2-Q4, Q7, Q10 over T16 triples."""
    g = Graph(star_triples(spark, sf_dir))
    found = g.match(SPEND).withColumn("total", F.col("total").cast("double"))
    return select(found, ["n_name"], [("COUNT", "order", "orders"), ("SUM", "total", "spend")], ["n_name"]).withColumn("spend", F.round("spend", 2))


@query("""SELECT 'urn:x#customer/' || c_custkey AS customer FROM customer WHERE c_mktsegment = 'BUILDING'
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def customers_without_dear_orders(spark, sf_dir):
    """Q4 minus over a reverse link."""
    g = Graph(star_triples(spark, sf_dir))
    node = Node("customer", "Customer", [Prop("segment", "segment", where=[Where("in", ["BUILDING"])])], [Link("placedBy", Node("order", "Order", [Prop("total", "t", where=[Where(">", 300000.0, "double")])]), "minus", reverse=True)])
    return select(g.match(node), ["customer"])


@query("""SELECT DISTINCT 'urn:x#nation/' || n_nationkey AS nation, n_name, 'urn:x#customer/' || c_custkey AS customer
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000""")
def nations_rich_customers(spark, sf_dir):
    """Q4 optional: the sub-pattern with its filter is optional as a whole."""
    g = Graph(star_triples(spark, sf_dir))
    rich = Node("customer", "Customer", [Prop("balance", "balance", where=[Where(">", 9000.0, "double")])])
    return select(g.match(Node("nation", "Nation", [Prop("nationName", "n_name")], [Link("inNation", rich, "optional", reverse=True)])), ["nation", "n_name", "customer"])


@query("""SELECT 'urn:x#order/' || o_orderkey AS a, 'urn:x#customer/' || o_custkey AS b FROM orders WHERE o_totalprice > 300000
UNION SELECT 'urn:x#order/' || o_orderkey, 'urn:x#nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000""")
def order_union_ends(spark, sf_dir):
    """Q5: two alternatives of one node."""
    g = Graph(star_triples(spark, sf_dir))
    far = Node("order", links=[Link("placedBy", Node("c", "Customer", links=[Link("inNation", Node("b"))]))])
    node = Node("order", "Order", [Prop("total", "t", where=[Where(">", 300000.0, "double")])], unions=[[Node("order", links=[Link("placedBy", Node("b"))]), far]])
    return select(g.match(node).withColumnRenamed("order", "a"), ["a", "b"])


@query("""SELECT 'Customer' AS cls, 'inNation' AS p, 'Nation' AS o_cls, count(*) AS n FROM customer
UNION ALL SELECT 'Order', 'placedBy', 'Customer', count(*) FROM orders
UNION ALL SELECT 'Nation', 'inRegion', 'Region', count(*) FROM nation
UNION ALL SELECT 'Order', 'total', NULL, count(*) FROM orders UNION ALL SELECT 'Order', 'status', NULL, count(*) FROM orders
UNION ALL SELECT 'Customer', 'custName', NULL, count(*) FROM customer UNION ALL SELECT 'Customer', 'segment', NULL, count(*) FROM customer
UNION ALL SELECT 'Customer', 'balance', NULL, count(*) FROM customer UNION ALL SELECT 'Nation', 'nationName', NULL, count(*) FROM nation""")
def triple_predicate_stats(spark, sf_dir):
    """A1."""
    return audit.predicate_stats(star_triples(spark, sf_dir)).where("p != 'rdf:type'")


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT 'Customer' AS class, 'orders' AS property, 'maxCardinality' AS restriction, CAST(15 AS INTEGER) AS "limit", 'urn:x#customer/' || c_custkey AS subject, CAST(k AS INTEGER) AS property_count FROM c WHERE k > 15
UNION ALL SELECT 'Customer', 'orders', 'minCardinality', 1, 'urn:x#customer/' || c_custkey, CAST(k AS INTEGER) FROM c WHERE k < 1""")
def customer_cardinality(spark, sf_dir):
    """A5: subjects without the property count as zero."""
    triples = star_triples(spark, sf_dir, ["placedBy"])
    orders = triples.where("p = 'placedBy'").select("graph", F.col("o").alias("s"), F.lit("orders").alias("p"), F.col("s").alias("o"), "o_kind", "o_type")
    rules = spark.createDataFrame([("Customer", "orders", "maxCardinality", 15), ("Customer", "orders", "minCardinality", 1)], "class string, property string, restriction string, limit int")
    return audit.cardinality_violations(triples.unionByName(orders), rules)


@query("""WITH r AS (SELECT 'urn:x#customer/' || c_custkey AS focus, CAST(c_acctbal AS DOUBLE) AS v FROM customer)
SELECT focus, 'balance' AS path, 'minInclusive' AS shape FROM r WHERE v < 0 UNION ALL SELECT focus, 'balance', 'maxInclusive' FROM r WHERE v > 9900""")
def balance_shapes(spark, sf_dir):
    """A9."""
    shapes = [{"target": "Customer", "path": "balance", "kind": "minInclusive", "value": 0.0}, {"target": "Customer", "path": "balance", "kind": "maxInclusive", "value": 9900.0}]
    return audit.shape_check(star_triples(spark, sf_dir, ["balance"]), shapes).select("focus", "path", "shape")


# Content


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; a type by a rule on line number and text, ten blocks to a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.col("seq") == 0, "title").when(F.length("text") < 4, "header").otherwise("text")
    return docs.select(
        "doc_id", "seq", F.concat_ws("-", F.lit("b"), "doc_id", "seq").alias("block_id"), kind.alias("type"), "text",
        F.when(F.contains("text", F.lit("|")), F.col("text")).alias("table_body"), F.lit(None).cast("string").alias("img_path"), F.lit(None).cast("string").alias("latex"),
        F.floor(F.col("seq") / 10).cast("int").alias("page_idx"), F.floor(F.col("seq") / 10).cast("int").alias("page"),
    )


BLOCKS_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
b AS (SELECT doc_id, seq, text, CASE WHEN contains(text, '|') THEN 'table' WHEN seq = 0 THEN 'title' WHEN length(text) < 4 THEN 'header' ELSE 'text' END AS type FROM l)"""


@query(f"""WITH {BLOCKS_SQL} SELECT type, count(*) AS before, count(*) FILTER (NOT d) AS kept, count(*) FILTER (d) AS dropped
FROM (SELECT *, type = 'header' OR (type IN ('title', 'text') AND length(trim(text)) < 20) AS d FROM b) GROUP BY type""")
def block_filter_summary(spark, sf_dir):
    """C3, C4."""
    return content.filter_summary(content.mark_dropped(text_blocks(spark, sf_dir), drop_types=["header"], min_text_length=20))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, CASE type WHEN 'table' THEN 'table_pipeline' ELSE 'text_pipeline' END AS pipeline, count(*) AS n FROM b WHERE type <> 'header' GROUP BY ALL""")
def block_routes(spark, sf_dir):
    """C5."""
    return content.route_blocks(text_blocks(spark, sf_dir)).groupBy("doc_id", "pipeline").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), 180)) AS a FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(a // 180 AS INTEGER) AS chunk_index, CAST(len(ws[a + 1 : a + 200]) AS INTEGER) AS tokens, sha1(array_to_string(ws[a + 1 : a + 200], ' ')) AS h FROM s""")
def document_chunks(spark, sf_dir):
    """C11."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content.chunk_by_tokens(docs, size=200, overlap=20).select("doc_id", "chunk_index", "tokens", F.sha1(F.col("chunk_text").cast("binary")).alias("h"))


@query()
def semantic_blocks(spark, sf_dir):
    """C9, tested against a model in the tests."""
    return content.merge_semantic_blocks(content.route_blocks(text_blocks(spark, sf_dir))).select("doc_id", "group_no", "semantic_type", "pipeline", F.length("text").alias("chars"), F.size("source_block_ids").alias("blocks"))


@query("""SELECT page_id AS doc_id, 'https' AS name, substr(url, 7) AS value FROM pages WHERE url LIKE 'https:%' AND length(url) > 6
UNION ALL SELECT page_id, 'http', substr(url, 6) FROM pages WHERE url LIKE 'http:%' AND length(url) > 5""")
def form_fields(spark, sf_dir):
    """A URL is a field named by its scheme."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("seq"), F.lit("b").alias("block_id"), F.lit(0).alias("page"), F.col("url").alias("text"))
    return extraction.extract_form_fields(pages).select("doc_id", "name", "value")


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, seq, CAST(len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) AS INTEGER) AS cells FROM b WHERE type = 'table' AND len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) > 0""")
def pipe_table_cells(spark, sf_dir):
    """Each line is a block here, so its header is the line."""
    return extraction.parse_pipe_tables(text_blocks(spark, sf_dir)).select("doc_id", "seq", F.size("header").alias("cells"))


# Entities and relations


def part_entities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("entity_name"), F.col("p_brand").alias("entity_type"), F.col("p_type").alias("description"), F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string")).alias("source_chunk_id"), F.col("p_partkey").alias("pos"))


@query("""WITH e AS (SELECT *, regexp_replace(lower(trim(p_name)), '[\\s\\-_.:,;!?]', '', 'g') AS norm_name FROM part)
SELECT p_brand AS entity_type, norm_name, arg_min(p_name, p_partkey) AS canonical_name, count(*) AS mentions, 'canon_ent_' || substr(sha1(arg_min(p_name, p_partkey) || '|' || p_brand), 1, 24) AS canonical_id FROM e GROUP BY p_brand, norm_name""")
def part_entity_merge(spark, sf_dir):
    """G2, G3, G6."""
    return graphmerge.canonical_entities(part_entities(spark, sf_dir)).select("entity_type", "norm_name", "canonical_name", "mentions", "canonical_id")


@query("""SELECT 'p' || l_partkey AS source_entity, 's' || l_suppkey AS target_entity, max(l_quantity) AS weight, count(*) AS n,
'canon_rel_' || substr(sha1('p' || l_partkey || '|s' || l_suppkey || '|suppliedby'), 1, 24) AS canonical_id FROM lineitem GROUP BY l_partkey, l_suppkey""")
def supply_relations(spark, sf_dir):
    """G9, G10."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    rel = li.select(F.concat(F.lit("p"), "l_partkey").alias("source_entity"), F.concat(F.lit("s"), "l_suppkey").alias("target_entity"), F.lit("supplied by").alias("relation_type"), F.col("l_quantity").alias("weight"), F.lit(None).cast("string").alias("description"), key.alias("relation_id"), F.concat(F.lit("c"), (F.col("l_orderkey") % 9).cast("string")).alias("source_chunk_id"), F.col("l_orderkey").alias("pos"))
    return graphmerge.merge_relations(rel, arrays=False).select("source_entity", "target_entity", "weight", F.col("mentions").alias("n"), "canonical_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey % 97 + 1000000 AS b FROM orders),
n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def customer_components(spark, sf_dir):
    """G14."""
    from loomgraph.components import connected_components

    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") % 97 + 1000000).alias("hub"))
    return connected_components(o, "o_custkey", "hub")


# Retrieval


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("""WITH q AS (SELECT item_id AS query_id, lower(trim(text)) AS q FROM benchmark), t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS ws FROM q WHERE q <> ''),
d AS (SELECT doc_id AS record_id, lower(text) AS x FROM documents),
s AS (SELECT query_id, record_id, round((CASE WHEN contains(x, q) THEN 5.0 ELSE 0.0 END) + 2.0 * len(list_filter(ws, lambda w: contains(x, w))) / len(ws), 6) AS score FROM t, d),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, record_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def benchmark_lexical(spark, sf_dir):
    """R2."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return retrieval.lexical_search(_questions(spark, sf_dir), docs).select("query_id", "record_id", "score", "rank")


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS record_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM m q, m c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM s) SELECT query_id, record_id, rank FROM r WHERE rank <= 10""")
def vector_neighbours(spark, sf_dir):
    """R3."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    q = e.where("record_id % 100 = 0").withColumnRenamed("record_id", "query_id")
    return retrieval.vector_search(q, e).select("query_id", "record_id", "rank")


def _hits(spark, sf_dir):
    """Two sources' results per user from events: event values as scores."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("r"), (F.col("event_id") % 37).cast("string")).alias("record_id"), F.when(F.col("event_id") % 3 == 0, "graph").when(F.col("event_id") % 3 == 1, "keyword").otherwise("vector").alias("source"), F.round("value", 2).alias("score"), F.concat(F.lit("text "), (F.col("event_id") % 37).cast("string")).alias("text"))


HITS_SQL = """h AS (SELECT user_id AS query_id, 'r' || (event_id % 37) AS key, CASE event_id % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'keyword' ELSE 'vector' END AS source, round(value, 2) AS score FROM events),
b AS (SELECT query_id, key, source, max(score) AS best FROM h GROUP BY ALL)"""


@query(f"""WITH {HITS_SQL}, f AS (SELECT query_id, key, round(sum(best * CASE source WHEN 'graph' THEN 1.2 WHEN 'keyword' THEN 0.8 ELSE 1.0 END), 6) AS score FROM b GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM f WHERE score >= 0) SELECT query_id, key, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def fused_weighted(spark, sf_dir):
    """R5, R6."""
    return retrieval.fuse_results(_hits(spark, sf_dir), "weighted_sum").select("query_id", "key", "score", "rank")


@query(f"""WITH {HITS_SQL}, f AS (SELECT query_id, key, max(best) AS score, min(CASE source WHEN 'vector' THEN 0 WHEN 'graph' THEN 1 ELSE 2 END) AS turn FROM b GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, turn ORDER BY score DESC, key) AS n FROM f WHERE score >= 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n, turn, key) AS INTEGER) AS rank FROM n) SELECT query_id, key, rank FROM r WHERE rank <= 10""")
def fused_round_robin(spark, sf_dir):
    """R7."""
    return retrieval.fuse_results(_hits(spark, sf_dir), "round_robin").select("query_id", "key", "rank")


# Tables


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus: P matches' END AS status_error, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS too_dear FROM orders
WHERE o_orderstatus = 'P' OR o_totalprice > 400000""")
def order_cell_errors(spark, sf_dir):
    """T6."""
    o = table(spark, sf_dir, "orders")
    status = tableprep.cell_error("o_orderstatus", {"notEmpty": True, "regexNoMatch": "P"})
    dear = tableprep.cell_error("o_totalprice", {"type": "float", "lte": 400000})
    return o.select("o_orderkey", status.alias("status_error"), dear.isNotNull().cast("int").alias("too_dear")).where("status_error is not null or too_dear = 1")


@query("""SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders""")
def priority_parts(spark, sf_dir):
    """T3."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("part"))
    return tableprep.split_rows(rows, {"part": "-"})


@query("""WITH f AS (SELECT n_name AS k, count(*) AS n, min('urn:x#nation/' || n_nationkey) AS u FROM nation GROUP BY n_name)
SELECT s_suppkey, u AS uri FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN f ON k = n_name""")
def supplier_nation_lookup(spark, sf_dir):
    """T13."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    nations, _ = tableprep.rows_to_triples(table(spark, sf_dir, "nation"), [NATION, REGION_REF])
    return tableprep.lookup_uris(rows, {"n_name": "nationName"}, nations).select("s_suppkey", "uri")


@query("""SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c
FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
def nation_stitch(spark, sf_dir):
    """B1."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return tableprep.stitch([c, s], ["nation"])[0]


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def first_orders(spark, sf_dir):
    """B4."""
    return tableprep.uniquify(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])


# Time series


@query("""SELECT event_type, min(ts) AS timestamp, avg(value) AS value FROM events WHERE event_type <> 'click' GROUP BY event_type""")
def event_averages(spark, sf_dir):
    """M5, with a constraint on the group column."""
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return timeseries.average_by(e, "ts", "event_type", ["value"], [("event_type", "!=", "click")])


@query("""SELECT o_orderdate AS timestamp, o_totalprice AS price, o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-03-01 00:00:00'
AND o_totalprice > 50000 AND o_totalprice <= 250000""")
def order_window(spark, sf_dir):
    """M1-M3."""
    o = timeseries.where_time(table(spark, sf_dir, "orders"), "o_orderdate", (">=", "1995-01-01 00:00:00"), ("<", "03/01/1995 00:00:00"))
    return timeseries.where_values(timeseries.select_tags(o, "o_orderdate", {"o_totalprice": "price", "o_orderkey": "k"}), [("price", ">", 50000.0), ("price", "<=", 250000.0)])


@query("""SELECT user_id, min(ts) AS timestamp, avg(value) AS value FROM events GROUP BY user_id""")
def event_averages_all(spark, sf_dir):
    """M5 by user."""
    return timeseries.average_by(table(spark, sf_dir, "events").select("ts", "user_id", "value"), "ts", "user_id", ["value"])


@query("""SELECT o_orderdate AS timestamp, o_totalprice AS price, o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-03-01 00:00:00'
AND (o_totalprice > 250000 OR o_totalprice < 20000)""")
def order_window_by_value(spark, sf_dir):
    """M1-M3 with conditions joined by OR."""
    o = timeseries.where_time(table(spark, sf_dir, "orders"), "o_orderdate", (">=", "1995-01-01 00:00:00"), ("<", "03/01/1995 00:00:00"))
    return timeseries.where_values(timeseries.select_tags(o, "o_orderdate", {"o_totalprice": "price", "o_orderkey": "k"}), [("price", ">", 250000.0), ("price", "<", 20000.0)], "OR")


# More of the graph


@query("""SELECT 'Customer' AS cls, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'Order', count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'Nation', count(*) FROM (SELECT n_nationkey FROM nation UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'Region', count(DISTINCT n_regionkey) FROM nation""")
def class_counts(spark, sf_dir):
    """A2."""
    return audit.class_instance_counts(star_triples(spark, sf_dir))


@query("""SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def order_nation_paths(spark, sf_dir):
    """A3."""
    return audit.path_instance_count(star_triples(spark, sf_dir), "Order", [("placedBy", "Customer", True), ("inNation", "Nation", True)])


@query("""WITH l AS (SELECT trim(c_name) AS label, 'urn:x#customer/' || c_custkey AS s, 'Customer' AS cls FROM customer UNION SELECT trim(c_mktsegment), 'urn:x#customer/' || c_custkey, 'Customer' FROM customer
UNION SELECT trim(n_name), 'urn:x#nation/' || n_nationkey, 'Nation' FROM nation), r AS (SELECT label, count(*) AS shared FROM l GROUP BY label HAVING count(*) <= 3)
SELECT label, s, cls, shared FROM l JOIN r USING (label) WHERE len(regexp_split_to_array(label, '\\s+')) <= 4""")
def name_labels(spark, sf_dir):
    """A8."""
    return audit.label_dictionary(star_triples(spark, sf_dir, ["custName", "segment", "nationName"]).where("p in ('custName', 'segment', 'nationName', 'rdf:type')").withColumn("o_kind", F.when(F.col("p") == "rdf:type", "uri").otherwise(F.col("o_kind"))))


BUILDING = Node("customer", "Customer", [Prop("segment", "segment", where=[Where("in", ["BUILDING"])])], [Link("inNation", Node("nation", "Nation"))])


@query("""WITH b AS (SELECT 'urn:x#customer/' || c_custkey AS c, 'urn:x#nation/' || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c AS s, 'rdf:type' AS p, 'Customer' AS o FROM b UNION SELECT c, 'segment', 'BUILDING' FROM b UNION SELECT c, 'inNation', n FROM b UNION SELECT n, 'rdf:type', 'Nation' FROM b""")
def building_subgraph(spark, sf_dir):
    """Q14."""
    return Graph(star_triples(spark, sf_dir)).construct(BUILDING).select("s", "p", "o")


@query("""WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'placedBy' AS p, count(*) AS n FROM orders JOIN c ON o_custkey = c_custkey UNION ALL SELECT 'inNation', count(*) FROM c UNION ALL SELECT 'segment', count(*) FROM c
UNION ALL SELECT 'nationName', count(*) FROM nation""")
def without_building(spark, sf_dir):
    """Q15: all triples in and out of the matched nodes go."""
    left = Graph(star_triples(spark, sf_dir)).delete(BUILDING, "all")
    return left.where("p in ('placedBy', 'inNation', 'segment', 'nationName')").groupBy("p").agg(F.count("*").alias("n"))


@query("""SELECT 'urn:x#customer/' || c_custkey AS s, 'inNation' AS p, 'urn:x#nation/3' AS o, 'Customer' AS neighbour_class FROM customer WHERE c_nationkey = 3
UNION SELECT 'urn:x#nation/3', 'inRegion', 'urn:x#region/' || n_regionkey, 'Region' FROM nation WHERE n_nationkey = 3 UNION SELECT 'urn:x#nation/3', 'nationName', n_name, NULL FROM nation WHERE n_nationkey = 3""")
def around_nation(spark, sf_dir):
    """Q18."""
    return Graph(star_triples(spark, sf_dir)).connected_triples("urn:x#nation/3")


@query("""SELECT 'urn:x#nation/' || n_nationkey AS s, 'Nation' AS cls, 'inRegion' AS p, 'urn:x#region/' || n_regionkey AS o, 'Region' AS o_cls FROM nation
UNION SELECT 'urn:x#order/' || o_orderkey, 'Order', 'status', o_orderstatus, NULL FROM orders""")
def region_and_status_rows(spark, sf_dir):
    """Q19."""
    return Graph(star_triples(spark, sf_dir)).instance_table([("Nation", "inRegion"), ("Order", "status")])


@query("""SELECT DISTINCT 'urn:x#customer/' || c_custkey AS s, 'Customer' AS cls FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3""")
def building_in_nation(spark, sf_dir):
    """Q22."""
    return Graph(star_triples(spark, sf_dir, ["segment", "inNation"])).find_instance({"segment": "BUILDING", "inNation": "urn:x#nation/3"})


@query("""WITH n AS (SELECT count(*) FILTER (c = 0) AS lonely, count(*) AS nations FROM (SELECT n_nationkey, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1))
SELECT 'entities' AS what, nations + (SELECT count(*) FROM customer) AS n FROM n UNION ALL SELECT 'relations', count(*) FROM customer UNION ALL SELECT 'components', nations FROM n UNION ALL SELECT 'isolated', lonely FROM n""")
def nation_graph_summary(spark, sf_dir):
    """G14, G15."""
    c = table(spark, sf_dir, "customer")
    customer, nation = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    entities = c.select(customer.alias("entity_id")).unionAll(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey")))
    relations = c.select(customer.alias("source_entity"), nation.alias("target_entity"))
    return graphmerge.graph_summary(entities, relations, graphmerge.graph_components(entities, relations))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT c_custkey + 100000000, c_name, 0.0 FROM customer WHERE c_custkey % 10 = 0""")
def balances_upserted(spark, sf_dir):
    """Every tenth customer is settled, and has a new account."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("balance"))
    tenth = old.where("c_custkey % 10 = 0").withColumn("balance", F.lit(0.0))
    new = tenth.unionByName(tenth.withColumn("c_custkey", F.col("c_custkey") + 100_000_000))
    return graphmerge.upsert_by_key(old, new, "c_custkey", "c_name")


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')""")
def parts_with_substring(spark, sf_dir):
    """B5."""
    return tableprep.subset_substring(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "AN", ["p_name", "p_type"])
