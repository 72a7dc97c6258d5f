"""Registered queries on sources and sinks, alias and fuzzy merging, rules through lists, and odds and ends."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.catalog import BLOCKS_SQL, CUSTOMER, NATION_REF, part_entities, star_triples, text_blocks
from loomgraph.functions.text import content_group, normalize_name
from loomgraph.operators import audit, content, graphmerge, tableprep, timeseries
from loomgraph.plans.pattern import TYPE, Graph, Link, Node, Prop, Where, select
from loomgraph.registry import query
from loomgraph.runtime import new_path, stage, table
from loomgraph.sources import io

# Sources and sinks: written, read back, compared


@query("""SELECT conv_id, turn + 1 AS seq, lower(role) AS type, sha1(text) AS h FROM conversations WHERE trim(text) <> ''""")
def blocks_read(spark, sf_dir):
    """Conversations as one JSON document each; blank texts go."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("turn"), F.struct(F.lit("text").alias("type"), F.col("text"), F.lower("role").alias("id")).alias("b"))
    docs = c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("t"), F.max("turn").alias("last"))
    whole = docs.withColumn("content_list", F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda n: F.try_element_at(F.filter("t", lambda x: x["turn"] == n), F.lit(1))["b"]))
    path = new_path(spark, "blocks")
    whole.select("doc_id", "content_list").write.json(path)
    return io.read_blocks(spark, path).where("text is not null").select(F.col("doc_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("id").alias("type"), F.sha1(F.col("text").cast("binary")).alias("h"))


@query("""SELECT doc_id, '[' || source || ',' || lang || ']' AS captions, sha256(coalesce(text, '')) AS content, n_chars, '{"lang":"' || lang || '","n":[' || doc_id || ',' || n_chars || ']}' AS place, source AS note FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL""")
def block_keys_read(spark, sf_dir):
    """Captions, content and keys that no column has, nested ones too, come back whole."""
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null and n_chars is not null")
    place = F.struct("lang", F.array("doc_id", "n_chars").alias("n"))
    block = F.struct(F.lit("code").alias("type"), F.coalesce("text", F.lit("")).alias("content"), F.array("source", "lang").alias("table_caption"), "n_chars", place.alias("place"), F.struct(F.col("source").alias("note")).alias("metadata"))
    path = new_path(spark, "blocks")
    d.select(F.col("doc_id").cast("string").alias("doc_id"), F.array(block).alias("content_list")).write.json(path)
    m = lambda k: F.col("metadata")[k]
    return io.read_blocks(spark, path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("["), F.array_join("captions", ","), F.lit("]")).alias("captions"), F.sha2(F.col("content"), 256).alias("content"),
        m("n_chars").cast("long").alias("n_chars"), m("place").alias("place"), m("note").alias("note"),
    )


@query("""SELECT '' || p_partkey AS "P_PartKey", trim(p_name) AS p_name, p_brand AS p_brand FROM part""")
def parts_from_csv(spark, sf_dir):
    """Names match in any case, outer spaces go."""
    path = new_path(spark, "parts")
    table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), "p_brand").write.option("header", True).csv(path)
    return io.read_table_csv(spark, path, ["P_PartKey"]).select("P_PartKey", "p_name", "p_brand")


@query("""SELECT event_type AS pipeline, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 'written' AS what FROM events WHERE event_id % 5 <> 0 GROUP BY event_type
UNION ALL SELECT '', count(*), CAST(sum(event_id) AS BIGINT), 'no pipeline' FROM events WHERE event_id % 5 = 0""")
def records_written(spark, sf_dir):
    """A record without a pipeline comes back as a warning."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise(" ").alias("pipeline"))
    path = new_path(spark, "records")
    warned = io.write_records(e, path)
    sums = lambda df, name, what: df.groupBy(name.alias("pipeline")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.lit(what).alias("what"))
    return sums(spark.read.schema("event_id long, pipeline string").json(path), F.col("pipeline"), "written").unionByName(sums(warned, F.trim("pipeline"), "no pipeline"))


@query("""SELECT 'entities' AS what, 'w1' AS workspace, count(*) AS n FROM nation UNION ALL SELECT 'entities', 'w2', count(*) FROM region UNION ALL SELECT 'relations', 'w1', count(*) FROM customer UNION ALL SELECT 'relations', 'w2', count(*) FROM nation""")
def graph_written(spark, sf_dir):
    """Two workspaces appended to one place."""
    path = new_path(spark, "graph")
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    rel = lambda df, a, b: df.select(F.col(a).cast("string").alias("source_entity"), F.col(b).cast("string").alias("target_entity"))
    io.write_graph(nation.select(F.col("n_name").alias("entity_id")), rel(customer, "c_custkey", "c_nationkey"), path, "w1")
    io.write_graph(region.select(F.col("r_name").alias("entity_id")), rel(nation, "n_nationkey", "n_regionkey"), path, "w2")
    read = [spark.read.parquet(f"{path}/{n}").groupBy(F.lit(n).alias("what"), "workspace").agg(F.count("*").alias("n")) for n in ("entities", "relations")]
    return read[0].unionByName(read[1])


@query("""SELECT p_partkey, p_name || chr(10) || '"é' || chr(92) AS o, 'literal' AS o_kind, '@en' AS o_type FROM part UNION ALL SELECT p_partkey, 'urn:x#' || p_size, 'uri', NULL FROM part""")
def line_triples(spark, sf_dir):
    """Quotes, line ends, backslashes and languages there and back."""
    p = table(spark, sf_dir, "part")
    s = F.concat(F.lit("urn:x#part/"), "p_partkey")
    row = lambda o, kind, t: F.struct(s.alias("s"), F.lit("urn:x#p").alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(t).cast("string").alias("o_type"))
    triples = p.select(F.inline(F.array(row(F.concat("p_name", F.lit('\n"é\\')), "literal", "@en"), row(F.concat(F.lit("urn:x#"), "p_size"), "uri", None))))
    path = new_path(spark, "lines")
    io.write_ntriples(triples, path)
    return io.read_ntriples(spark, path).select(F.substring_index("s", "/", -1).cast("long").alias("p_partkey"), "o", "o_kind", "o_type")


@query("""SELECT 'g-c_' || c_custkey AS "~id", 'Customer' AS "~label", NULL AS "~from", NULL AS "~to" FROM customer UNION ALL SELECT 'g-c_' || c_custkey || 'n_' || c_nationkey, 'in_Nation', 'g-c_' || c_custkey, 'g-n_' || c_nationkey FROM customer""")
def property_graph_tables(spark, sf_dir):
    """Ids from columns and constants, prefixed by the partition's value."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    v = io.with_graph_partition(io.to_vertex_table(c, ['"c"', "c_custkey"], ['"Customer"']), "part", "g")
    e = io.with_graph_partition(io.to_edge_table(c, ['"c"', "c_custkey"], ['"n"', "c_nationkey"], ['"in"', '"Nation"']), "part", "g")
    none = F.lit(None).cast("string")
    return v.select("~id", "~label", none.alias("~from"), none.alias("~to")).unionByName(e.select("~id", "~label", "~from", "~to"))


@query("""SELECT '' || o_orderkey AS "~id", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS "at:Date", CAST(o_totalprice AS DOUBLE) AS "total:Double" FROM orders""")
def bulk_csv(spark, sf_dir):
    """Headers with types, times to the second."""
    path = new_path(spark, "bulk")
    o = table(spark, sf_dir, "orders")
    io.write_gremlin_csv(o.select(F.col("o_orderkey").alias("~id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("total")), path)
    got = spark.read.option("header", True).csv(path)
    return got.withColumn("total:Double", F.col("`total:Double`").cast("double"))


# Content


@query(f"""WITH {BLOCKS_SQL} SELECT type, CASE type WHEN 'table' THEN 'table' WHEN 'header' THEN 'discard' ELSE 'text' END AS content_group, count(*) AS n FROM b GROUP BY ALL""")
def block_groups(spark, sf_dir):
    """C2."""
    return text_blocks(spark, sf_dir).groupBy("type", content_group(F.col("type")).alias("content_group")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS kept FROM documents WHERE text IS NOT NULL""")
def embedded_lengths(spark, sf_dir):
    """A function of texts makes vectors where there is none yet."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("embed_text"))
    have = F.when(F.col("doc_id") % 3 == 0, F.array(F.length("embed_text").cast("float"), F.lit(1.0).cast("float")))
    got = content.embed(d.withColumn("vector", have.cast("array<float>")), lambda texts: [[len(t), 0.0] for t in texts], batch=64)
    return got.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("chars"), F.get("vector", F.lit(1)).cast("int").alias("kept"))


# Merging


@query("""WITH e AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT CAST(k AS VARCHAR) AS entity_id, CAST(min(CAST(k AS VARCHAR)) OVER (PARTITION BY r) AS VARCHAR) AS group_id FROM e""")
def nations_by_alias(spark, sf_dir):
    """Nations of a region share an alias."""
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("entity_name"), F.lit("Nation").alias("entity_type"), F.array(F.concat(F.lit("Region "), "n_regionkey")).alias("aliases"))
    return graphmerge.alias_groups(e)


@query("""SELECT c_mktsegment AS entity_type, sha1('' || c_custkey) || CASE WHEN v = 0 THEN '' ELSE 'x' END AS norm_name, sha1('' || c_custkey) AS group_name FROM customer, (SELECT unnest([0, 1]) AS v)""")
def customers_alike(spark, sf_dir):
    """Every customer comes in two spellings, of which the first is the group's."""
    c = table(spark, sf_dir, "customer")
    name, k = F.sha1(F.col("c_custkey").cast("string").cast("binary")), F.col("c_custkey")
    both = c.select(F.col("c_mktsegment").alias("entity_type"), F.inline(F.array(F.struct(name.alias("norm_name"), k.alias("pos")), F.struct(F.concat(name, F.lit("x")).alias("norm_name"), (k + 10**9).alias("pos")))))
    return graphmerge.fuzzy_groups(both, 0.97)


@query("""WITH l AS (SELECT 's' || l_suppkey AS source_entity, 'p' || l_partkey AS target_entity, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'deliveredgoods' ELSE 'deliveredgood' END AS t FROM lineitem)
SELECT source_entity, target_entity, arg_min(t, (pos, t)) AS relation_type, count(*) AS n FROM l GROUP BY source_entity, target_entity""")
def supply_types_alike(spark, sf_dir):
    """Two spellings of a relation's type take the first one's."""
    li = table(spark, sf_dir, "lineitem")
    t = F.when(F.col("l_linenumber") % 2 == 0, "delivered goods").otherwise("delivered good")
    rel = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source_entity"), F.concat(F.lit("p"), "l_partkey").alias("target_entity"), t.alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return graphmerge.fuzzy_relation_types(rel).groupBy("source_entity", "target_entity", "relation_type").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT n_nationkey, CAST((SELECT count(*) FROM k WHERE c_nationkey = n_nationkey AND n <= 7) AS INTEGER) AS chunks, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS first FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def nation_chunk_refs(spark, sf_dir):
    """The first chunks that share a key with a node, at most seven."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    nodes = nation.select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.lit("d").alias("doc_id"), F.array(F.concat(F.lit("k"), "n_nationkey"), F.lit("none")).alias("keys"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"), F.col("c_custkey").alias("pos"), F.array(F.concat(F.lit("k"), "c_nationkey")).alias("keys"))
    got = graphmerge.attach_chunk_refs(nodes, chunks, cap=7)
    return got.select("n_nationkey", F.size("chunk_ids").alias("chunks"), F.get("chunk_ids", F.lit(0)).cast("long").alias("first"))


@query("""SELECT 'chain' AS what, false AS circle UNION ALL SELECT 'ring', count(*) > 1 FROM nation""")
def nation_circles(spark, sf_dir):
    """Customers by key are a chain; with an edge back to the start they'd be a ring, as nations are here."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    n = table(spark, sf_dir, "nation")
    ring = n.crossJoin(n.agg(F.count("*").alias("m"))).select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % F.col("m")).alias("dst"))  # one row beside
    return spark.createDataFrame([("chain", graphmerge.has_cycle(k)), ("ring", graphmerge.has_cycle(ring))], "what string, circle boolean")


# Patterns and rules


@query("""SELECT DISTINCT c_mktsegment AS segment, 'urn:x#nation/' || c_nationkey AS nation FROM customer""")
def segment_nations(spark, sf_dir):
    """Q9: a distinct projection in the order asked for."""
    node = Node("customer", "Customer", [Prop("segment", "segment")], [Link("inNation", Node("nation"))])
    return select(Graph(star_triples(spark, sf_dir)).match(node), ["segment", "nation"])


@query("""SELECT 'urn:x#region/' || a.r AS region, n.n_name AS n_name FROM (SELECT DISTINCT n_regionkey AS r FROM nation) a, nation n""")
def regions_by_nations(spark, sf_dir):
    """Q16: two heads without a link multiply, since that is asked for."""
    heads = [Node("region", "Region"), Node("nation", "Nation", [Prop("nationName", "n_name")])]
    return select(Graph(star_triples(spark, sf_dir)).match_all(heads, allow_product=True), ["region", "n_name"])


@query("""SELECT DISTINCT 'urn:x#nation/' || n_nationkey AS x, n_name AS name FROM nation""")
def names_by_domain(spark, sf_dir):
    """Q1, Q3: custName and nationName are sub-properties of name, and only the latter may be on a nation."""
    t = star_triples(spark, sf_dir)
    odd = t.where("p = 'nationName'").select("graph", "s", F.lit("custName").alias("p"), F.lit("not a nation's name").alias("o"), "o_kind", "o_type")
    names = spark.createDataFrame([("custName", "name"), ("nationName", "name")], "sub string, super string")
    classes = spark.createDataFrame([("Nation", "Place"), ("Customer", "Party")], "sub string, super string")
    domains = spark.createDataFrame([("custName", "Party"), ("nationName", "Nation")], "p string, domain string")
    g = Graph(t.unionByName(odd), classes, names, domains=domains)
    return select(g.match(Node("x", "Nation", [Prop("name", "name")])), ["x", "name"])


@query("""SELECT 'class' || c_custkey AS class, 'urn:x#p' AS property, 'maxCardinality' AS restriction, CAST(3 AS INTEGER) AS "limit" FROM customer UNION ALL SELECT 'Nation', 'urn:x#q', 'minCardinality', CAST(count(*) AS INTEGER) FROM nation""")
def rules_through_lists(spark, sf_dir):
    """A4: one union of as many classes as there are customers, and a rule on a class itself."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    following = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.concat(F.lit("cell"), k).alias("next"))
    cells = c.join(following, "c_custkey", "left").withColumn("next", F.coalesce("next", F.lit("rdf:nil")))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    listed = cells.select(F.inline(F.array(triple(F.concat(F.lit("cell"), k), "rdf:first", F.concat(F.lit("class"), k)), triple(F.concat(F.lit("cell"), k), "rdf:rest", F.col("next")))))
    head = c.agg(F.concat(F.lit("cell"), F.min("c_custkey").cast("string")).alias("cell")).select(F.inline(F.array(triple(F.lit("u"), "owl:unionOf", F.col("cell")), triple(F.lit("u"), "rdfs:subClassOf", F.lit("r1")))))
    n = table(spark, sf_dir, "nation").agg(F.count("*").cast("string").alias("n"))
    rest = n.select(F.inline(F.array(triple(F.lit("r1"), "owl:onProperty", F.lit("urn:x#p")), triple(F.lit("r1"), "owl:maxCardinality", F.lit("3")), triple(F.lit("Nation"), "rdfs:subClassOf", F.lit("r2")), triple(F.lit("r2"), "owl:onProperty", F.lit("urn:x#q")), triple(F.lit("r2"), "owl:minCardinality", F.col("n")))))
    got = audit.cardinality_rules(listed.unionByName(head).unionByName(rest))
    return got.where("class != 'u'")


@query("""SELECT c_custkey AS row, 'urn:x#customer/' || c_custkey AS target, 'urn:x#customer/' || (c_custkey + 1) AS duplicate FROM customer c WHERE EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey + 1)""")
def pairs_by_name(spark, sf_dir):
    """Targets and duplicates are named by their property."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("d_name"))
    rows = c.join(other, "c_custkey").select(F.col("c_custkey").alias("row"), "c_name", "d_name")
    classes = spark.createDataFrame([("Customer", "Party")], "sub string, super string")
    return audit.combine_by_lookup(star_triples(spark, sf_dir), rows, {"custName": "c_name"}, {"custName": "d_name"}, classes)[0]


# Tables


@query("""SELECT c.n AS "n-ng1", s.n AS "n-rich", s.top AS top, coalesce(c.k, s.k) AS k, coalesce(c.r, s.r) AS r FROM (SELECT c_nationkey AS k, 1 AS r, count(*) AS n FROM customer GROUP BY 1) c
FULL JOIN (SELECT c_nationkey AS k, 1 AS r, count(*) AS n, max(c_acctbal) AS top FROM customer WHERE c_acctbal > 5000 GROUP BY 1) s USING (k)""")
def stitched_clash(spark, sf_dir):
    """B1: n is in both steps and takes their names, top in one, r is common."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("r"), "c_acctbal")
    both = c.groupBy("k", "r").agg(F.count("*").alias("n"))
    rich = c.where("c_acctbal > 5000").groupBy("k", "r").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))
    return tableprep.stitch([both, rich], ["k"], ["r"], ["ng1", "rich"])[0]


@query("""SELECT '' || p_size AS size, row_number() OVER (ORDER BY p_size DESC, '' || p_size) AS place FROM (SELECT DISTINCT p_size FROM part)""")
def sizes_in_order(spark, sf_dir):
    """Text sorted as numbers, highest first."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("size")).distinct()
    return tableprep.numbered(tableprep.sort_as(p, "size", "int", True), "place")


@query("""SELECT true AS same_in_any_order, false AS same_without_a_row FROM (SELECT count(*) FROM part)""")
def part_hashes(spark, sf_dir):
    """The order of rows doesn't matter, a row that is gone does."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    h = [tableprep.table_hash(x).select(F.col("table_hash").alias(n)) for n, x in (("a", p), ("b", p.orderBy("p_name")), ("c", p.where("p_partkey != 1")))]
    return h[0].crossJoin(h[1]).crossJoin(h[2]).select((F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") == F.col("c")).alias("same_without_a_row"))  # three rows


@query("""SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, CAST(86400 * 9 AS BIGINT) AS seconds FROM events WHERE ts >= (SELECT min(ts)::DATE FROM events) AND ts < (SELECT min(ts)::DATE FROM events) + INTERVAL 10 DAY GROUP BY 1""")
def first_days(spark, sf_dir):
    """M4: the days that bounds cover prune."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    low, high = (">=", f"{first:%Y-%m-%d %H:%M:%S}"), ("<=", f"{first + timedelta(days=9):%m/%d/%Y %H:%M:%S}")
    day = F.date_format("ts", "yyyyMMdd")
    return e.where(day.isin(timeseries.time_dates(low, high))).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.lit(timeseries.time_span_seconds(low, high)).cast("long").alias("seconds"))


# Whole results of merging, arrays included


@query("""WITH e AS (SELECT *, regexp_replace(lower(trim(p_name)), '[\\s\\-_.:,;!?]', '', 'g') AS norm_name, 'c' || p_partkey % 50 AS chunk FROM part)
SELECT p_brand AS entity_type, norm_name, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS source_names, string_agg('' || p_partkey, ',' ORDER BY p_partkey) AS merged_from,
string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS source_chunk_ids FROM e GROUP BY p_brand, norm_name""")
def part_entity_arrays(spark, sf_dir):
    """Names, ids and chunks of each merged entity."""
    got = graphmerge.merge_entities_exact(part_entities(spark, sf_dir))
    return got.select("entity_type", "norm_name", F.array_join("source_names", "|").alias("source_names"), F.array_join("merged_from", ",").alias("merged_from"), F.array_join("source_chunk_ids", ",").alias("source_chunk_ids"))


@query("""WITH e AS (SELECT *, regexp_replace(lower(trim(p_name)), '[\\s\\-_.:,;!?]', '', 'g') AS k FROM part)
SELECT '' || p_partkey AS raw_id, 'canon_ent_' || substr(sha1(first_value(p_name) OVER w || '|' || p_brand), 1, 24) AS canonical_id FROM e WINDOW w AS (PARTITION BY p_brand, k ORDER BY p_partkey)""")
def part_merge_rows(spark, sf_dir):
    """The map from the merged entities' own lists."""
    return graphmerge.entity_merge_map(graphmerge.merge_entities_exact(part_entities(spark, sf_dir)))


@query("""WITH l AS (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS t, l_quantity AS w, l_orderkey || '-' || l_linenumber AS id, 'c' || l_orderkey % 9 AS chunk FROM lineitem)
SELECT s AS source_entity, t AS target_entity, max(w) AS weight, string_agg(id, ',' ORDER BY id) AS merged_from, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS source_chunk_ids FROM l GROUP BY s, t""")
def supply_relation_lists(spark, sf_dir):
    """Ids and chunks of each merged relation."""
    li = table(spark, sf_dir, "lineitem")
    rel = li.select(
        F.concat(F.lit("p"), "l_partkey").alias("source_entity"), F.concat(F.lit("s"), "l_suppkey").alias("target_entity"), F.lit("supplied by").alias("relation_type"), F.col("l_quantity").alias("weight"),
        F.lit(None).cast("string").alias("description"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relation_id"), F.concat(F.lit("c"), (F.col("l_orderkey") % 9).cast("string")).alias("source_chunk_id"), F.col("l_orderkey").alias("pos"),
    )
    got = graphmerge.merge_relations(rel)
    return got.select("source_entity", "target_entity", "weight", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("source_chunk_ids", ",").alias("source_chunk_ids"))


@query()
def customer_names_alike(spark, sf_dir):
    """G5 on templated names as they are; SQL has no matching-blocks ratio, so tests hold it against the greedy rule by brute force."""
    c = table(spark, sf_dir, "customer")
    names = c.groupBy(F.lit("customer").alias("entity_type"), normalize_name(F.col("c_name")).alias("norm_name")).agg(F.min("c_custkey").alias("pos"))
    return graphmerge.fuzzy_groups(names)


# Paths from bound starts


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT 'urn:o/' || a.o_orderkey AS first, count(*) AS later, max('urn:o/' || b.o_orderkey) AS greatest FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.n > a.n WHERE a.o_totalprice > 400000 GROUP BY a.o_orderkey""")
def orders_after_dear_ones(spark, sf_dir):
    """Q6: what follows each dear order of a customer, over one or more links to the next order."""
    o = table(spark, sf_dir, "orders")
    uri = lambda c: F.concat(F.lit("urn:o/"), c)
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    triple = lambda p, value, kind: F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    made = F.array(triple(TYPE, F.lit("Order"), "uri"), triple("total", F.col("o_totalprice"), "literal"), triple("next", uri(F.col("next")), "uri"))
    triples = stage(o.select("*", after.alias("next")).select(uri(F.col("o_orderkey")).alias("s"), F.inline(made)).where("o is not null"), "order-triples", ["p"])
    dear = Node("first", "Order", [Prop("total", "t", where=[Where(">", 400000.0, "double")])], [Link("next", Node("later", "Order"), qualifier="+")])
    return select(Graph(triples).match(dear), ["first"], [("COUNT", "later", "later"), ("MAX", "later", "greatest")], ["first"])


# Storage


@query("""SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT min(ts)::DATE FROM events) + INTERVAL 3 DAY AND ts <= (SELECT min(ts)::DATE FROM events) + INTERVAL 6 DAY + INTERVAL 12 HOUR GROUP BY 1""")
def events_of_days(spark, sf_dir):
    """M4: events stored by day; only the days that the bounds cover are read."""
    e, path = table(spark, sf_dir, "events"), new_path(spark, "events-by-day")
    timeseries.write_by_day(e, "ts", path)
    first = e.agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    at = lambda **k: f"{first + timedelta(**k):%Y-%m-%d %H:%M:%S}"
    got = timeseries.read_days(spark, path, "ts", (">=", at(days=3)), ("<=", at(days=6, hours=12)))
    return got.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT p_partkey % 7 AS k, count(*) AS n, sum(p_size) AS sizes, sha256(string_agg(p_name, ',' ORDER BY p_partkey)) AS names FROM part GROUP BY 1""")
def parts_through_jdbc(spark, sf_dir):
    """S3: parts written to an embedded database, which lives in one process, and read back in four ranges."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "parts").option("createTableColumnTypes", "p_name VARCHAR(200)").save()
    got = io.read_table_jdbc(spark, url, 'SELECT "p_partkey" AS "k", "p_name" AS "name", "p_size" AS "size" FROM parts', column="k", parts=4, driver=driver)
    names = F.array_join(F.array_sort(F.collect_list(F.struct("k", "name"))).getField("name"), ",")
    return got.groupBy((F.col("k") % 7).alias("k7")).agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.sha2(names, 256).alias("names")).withColumnRenamed("k7", "k")


@query("""SELECT p, count(*) AS n FROM (
SELECT 'custName' AS p, c_custkey AS k FROM customer UNION ALL SELECT 'segment', c_custkey FROM customer UNION ALL SELECT 'balance', c_custkey FROM customer UNION ALL SELECT 'inNation', c_custkey FROM customer
UNION ALL SELECT 'rdf:type', c_custkey FROM customer UNION ALL SELECT DISTINCT 'rdf:type', c_nationkey FROM customer) GROUP BY p""")
def customers_loaded_twice(spark, sf_dir):
    """Loading the same rows again adds nothing, nor do the parts of them that another load has."""
    c, path = table(spark, sf_dir, "customer"), new_path(spark, "loaded")
    for rows in (c.where("c_acctbal > 0"), c, c):
        tableprep.load(rows, [CUSTOMER, NATION_REF], path)
    return tableprep.read_loaded(spark, path).groupBy("p").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT 'urn:x#customer/' || c_custkey AS focus, * FROM customer), o AS (SELECT 'urn:x#order/' || o_orderkey AS focus, * FROM orders)
SELECT focus, 'maxInclusive' AS shape, '' || k AS bound, '' || count(*) AS n FROM c, (SELECT unnest(range(5000, 10000, 100)) AS k) WHERE c_acctbal > k GROUP BY ALL
UNION ALL SELECT focus, 'pattern', '1$', '1' FROM c WHERE NOT regexp_matches(c_name, '1$')
UNION ALL SELECT focus, 'in', 'BUILDING', '1' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT focus, 'closed', 'total', '1' FROM o
UNION ALL SELECT focus, 'lessThan', 'total', '1' FROM o WHERE o_orderstatus = 'none'
UNION ALL SELECT focus, 'minLength', '9', '1' FROM c WHERE length(c_mktsegment) < 9""")
def many_shapes(spark, sf_dir):
    """Fifty-odd shapes as a table, one plan."""
    shapes = [{"target": "Customer", "path": "balance", "kind": "maxInclusive", "value": k} for k in range(5000, 10000, 100)]
    shapes += [{"target": "Customer", "path": "custName", "kind": "pattern", "value": "1$"}, {"target": "Customer", "path": "segment", "kind": "in", "value": ["BUILDING", "MACHINERY"]}]
    shapes += [{"target": "Order", "kind": "closed", "value": ["total", "placedBy"]}, {"target": "Order", "path": "total", "kind": "minCount", "value": 1}, {"target": "Order", "path": "placedBy", "kind": "class", "value": "Customer"}]
    shapes += [{"target": "Customer", "path": "segment", "kind": "minLength", "value": 9}, {"target": "Customer", "path": "custName", "kind": "disjoint", "value": "segment"}]
    triples = star_triples(spark, sf_dir)
    got = audit.shape_check(triples, shapes)
    bound = F.when(F.col("shape") == "in", "BUILDING").when(F.col("shape") == "closed", "total").otherwise(F.regexp_extract("message", r"(\S+)$", 1))
    # a group's rows are as many as the faults, nearly: they are dealt before they are counted, and not counted by each task first
    dealt = got.select("focus", "shape", bound.alias("bound")).repartition(*audit.shape_tasks(triples, shapes), "focus")
    return dealt.groupBy("focus", "shape", "bound").agg(F.count("*").cast("string").alias("n"))


@query("""WITH m AS (SELECT 'c' || c_custkey AS e, 'n' || c_nationkey AS hub FROM customer), a AS (SELECT e AS x, hub FROM m UNION SELECT hub, hub FROM m),
g AS (SELECT hub, min(x) AS least, count(*) AS entity_count, string_agg(x, '|' ORDER BY x) AS ids FROM a GROUP BY hub)
SELECT least, 'comp_' || substr(sha1(ids), 1, 12) AS component_id, entity_count FROM g""")
def customer_component_ids(spark, sf_dir):
    """Ids of components by a running digest over their sorted members."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_entity"), F.concat(F.lit("n"), "c_nationkey").alias("target_entity"))
    entities = c.select(F.explode(F.array("source_entity", "target_entity")).alias("entity_id")).distinct()
    return graphmerge.component_ids(graphmerge.graph_components(entities, c))
