"""Registered queries on entity merging, tables, patterns, audits and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog import CUSTOMER, NATION_REF, part_entities, star_triples
from loomgraph.operators import audit, graphmerge, tableprep, timeseries
from loomgraph.plans.pattern import Graph, Link, Node, Prop, Where, closure, count, select
from loomgraph.registry import query
from loomgraph.runtime import table

# Entities and relations

NORM = "regexp_replace(lower(trim({})), '[\\s\\-_.:,;!?]', '', 'g')"


@query("""SELECT 'c' || (p_partkey % 50) AS source_chunk_id, p_name AS entity_name, CAST(min(p_partkey) AS VARCHAR) AS entity_id, 'ent_' || substr(sha1('c' || (p_partkey % 50) || '|' || p_name), 1, 24) AS mention_id FROM part GROUP BY p_partkey % 50, p_name""")
def part_mentions(spark, sf_dir):
    """G1."""
    return graphmerge.dedupe_mentions(part_entities(spark, sf_dir), ["entity_name"]).select("source_chunk_id", "entity_name", "entity_id", "mention_id")


@query(f"""WITH e AS (SELECT *, {NORM.format("p_name")} AS k FROM part), c AS (SELECT k, arg_min(p_name, p_partkey) AS name, arg_min(p_brand, p_partkey) AS brand, count(*) AS n FROM e GROUP BY k)
SELECT 'canon_ent_' || substr(sha1(name || '|' || brand), 1, 24) AS canonical_id, brand AS entity_type, least(n, 64) AS sources FROM c""")
def parts_by_name(spark, sf_dir):
    """G7."""
    return graphmerge.merge_entities_exact(part_entities(spark, sf_dir), by_type=False).select("canonical_id", "entity_type", F.size("merged_from").cast("long").alias("sources"))


MERGED_SQL = f"""e AS (SELECT *, {NORM.format("p_name")} AS k FROM part),
m AS (SELECT p_partkey, p_name, 'canon_ent_' || substr(sha1(first_value(p_name) OVER w || '|' || p_brand), 1, 24) AS canonical_id FROM e WINDOW w AS (PARTITION BY p_brand, k ORDER BY p_partkey))"""


@query(f"""WITH {MERGED_SQL} SELECT CAST(p_partkey AS VARCHAR) AS raw_id, canonical_id FROM m""")
def part_merge_map(spark, sf_dir):
    """G6."""
    parts = part_entities(spark, sf_dir)
    return graphmerge.entity_members(parts, graphmerge.canonical_entities(parts))


@query("""SELECT 'c' || o_custkey AS source_entity, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS target_entity, count(*) AS n FROM orders GROUP BY ALL""")
def order_ends(spark, sf_dir):
    """An end as written, another after normalising, one unknown; blank ends go."""
    o = table(spark, sf_dir, "orders")
    rel = o.select(F.concat(F.lit("c"), "o_custkey").alias("source_entity"), F.when(F.col("o_orderstatus") == "O", " o. ").otherwise(F.col("o_orderstatus")).alias("target_entity"))
    blank = o.select(F.lit("x").alias("source_entity"), F.lit(" ").alias("target_entity"))
    names = spark.createDataFrame([("F", "done"), ("O", "open")], "raw string, canonical_id string")
    return graphmerge.resolve_endpoints(rel.unionByName(blank), names).groupBy("source_entity", "target_entity").agg(F.count("*").alias("n"))


@query("""SELECT 'n' || n_nationkey AS entity_id, n_name AS entity_name, false AS auto_created FROM nation
UNION ALL SELECT DISTINCT 'c' || c_custkey, 'c' || c_custkey, true FROM customer WHERE c_acctbal > 5000""")
def nation_graph_entities(spark, sf_dir):
    """Customers are known by relations only; ends name nations in capitals or not."""
    nation = table(spark, sf_dir, "nation")
    known = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name"), F.lit(None).cast("string").alias("description"), F.array(F.lit("a")).alias("source_chunk_ids"), F.col("n_nationkey").alias("pos"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rel = rich.select(F.concat(F.lit("c"), "c_custkey").alias("source_entity"), F.lower("n_name").alias("target_entity"), F.array(F.lit("b")).alias("source_chunk_ids"))
    return graphmerge.build_graph(known, rel)[0].select("entity_id", "entity_name", "auto_created")


@query("""SELECT 'c' || c_custkey AS entity_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def customers_in_relations(spark, sf_dir):
    """G13."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"))
    rel = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source_entity"), F.concat(F.lit("o"), "o_orderkey").alias("target_entity"))
    return graphmerge.drop_isolated(people, rel)[0]


@query("""WITH s AS (SELECT DISTINCT o_orderkey AS d FROM orders), i AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem), k AS (SELECT d, n, lead(n) OVER (PARTITION BY d ORDER BY n) AS nx FROM i)
SELECT 'CONTAINS' AS type, (SELECT count(*) FROM s) + (SELECT count(*) FROM i) AS n UNION ALL SELECT 'BEFORE', count(*) FROM k WHERE nx IS NOT NULL UNION ALL SELECT 'NEXT_STEP', count(*) FROM k WHERE nx IS NOT NULL
UNION ALL SELECT 'REFERENCES', count(*) FROM i""")
def process_edges(spark, sf_dir):
    """An order is a document, its lines are steps that each mention a tool."""
    from pyspark.sql import Window as W

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("1").alias("section_id"), F.lit("lines").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).distinct()
    w = W.partitionBy("doc_id").orderBy("seq")
    near = lambda f: F.coalesce(F.concat(F.lit("s"), f("seq").over(w).cast("string")), F.lit(""))
    steps = lines.select("doc_id", "seq", F.concat(F.lit("s"), F.col("seq").cast("string")).alias("step_id"), F.lit("line").alias("name"), near(F.lag).alias("before"), near(F.lead).alias("next_step"))
    edges = graphmerge.build_process_graph(orders, steps, {"Tool": (steps, "name")})[1]
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' ELSE o_orderstatus END AS type, o_orderpriority AS label FROM orders""")
def order_edges(spark, sf_dir):
    """G20."""
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.concat(F.lit(" "), "o_orderstatus")).alias("type"), F.lit("").alias("label"), F.array("o_orderpriority").alias("labels"))
    return graphmerge.normalize_edges(e, {"f": "finished"}).select("o_orderkey", "type", "label")


# Tables


@query("""SELECT p_partkey, regexp_replace(upper(p_name), '[AEIOU]', '*', 'g') AS masked, 'z' || sha1(p_brand) AS hashed, lower(p_type) AS p_type, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'kept' END AS note FROM part""")
def cleaned_parts(spark, sf_dir):
    """T1, T2, T8."""
    p = table(spark, sf_dir, "part")
    note = F.when(F.col("p_size") % 4 == 0, " Null").when(F.col("p_size") % 2 == 0, "N/A ").otherwise("kept")
    masked, hashed = tableprep.transformed(F.col("p_name"), ["toUpperCase", ("replaceAll", "[AEIOU]", "*")]), tableprep.transformed(F.col("p_brand"), ["hashCode"])
    rows = p.select(F.col("p_partkey"), masked.alias("masked"), hashed.alias("hashed"), "p_type", note.alias("note"))
    return tableprep.clean(rows, lower=["p_type"])[0]


def _paired(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("x~y").alias("b"))
    return tableprep.paired_split_rows(o, [{"a": "-", "b": "~"}])


@query("""WITH p AS (SELECT o_orderkey, list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)) AS a, CASE WHEN o_orderkey % 3 = 0 THEN ['x'] ELSE ['x', 'y'] END AS b FROM orders)
SELECT o_orderkey, unnest(a) AS a, unnest(b) AS b FROM p WHERE len(a) = len(b)""")
def paired_parts(spark, sf_dir):
    """T4."""
    return _paired(spark, sf_dir)[0]


@query("""SELECT o_orderkey, 'parts differ in number: a, b' AS error FROM orders WHERE len(string_split(o_orderpriority, '-')) <> CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END""")
def unpaired_parts(spark, sf_dir):
    """T4, T5: the rows that a paired split refuses."""
    return _paired(spark, sf_dir)[1].select("o_orderkey", "error")


@query("""SELECT c_custkey, concat_ws(';', CASE WHEN c_mktsegment = 'BUILDING' THEN 'c_mktsegment: BUILDING matches' END, CASE WHEN c_nationkey >= 20 THEN 'c_nationkey: ' || c_nationkey || ' fails lt 20' END) AS errors
FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey >= 20""")
def customer_faults(spark, sf_dir):
    """T7."""
    return tableprep.validate_table(table(spark, sf_dir, "customer"), {"c_mktsegment": {"notEmpty": True, "regexNoMatch": "BUILD.*"}, "c_nationkey": {"type": "int", "lt": 20}}).select("c_custkey", "errors")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS moment, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN '' || o_orderkey END AS even, o_orderstatus || '/' || o_orderpriority AS label FROM orders""")
def order_values(spark, sf_dir):
    """Dates written in two ways, odd numbers negative."""
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("-"), F.col("o_orderkey").cast("string")))
    label = tableprep.mapped_value(["o_orderstatus", ("text", "/"), "o_orderpriority"])[0]
    return o.select("o_orderkey", tableprep.coerce(day, "date").alias("day"), tableprep.coerce(day, "dateTime").alias("moment"), tableprep.coerce(signed, "positiveInteger").alias("even"), label.alias("label"))


@query("""SELECT p_partkey, p_size >= 10 AND p_size <= 20 AND length(p_name) <= 12 AS all_hold, p_brand = 'Brand#11' OR p_size > 45 AS any_holds FROM part""")
def part_facets(spark, sf_dir):
    """T11."""
    size, both = F.col("p_size").cast("string"), tableprep.facets_ok(F.col("p_name"), [{"maxLength": 12}])
    whole = tableprep.facets_ok(size, [{"minInclusive": 10, "maxInclusive": 20}]) & both
    some = tableprep.facets_ok(F.col("p_brand"), [{"enumeration": ["Brand#11"]}], True) | tableprep.facets_ok(size, [{"minExclusive": 45}], True)
    return table(spark, sf_dir, "part").select("p_partkey", whole.alias("all_hold"), some.alias("any_holds"))


@query("""SELECT p_partkey, 'uri://loomgraph#' || regexp_replace(trim(p_name), '[^\\w\\-.~]', '_', 'g') AS uri, p_brand AS kept, CASE WHEN p_size % 2 = 0 THEN 'urn:x#Even' END AS member FROM part WHERE trim(p_name) <> ''""")
def part_uris(spark, sf_dir):
    """A brand holds # and stays; only one member of the enumeration is asked for."""
    p = table(spark, sf_dir, "part").where("trim(p_name) != ''")
    member = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    return p.select("p_partkey", tableprep.build_uri(F.col("p_name")).alias("uri"), tableprep.build_uri(F.col("p_brand")).alias("kept"), tableprep.build_uri(member, members=["urn:x#Even"]).alias("member"))


@query("""WITH f AS (SELECT n_name, min('urn:x#nation/' || n_nationkey) AS u FROM nation GROUP BY n_name)
SELECT s_suppkey, coalesce(u, 'uri://loomgraph#' || sha256(chr(31) || k)) AS uri FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'New ' || (s_suppkey % 8) ELSE n_name END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN f ON k = n_name""")
def supplier_nation_minted(spark, sf_dir):
    """Suppliers of a new nation share its new id."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("New "), (F.col("s_suppkey") % 8).cast("string"))).otherwise(F.col("n_name"))
    return tableprep.lookup_uris(rows.select("s_suppkey", name.alias("nationName")), {"nationName": "nationName"}, star_triples(spark, sf_dir), "createIfMissing").select("s_suppkey", "uri")


@query("""SELECT 'urn:x#order/' || o_orderkey AS uri FROM orders""")
def not_parties(spark, sf_dir):
    """Of customers and orders, those that are no party or subclass of it."""
    triples = star_triples(spark, sf_dir)
    asked = triples.where("p in ('custName', 'total')").select(F.col("s").alias("uri"))
    return tableprep.check_type_restriction(asked, "uri", triples, spark.createDataFrame([("Customer", "Buyer"), ("Buyer", "Party")], "sub string, super string"), "Party")


@query("""SELECT count(*) AS n, min(error) AS error FROM (SELECT 'balance: no double: ' || c_name AS error FROM customer WHERE c_custkey % 5 = 0)""")
def customer_load_errors(spark, sf_dir):
    """Rows whose balance is no number are errors, not triples."""
    c = table(spark, sf_dir, "customer")
    bad = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string")))
    return tableprep.rows_to_triples(bad, [CUSTOMER, NATION_REF])[1].agg(F.count("*").alias("n"), F.min("error").alias("error"))


@query("""SELECT DISTINCT c_nationkey AS k, c_mktsegment AS seg, s_suppkey AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey""")
def segments_and_suppliers(spark, sf_dir):
    """B2."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    return tableprep.fuse_tables({"c": c, "s": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("supplier"))}, ["k"])


@query("""SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier""")
def all_balances(spark, sf_dir):
    """Columns in another order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return tableprep.append_tables([c, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


@query("""SELECT o_orderkey, o_orderstatus || '|open|' || o_orderpriority AS label FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def dear_orders_page(spark, sf_dir):
    """The third page of the dearest open orders."""
    o = tableprep.subset_matches(table(spark, sf_dir, "orders"), "o_orderstatus", "O")
    third = tableprep.page(o.withColumn("_down", -F.col("o_totalprice")), ["_down", "o_orderkey"], 50, 25)
    return tableprep.add_joined_column(third, "label", ["o_orderstatus", '"open"', "o_orderpriority"], "|").select("o_orderkey", "label")


@query("""SELECT count(DISTINCT p_brand) <= 1 AS p_brand, count(DISTINCT p_size) <= 1 AS p_size, (SELECT count(*) FROM (SELECT DISTINCT p_type FROM part)) AS types FROM part""")
def part_uniformity(spark, sf_dir):
    """B9."""
    p = table(spark, sf_dir, "part")
    return tableprep.all_rows_match(p, ["p_brand", "p_size"]).join(tableprep.unique_values(p, "p_type").agg(F.count("*").alias("types")))


@query("""SELECT p_brand, sha1(p_brand || chr(31) || p_type) AS group_id, ' --- ' AS unit, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand, p_type""")
def part_regrouped(spark, sf_dir):
    """Outside rows of each group, with a column they lack."""
    p = table(spark, sf_dir, "part")
    groups = tableprep.fetch_groups(p, ["p_brand", "p_type"], ["p_size"])
    outside = p.where("p_size > 25").select("p_partkey", F.sha1(F.concat_ws("\x1f", "p_brand", "p_type").cast("binary")).alias("group_id"))
    return tableprep.regroup(groups, outside, ["p_brand", "group_id", "unit"]).groupBy("p_brand", "group_id", "unit").agg(F.count("*").alias("n"))


# Patterns


def _classes(spark):
    return spark.createDataFrame([("Nation", "Place"), ("Region", "Place"), ("Customer", "Buyer"), ("Buyer", "Party")], "sub string, super string")


@query("""SELECT 'Nation' AS sub, 'Place' AS super UNION ALL SELECT 'Region', 'Place' UNION ALL SELECT 'Customer', 'Buyer' UNION ALL SELECT 'Buyer', 'Party' UNION ALL SELECT 'Customer', 'Party'
UNION ALL SELECT c, c FROM (SELECT unnest(['Nation', 'Region', 'Place', 'Customer', 'Buyer', 'Party']) AS c)
UNION ALL SELECT cls, 'used' FROM (SELECT 'Order' AS cls FROM orders UNION SELECT 'Customer' FROM customer UNION SELECT 'Customer' FROM orders UNION SELECT 'Nation' FROM nation UNION SELECT 'Region' FROM nation)""")
def class_closure(spark, sf_dir):
    """Q1: each class is its own superclass too; every class in use is one of "used"."""
    used = audit.types(star_triples(spark, sf_dir)).select(F.col("cls").alias("sub"), F.lit("used").alias("super")).distinct()
    return closure(_classes(spark)).unionByName(used)


@query("""SELECT 'urn:x#nation/' || k AS x, 'Nation' AS cls FROM (SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer) UNION ALL SELECT DISTINCT 'urn:x#region/' || n_regionkey, 'Region' FROM nation""")
def places(spark, sf_dir):
    """Q2: instances of two subclasses."""
    return select(Graph(star_triples(spark, sf_dir), _classes(spark)).match(Node("x", "Place", type_var="cls")), ["x", "cls"])


@query("""SELECT DISTINCT 'urn:x#customer/' || c_custkey AS customer, 'urn:x#region/' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def customer_regions(spark, sf_dir):
    """Q3, Q6: one or more steps of a property and its sub-properties."""
    within = spark.createDataFrame([("inNation", "within"), ("inRegion", "within")], "sub string, super string")
    g = Graph(star_triples(spark, sf_dir), properties=within)
    return select(g.match(Node("customer", "Customer", links=[Link("within", Node("region", "Region"), qualifier="+")])), ["customer", "region"])


@query("""SELECT DISTINCT 'urn:x#nation/' || c_nationkey AS nation, 'urn:x#customer/' || c_custkey AS customer FROM customer""")
def nation_customers(spark, sf_dir):
    """Q6: an inverse path."""
    return select(Graph(star_triples(spark, sf_dir)).match(Node("nation", "Nation", links=[Link("inNation", Node("customer"), qualifier="^")])), ["nation", "customer"])


@query("""SELECT 'urn:x#customer/' || c_custkey AS customer FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000 AND regexp_matches(c_mktsegment, '^B') AND c_name <> c_mktsegment""")
def customers_by_constraints(spark, sf_dir):
    """Q7, Q8: bounds, a pattern and a comparison of two variables."""
    props = [Prop("balance", "balance", where=[Where(">=", 1000.0, "double"), Where("<", 2000.0, "double")]), Prop("segment", "segment", where=[Where("regex", "^B")]), Prop("custName", "name", where=[Where("!=", other="segment")])]
    return select(Graph(star_triples(spark, sf_dir)).match(Node("customer", "Customer", props)), ["customer"])


@query("""SELECT c_mktsegment AS segment, count(*) AS customers, string_agg('urn:x#customer/' || c_custkey, ' ' ORDER BY 'urn:x#customer/' || c_custkey) AS names FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment ORDER BY segment LIMIT 3 OFFSET 1""")
def nation_segments(spark, sf_dir):
    """Q10, Q11."""
    node = Node("customer", "Customer", [Prop("segment", "segment")], [Link("inNation", Node("nation", "Nation", where=[Where("in", ["urn:x#nation/3"])]))])
    found = Graph(star_triples(spark, sf_dir)).match(node)
    return select(found, ["segment"], [("COUNT", "customer", "customers"), ("GROUP_CONCAT", "customer", "names")], ["segment"], ["segment"], 3, 1)


@query("""SELECT count(*) AS count FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""")
def customer_status_count(spark, sf_dir):
    """Q12: rows of the distinct projection."""
    g = Graph(star_triples(spark, sf_dir))
    return count(g.match(Node("order", "Order", [Prop("status", "status")], [Link("placedBy", Node("customer"))])), ["customer", "status"])


@query("""SELECT DISTINCT c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000""")
def rich_segments(spark, sf_dir):
    """Q13: the variable's own constraint is dropped, others stay."""
    node = Node("customer", "Customer", [Prop("segment", "segment", where=[Where("in", ["BUILDING"])]), Prop("balance", "balance", where=[Where(">", 9000.0, "double")])])
    return Graph(star_triples(spark, sf_dir)).distinct_values(node, "segment")


@query("""SELECT 'inside' AS mode, 'segment' AS p, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'inside', 'custName', count(*) FROM customer
UNION ALL SELECT 'type_only', 'segment', count(*) FROM customer UNION ALL SELECT 'type_only', 'custName', count(*) FROM customer
UNION ALL SELECT 'type_only', 'rdf:type', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT 'inside', 'rdf:type', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def deletes_by_mode(spark, sf_dir):
    """Q15: the other two modes."""
    g = Graph(star_triples(spark, sf_dir).where("p in ('segment', 'custName') or (p = 'rdf:type' and o = 'Customer')"))
    node = Node("customer", "Customer", [Prop("segment", "segment", where=[Where("in", ["BUILDING"])])])
    left = [g.delete(node, m).groupBy(F.lit(m).alias("mode"), "p").agg(F.count("*").alias("n")) for m in ("inside", "type_only")]
    return left[0].unionByName(left[1])


@query("""SELECT 'urn:x#customer/' || c_custkey AS s, 'Customer' AS cls FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'urn:x#region/' || n_regionkey, 'Region' FROM nation""")
def customers_and_regions(spark, sf_dir):
    """Q17, Q20."""
    return Graph(star_triples(spark, sf_dir, []), graphs=["default"]).subjects_of_classes(["Customer", "Region"])


@query("""SELECT p FROM (SELECT 'rdf:type' AS p, (SELECT count(*) FROM nation WHERE n_nationkey IN (1, 2)) AS n UNION ALL SELECT 'nationName', (SELECT count(*) FROM nation WHERE n_nationkey IN (1, 2)) UNION ALL SELECT 'inRegion', (SELECT count(*) FROM nation WHERE n_nationkey IN (1, 2))) WHERE n = 2""")
def shared_by_two_nations(spark, sf_dir):
    """Q21."""
    return Graph(star_triples(spark, sf_dir)).shared_predicates("urn:x#nation/1", "urn:x#nation/2")


# Audits


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
n AS (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders))
SELECT 'Customer' AS class, CAST(k AS INTEGER) AS property_count, n.n AS instance_count, count(*) AS subjects FROM c, n WHERE k > 15 GROUP BY ALL""")
def busy_customers_concise(spark, sf_dir):
    """A6."""
    triples = star_triples(spark, sf_dir)
    orders = triples.where("p = 'placedBy'").select("graph", F.col("o").alias("s"), F.lit("orders").alias("p"), F.col("s").alias("o"), "o_kind", "o_type")
    rules = spark.createDataFrame([("Customer", "orders", "maxCardinality", 15)], "class string, property string, restriction string, limit int")
    got = audit.violations_concise(audit.cardinality_violations(triples.unionByName(orders), rules), audit.class_instance_counts(triples))
    return got.select("class", "property_count", "instance_count", F.size("subject_list").cast("long").alias("subjects"))


@query("""SELECT o_custkey AS id, count(*) >= 2 AND count(*) <= 15 AS ok FROM orders GROUP BY o_custkey""")
def customers_within_limits(spark, sf_dir):
    """A7."""
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).withColumn("class", F.lit("Customer")).withColumn("property", F.lit("orders"))
    rules = [("Customer", "orders", "maxCardinality", 15), ("Customer", "orders", "minCardinality", 2)]
    return audit.satisfies_cardinality(facts, spark.createDataFrame(rules, "class string, property string, restriction string, limit int"))


@query("""WITH c AS (SELECT * FROM customer WHERE c_acctbal >= 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'balance' AS p, count(*) AS n FROM c UNION ALL SELECT 'placedBy', count(*) FROM o UNION ALL SELECT 'total', count(*) FROM o UNION ALL SELECT 'nationName', count(*) FROM nation""")
def pruned_graph(spark, sf_dir):
    """A10: customers in debt go, then orders that nobody has placed."""
    shapes = [{"target": "Customer", "path": "balance", "kind": "minInclusive", "value": 0.0}, {"target": "Order", "path": "placedBy", "kind": "minCount", "value": 1}]
    left = audit.prune_by_shapes(star_triples(spark, sf_dir), shapes)
    return left.where("p in ('balance', 'placedBy', 'total', 'nationName')").groupBy("p").agg(F.count("*").alias("n"))


def _same_as(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("urn:x#customer/"), c.cast("string"))
    return table(spark, sf_dir, "customer").where("c_custkey % 10 in (1, 2)").select(k.alias("row"), name(k).alias("target"), name(k + 1).alias("duplicate"))


@query("""SELECT c_custkey AS row, 'urn:x#customer/' || c_custkey AS target, 'urn:x#customer/' || (c_custkey + 1) AS duplicate FROM customer c WHERE c_custkey % 10 = 2
OR (c_custkey % 10 = 1 AND NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey + 1))""")
def same_as_leaves(spark, sf_dir):
    """A chain of two, of which the last comes first."""
    return audit.same_as_batch(_same_as(spark, sf_dir))


@query("""WITH m AS (SELECT o_orderkey, o_custkey - CASE o_custkey % 10 WHEN 3 THEN CASE WHEN o_custkey - 1 IN (SELECT c_custkey FROM customer) THEN CASE WHEN o_custkey - 2 IN (SELECT c_custkey FROM customer) THEN 2 ELSE 1 END ELSE 0 END
WHEN 2 THEN CASE WHEN o_custkey - 1 IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END ELSE 0 END AS c FROM orders)
SELECT 'urn:x#customer/' || c AS customer, count(*) AS orders FROM m GROUP BY c""")
def orders_after_combining(spark, sf_dir):
    """Chains of same customers become one, which has all their orders."""
    triples = star_triples(spark, sf_dir)
    rules = [("Customer", p, "maxCardinality", 1) for p in ("custName", "segment", "balance", "inNation")]
    got, _ = audit.combine_entities(triples, _same_as(spark, sf_dir), spark.createDataFrame(rules, "class string, property string, restriction string, limit int"))
    return got.where("p = 'placedBy'").groupBy(F.col("o").alias("customer")).agg(F.count("*").alias("orders"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), t AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders), r AS (SELECT k AS row, k AS t, CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN k + 1 WHEN k % 4 = 2 THEN k ELSE k - 1 END AS d FROM c)
SELECT row, 'target is its own duplicate' AS error FROM r WHERE t = d UNION ALL SELECT row, 'duplicate is in several rows' FROM r WHERE d IN (SELECT d FROM r GROUP BY d HAVING count(DISTINCT row) > 1)""")
def same_as_faults(spark, sf_dir):
    """A11."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("urn:x#customer/"), c.cast("string"))
    other = F.when(k % 4 == 0, k).when(k % 4 == 1, k + 1).when(k % 4 == 2, k).otherwise(k - 1)
    rows = table(spark, sf_dir, "customer").select(k.alias("row"), name(k).alias("target"), name(other).alias("duplicate"))
    return audit.same_as_precheck(rows, star_triples(spark, sf_dir), _classes(spark))


# Time series


@query("""SELECT 'u' || (user_id % 5) AS uuid, event_type AS "table", count(DISTINCT user_id) AS tags FROM events GROUP BY ALL""")
def event_sources(spark, sf_dir):
    """M7."""
    e = table(spark, sf_dir, "events")
    locator = e.select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("uuid"), F.lit("s").alias("server"), F.lit("d").alias("database"), F.col("event_type").alias("table"), F.lit("ts").alias("timestamp_col"), F.col("user_id").alias("tag"), F.lit("v").alias("variable"))
    return timeseries.plan_sources(locator).select("uuid", "table", F.size("tags").cast("long").alias("tags"))


@query("""SELECT ts AS timestamp, value AS v FROM events WHERE ts >= TIMESTAMP '1970-01-01 00:00:00' AND value >= 10 AND value < 20""")
def events_in_order(spark, sf_dir):
    """M1, M2, M3, M6."""
    e = timeseries.where_time(table(spark, sf_dir, "events"), "ts", (">=", "1970-01-01 00:00:00"))
    return timeseries.sort_by_time(timeseries.where_values(timeseries.select_tags(e, "ts", {"value": "v"}), [("v", ">=", 10.0), ("v", "<", 20.0)]))
