"""Golden and brute-force tests of the library's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.components import connected_components
from loomgraph.operators import audit, content, extraction, graphmerge, retrieval, tableprep, timeseries
from loomgraph.plans.pattern import TYPE, Graph, Link, Node, Prop, Where, closure, count, select
from loomgraph.sources import io

T = "graph string, s string, p string, o string, o_kind string, o_type string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def chain(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d")]
    data = [("g", x, TYPE, "Link", "uri", None) for x in "abcd"] + [("g", a, "next", b, "uri", None) for a, b in links] + [("g", x, "size", str(i), "literal", "int") for i, x in enumerate("abc")]
    return spark.createDataFrame(data, T)


def test_closure_survives_cycles(spark):
    got = closure(spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "sub string, super string"))
    assert got.count() == 9


def test_paths_optional_minus_and_counts(chain):
    g = Graph(chain)
    plus = g.match(Node("x", "Link", links=[Link("next", Node("y"), qualifier="+")]))
    assert rows(plus, "x", "y") == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    star = g.match(Node("x", "Link", links=[Link("next", Node("y", "Link"), qualifier="*")]))
    assert star.select("x", "y").distinct().count() == 10
    back = g.match(Node("x", "Link", links=[Link("next", Node("y"), qualifier="^")]))
    assert rows(back, "x", "y") == [("b", "a"), ("c", "b"), ("d", "c")]
    assert rows(g.match(Node("x", "Link", [Prop("size", "n", "minus")])), "x") == [("d",)]
    opt = g.match(Node("x", "Link", [Prop("size", "n", "optional")]))
    assert {r.x: r.n for r in opt.collect()} == {"a": "0", "b": "1", "c": "2", "d": None}
    two = select(plus, ["x"], [("COUNT", "y", "n"), ("COUNT", "x", "m")], ["x"])
    assert rows(two, "x", "n", "m") == [("a", 3, 1), ("b", 2, 1), ("c", 1, 1)]
    with pytest.raises(ValueError):
        select(plus, ["x"], [("COUNT", "y", "n")], [])
    assert count(plus, ["x"]).first()[0] == 3


def test_construct_delete_and_lookups(chain):
    g = Graph(chain)
    big = Node("x", "Link", [Prop("size", "n", where=[Where(">=", 2, "int")])])
    assert rows(g.construct(big), "s", "p", "o") == [("c", TYPE, "Link"), ("c", "size", "2")]
    left = g.delete(big, "all")
    assert left.where("s = 'c' or o = 'c'").count() == 0 and left.count() == 10 - 4
    assert rows(g.distinct_values(big, "n"), "n") == [("0",), ("1",), ("2",)]
    assert rows(g.shared_predicates("a", "d"), "p") == [(TYPE,)]
    assert rows(g.find_instance({"next": "c", "size": "1"}), "s", "cls") == [("b", "Link")]
    assert rows(g.connected_triples("b"), "s", "o") == [("a", "b"), ("b", "1"), ("b", "c")]


def test_components_match_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((n, min(m for m in parent if find(m) == find(n))) for n in parent)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert rows(got, "node", "component") == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cleaning_golden(spark):
    df = spark.createDataFrame([("Ann", "a~b~", "x##y", "NULL"), ("Bob", "c", "", " n/a ")], "who string, kids string, pets string, age string")
    got, errors = tableprep.clean(df, lower=["who"], splits={"kids": "~"})
    assert rows(got, "who", "kids", "age") == [("ann", "a", ""), ("ann", "b", ""), ("bob", "c", "")] and errors.isEmpty()
    pairs = spark.createDataFrame([("1", "a~b", "x~y"), ("2", "a~b", "x")], "k string, p string, q string")
    good, bad = tableprep.paired_split_rows(pairs, [{"p": "~", "q": "~"}])
    assert rows(good, "k", "p", "q") == [("1", "a", "x"), ("1", "b", "y")] and bad.count() == 1


def test_validation_and_types(spark):
    df = spark.createDataFrame([("5", "2020-01-01"), ("x", ""), ("", "01/02/2020")], "n string, d string").coalesce(1)
    got = tableprep.validate_table(df, {"n": {"notEmpty": True, "type": "int", "gt": 3}, "d": {"type": "date"}})
    assert [r.row_number for r in got.orderBy("row_number").collect()] == [2, 3]
    assert tableprep.validate_table(df, {"zz": {}}).first().row_number == 0
    c = spark.createDataFrame([("01/02/2020", "-3", "7")], "d string, i string, u string")
    assert tuple(c.select(tableprep.coerce(F.col("d"), "date"), tableprep.coerce(F.col("i"), "positiveInteger"), tableprep.coerce(F.col("u"), "int")).first()) == ("2020-01-02", None, "7")


def test_lookup_modes_and_hash(spark, chain):
    asked = spark.createDataFrame([("1",), ("9",), ("",), (None,)], "size string")
    got = {r.size: (r.uri, r.uri_error) for r in tableprep.lookup_uris(asked, {"size": "size"}, chain).collect()}
    assert got["1"] == ("b", None) and got["9"] == (None, "no match") and got[None] == (None, None)
    made = tableprep.lookup_uris(asked, {"size": "size"}, chain, "createIfMissing")
    assert made.where("size = '9'").first().uri.startswith("uri://loomgraph#")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert tableprep.table_hash(a).first()[0] == tableprep.table_hash(a.orderBy(F.desc("k"))).first()[0] != tableprep.table_hash(a.limit(1)).first()[0]


def test_semantic_merge_model(spark):
    data = [("d", 0, "b0", "title", "Head", 0), ("d", 1, "b1", "text", "one", 0), ("d", 2, "b2", "text", "two", 0), ("d", 3, "b3", "table", "t", 0), ("d", 4, "b4", "text", "必须 do", 0), ("d", 5, "b5", "text", "three", 0), ("d", 6, "b6", "text", "four", 1)]
    df = spark.createDataFrame(data, "doc_id string, seq int, block_id string, type string, text string, page_idx int")
    got = content.merge_semantic_blocks(content.route_blocks(df)).orderBy("group_no").collect()
    assert [(r.semantic_type, r.source_block_ids) for r in got] == [("section", ["b0", "b1", "b2"]), ("industrial_segment", ["b4"]), ("paragraph_run", ["b5"]), ("paragraph_run", ["b6"]), ("atomic", ["b3"])]
    assert got[0].text == "Head\n\none\n\ntwo"


def test_extraction(spark):
    df = spark.createDataFrame([("d", 0, "b", 1, "直径不大于5.5mm"), ("d", 1, "c", 1, "先制孔 用钻头 Al6061"), ("d", 2, "e", 2, "再铆接"), ("d", 3, "f", 2, "1.2 标题")], "doc_id string, seq int, block_id string, page int, text string")
    assert rows(extraction.extract_limits(df), "parameter", "operator", "value", "unit") == [("直径", "<=", 5.5, "mm")]
    assert rows(extraction.extract_steps(df), "step_id", "name", "before", "next_step") == [("step_1", "制孔", "", "step_2"), ("step_2", "铆接", "step_1", "")]
    assert rows(extraction.extract_materials(df), "material") == [("Al6061",)]
    s = extraction.extract_sections(df)
    assert rows(s, "section_id", "title", "level") == [("1.2", "标题", 2)]
    assert rows(extraction.validate_sections(s), "section_id", "error") == [("1.2", "missing_parent")]


def test_entity_merge_fuzzy_and_cycle(spark):
    e = spark.createDataFrame([("1", "Open AI", "Org", "x", "c1", 0), ("2", "open-ai", "Org", "longer", "c2", 1), ("3", "OpenAIs", "Org", None, "c1", 2), ("4", "Zeta", "Org", None, "c3", 3)], "entity_id string, entity_name string, entity_type string, description string, source_chunk_id string, pos int")
    assert graphmerge.merge_entities_exact(e).count() == 3
    got = graphmerge.merge_entities(e, "fuzzy", 0.9)
    assert rows(got, "canonical_name", "description", "merged_from") == [("Open AI", "longer", ["1", "2", "3"]), ("Zeta", None, ["4"])]
    assert graphmerge.has_cycle(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"))
    assert not graphmerge.has_cycle(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))


def test_combine_entities(spark):
    t = spark.createDataFrame([("g", "t", TYPE, "P", "uri", None), ("g", "d", TYPE, "P", "uri", None), ("g", "t", "one", "1", "literal", None), ("g", "d", "one", "2", "literal", None), ("g", "d", "many", "m", "literal", None), ("g", "z", "to", "d", "uri", None)], T)
    rules = spark.createDataFrame([("P", "one", "maxCardinality", 1)], "class string, property string, restriction string, limit int")
    same = spark.createDataFrame([(1, "t", "d")], "row int, target string, duplicate string")
    got, left = audit.combine_entities(t, same, rules)
    assert rows(got, "s", "p", "o") == [("t", "many", "m"), ("t", "one", "1"), ("t", TYPE, "P"), ("z", "to", "t")] and left.isEmpty()


def test_keywords_and_context(spark):
    q = spark.createDataFrame([(1, "What is the Open graph and open Store?"), (2, None)], "query_id int, query string")
    got = {r.query_id: (r.keywords, r.high, r.low) for r in retrieval.extract_keywords(q).collect()}
    assert got[1] == (["Open", "graph", "Store"], ["Open"], ["graph", "Store"]) and got[2] == ([], [], [])
    r = spark.createDataFrame([(1, "k1", "vector", 0.9, "same"), (1, "k2", "graph", 0.8, "same"), (1, "k3", "graph", 0.7, "other")], "query_id int, key string, source string, score double, text string")
    c = retrieval.build_context(r).first()
    assert c.used == 2 and c.context.startswith("[1] (vector, 0.9000)\nsame\n\n[2]")


def test_time_dates():
    assert timeseries.time_dates((">=", "2020-02-28 00:00:00"), ("<", "2020-03-01 00:00:00")) == ["20200228", "20200229", "20200301"]
    with pytest.raises(ValueError):
        timeseries.time_dates(None, ("<", "2020-03-01 00:00:00"))


def test_ntriples_round_trip_and_gremlin(spark, tmp_path):
    t = spark.createDataFrame([("default", "urn:a", "urn:p", 'x "q"\nz\\n', "literal", "urn:t"), ("default", "urn:a", "urn:p", "urn:b", "uri", None)], T)
    io.write_ntriples(t, f"{tmp_path}/n")
    assert rows(io.read_ntriples(spark, f"{tmp_path}/n"), *t.columns) == rows(t, *t.columns)
    g = io.gremlin_frame(spark.createDataFrame([("v", 1, dt.datetime(2020, 1, 1))], "`~id` string, n int, t timestamp"))
    assert g.columns == ["~id", "n:Int", "t:Date"]


def test_every_query_has_a_name_and_most_have_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 20
