"""Cases that the registered queries don't hold: long chains, bad lines, clashes, fuzzy names against the plain greedy rule."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import audit, graphmerge, retrieval, tableprep
from loomgraph.plans.pattern import Graph, Link, Node, closure
from loomgraph.sources import io


def test_long_chains_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1200)], "src long, dst long")
    assert not graphmerge.has_cycle(chain)
    assert graphmerge.has_cycle(chain.unionByName(spark.createDataFrame([(700, 300)], "src long, dst long")))
    assert graphmerge.has_cycle(spark.createDataFrame([(1, 1)], "src long, dst long")) and not graphmerge.has_cycle(chain.limit(0))
    odd = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(0, 50), (50, 51)], "src long, dst long")
    assert graphmerge.has_cycle(odd)
    up = closure(spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(70)] + [("c70", "c0")], "sub string, super string"))
    assert up.count() == 71 * 71


def test_paths_beyond_fifty_hops(spark):
    rows = [("g", f"n{i}", "next", f"n{i + 1}", "uri", "uri") for i in range(80)] + [("g", "n0", "rdf:type", "Start", "uri", "class")]
    g = Graph(spark.createDataFrame(rows, "graph string, s string, p string, o string, o_kind string, o_type string"))
    assert g.match(Node("a", "Start", links=[Link("next", Node("b"), qualifier="+")])).select("b").distinct().count() == 79  # n80 is nobody's subject


def test_union_lists_of_sixty(spark):
    rows = [("u", "owl:unionOf", "l0"), ("u", "rdfs:subClassOf", "r"), ("r", "owl:onProperty", "p"), ("r", "owl:maxCardinality", "2")]
    rows += [(f"l{i}", "rdf:first", f"C{i}") for i in range(60)] + [(f"l{i}", "rdf:rest", f"l{i + 1}" if i < 59 else "rdf:nil") for i in range(60)]
    got = audit.cardinality_rules(spark.createDataFrame(rows, "s string, p string, o string")).collect()
    assert {r["class"] for r in got} == {"u", *(f"C{i}" for i in range(60))}
    assert audit.cardinality_rules(spark.createDataFrame(rows[1:4], "s string, p string, o string")).count() == 1


def test_line_triples(spark, tmp_path):
    lines = [r'<urn:s> <urn:p> "a\u00e9\U0001F600 \\u0041\n"@en-GB .', '<urn:s> <urn:p> "1"^^<urn:int> .', "# note", "", "no triple", "_:b <urn:p> <urn:o> ."]
    (tmp_path / "t.nt").write_text("\n".join(lines))
    got = {(r.s, r.o, r.o_kind, r.o_type) for r in io.read_ntriples(spark, f"{tmp_path}/t.nt").collect()}
    assert got == {("urn:s", "aé😀 \\u0041\n", "literal", "@en-GB"), ("urn:s", "1", "literal", "urn:int"), ("_:b", "urn:o", "uri", None)}
    assert [r.value for r in io.bad_ntriples(spark, f"{tmp_path}/t.nt").collect()] == ["no triple"]


def test_stitched_names(spark):
    t = lambda rows, cols: spark.createDataFrame(rows, cols)
    steps = [t([(11, 12), (21, 22)], "col1 int, col2 int"), t([(11, 13), (21, 23)], "col1 int, col3 int"), t([(11, 100), (21, 101)], "col1 int, col3 int")]
    out, bad = tableprep.stitch(steps, ["col1"])
    assert out.columns == ["col1", "col2", "col3-ng2", "col3-ng3"] and bad.count() == 0
    assert sorted(map(tuple, out.collect())) == [(11, 12, 13, 100), (21, 22, 23, 101)]
    later, bad = tableprep.stitch([steps[0], steps[1], t([(13, 9), (None, 8)], "col3 int, col2 int")], [["col1"], ["col3"]], ["col2"])
    assert "col3" in later.columns and bad.select("a", "b").collect() == [("12", "9")]
    with pytest.raises(ValueError):
        tableprep.stitch(steps, [["col1"], ["none"]])


def test_fuzzy_groups_follow_the_greedy_rule(spark):
    r = random.Random(5)
    names = []
    for _ in range(25):
        base = "".join(r.choice("abcde") for _ in range(r.randrange(6, 30)))
        names.append(base)
        for _ in range(r.randrange(0, 4)):
            x = list(base)
            for _ in range(r.randrange(0, 3)):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[], [x[i], r.choice("abcde")], [r.choice("abcde")]])
            names.append("".join(x))
    names = list(dict.fromkeys(names))
    r.shuffle(names)
    rows = [(("A", "B")[i % 2], n, i) for i, n in enumerate(names)] + [("A", None, 99), (None, "lonely", 100)]
    for t in (0.9, 0.75):
        got = {(x.entity_type, x.norm_name): x.group_name for x in graphmerge.fuzzy_groups(spark.createDataFrame(rows, "entity_type string, norm_name string, pos long"), t).collect()}
        want, first = {(None, "lonely"): "lonely"}, {"A": [], "B": []}
        for kind, n, _ in rows[: len(names)]:
            found = next((k for k in first[kind] if graphmerge.similar(n, k, t)), None)
            if found is None:
                first[kind].append(n)
            want[kind, n] = found or n
        assert got == want


def test_substring_search_in_blocks_and_broadcast(spark):
    r = random.Random(6)
    words = ["in", "inn", "the", "other", "é", "zz"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for i in range(60)] + [(90, None), (91, "")]
    asks = [(i, " ".join(r.choice(words) for _ in range(1 + i % 3))) for i in range(12)] + [(50, " "), (51, None), (52, "The  OTHER")]
    q, d = spark.createDataFrame(asks, "query_id long, query string"), spark.createDataFrame(docs, "record_id long, text string").repartition(3)
    want = []
    for i, text in asks:
        whole = (text or "").strip().lower()
        tokens = set(whole.split())
        scored = [(-round(5.0 * (whole in t.lower()) + 2.0 * sum(w in t.lower() for w in tokens) / len(tokens), 6), n) for n, t in docs if t is not None and tokens]
        want += [(i, n, -s) for s, n in sorted(x for x in scored if x[0] < 0)[:4]]
    got = [(x.query_id, x.record_id, x.score) for x in retrieval.lexical_search(q, d, 4).collect()]
    assert sorted(got) == sorted(want)
    parts = q.selectExpr("query_id", "lower(trim(query)) as _q").selectExpr("query_id", "_q", "array_distinct(filter(split(_q, '\\\\s+'), w -> w != '')) as _t").where("_q != ''")
    rows = d.where("text is not null").selectExpr("record_id", "text", "lower(text) as _x", "0d as _bonus")
    blocks = retrieval.top_k(retrieval.substring_search(parts, rows, 4, 2.0, 5.0, block=5, shard_rows=20), 4, F.desc("score"), "record_id")
    assert sorted((x.query_id, x.record_id, x.score) for x in blocks.collect()) == sorted(want)


def test_members_and_sizes(spark):
    e = spark.createDataFrame([(str(i), f"Name {i % 3}", "T" if i % 2 else None, None, "c", i) for i in range(12)], "entity_id string, entity_name string, entity_type string, description string, source_chunk_id string, pos long")
    canonical = graphmerge.canonical_entities(e)
    rows = graphmerge.entity_members(e, canonical).collect()
    want = {(i, r.canonical_id) for r in graphmerge.merge_entities_exact(e).collect() for i in r.merged_from}
    assert {tuple(r) for r in rows} == want and len(rows) == 12
    rel = spark.createDataFrame([("0", "1", "r1"), ("1", "2", "r2")], "source_entity string, target_entity string, relation_id string")
    sizes = graphmerge.component_sizes(graphmerge.graph_components(e, rel), rel).collect()
    assert sorted((s.entity_count, s.relation_count) for s in sizes)[-1] == (3, 2) and len(sizes) == 10
