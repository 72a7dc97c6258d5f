"""What larger tables need: no broadcast of what Python makes, no group by itself in Python, values worked out once."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomgraph import catalog, paths
from loomgraph.functions.text import RELATION_SYNONYMS, canonical_relation_type
from loomgraph.operators import audit, extraction, graphmerge, tableprep
from loomgraph.runtime import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rests_of_names_are_not_broadcast(spark):  # F1, F2
    names = spark.range(50).select(F.lit("t").alias("entity_type"), F.concat(F.lit("customer"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("norm_name"), F.col("id").alias("pos"))
    got = graphmerge.alike_pairs(names, 0.9)
    found = {(x.norm_name, x.earlier) for x in got.collect()}
    n = [x.norm_name for x in names.collect()]
    assert "BroadcastExchange" not in plan(got) and found == {(b, a) for i, a in enumerate(n) for b in n[i + 1 :] if graphmerge.similar(b, a, 0.9)}


def greedy_types(rows, threshold=0.9):
    out, known = {}, {}
    for s, t, kind, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        firsts = known.setdefault((s, t), [])
        found = next((k for k in firsts if graphmerge.similar(kind, k, threshold)), None)
        if found is None:
            firsts.append(kind)
        out[s, t, kind] = found or kind
    return out


def test_relation_types_by_pairs_in_order(spark):  # F4
    r = random.Random(5)
    kinds = ["delivered goods", "Delivered-Goods", "delivered good", "developed by", "made_by", "", "x" * 20, "x" * 19 + "y", "x" * 18 + "yy"]
    rows = [(f"s{r.randrange(4)}", f"t{r.randrange(30)}", r.choice(kinds), n) for n in range(2_000)]
    df = spark.createDataFrame(rows, "source_entity string, target_entity string, relation_type string, pos long")
    canon = {x.k: x.c for x in spark.createDataFrame([(k,) for k in kinds], "k string").select("k", canonical_relation_type(F.col("k")).alias("c")).collect()}
    want = greedy_types([(s, t, canon[k], n) for s, t, k, n in rows])
    got = graphmerge.fuzzy_relation_types(df)
    assert "FlatMapGroupsInPandas" not in plan(got) and got.columns == df.columns
    assert sorted((x.source_entity, x.target_entity, x.pos, x.relation_type) for x in got.collect()) == sorted((s, t, n, want[s, t, canon[k]]) for s, t, k, n in rows)


def test_canonical_relation_types(spark):  # F4
    kinds = [None, " ", "Supplied By", *RELATION_SYNONYMS, *[k.replace("_", "") for k in RELATION_SYNONYMS]]
    norm = ["".join(c for c in (k or "").strip().lower() if c not in "-_.:,;!? ") for k in kinds]
    got = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, k string").orderBy("i").select(canonical_relation_type(F.col("k")).alias("c"))
    assert [x.c for x in got.collect()] == [RELATION_SYNONYMS.get(n, n or "related_to") for n in norm]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_mapped_values_are_worked_out_once(spark):  # F7, F10, F11, F14-F17, F19-F23
    orders = tableprep.rows_to_triples(table(spark, SF, "orders"), [catalog.ORDER, catalog.CUSTOMER_REF], distinct=False)[0]
    text = orders._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace") == 2  # one for each node's URI
    assert "lambda" not in text


def test_rows_with_errors_make_no_triples(spark):
    rows = spark.createDataFrame([(1, "a", "5"), (2, "b", "five"), (None, None, None), (4, " ", None)], "k int, name string, size string")
    m = tableprep.Mapping("thing", "Thing", [("text", "urn:x#"), "k"], {"name": (["name"], "string"), "size": (["size"], "integer")})
    triples, errors = tableprep.rows_to_triples(rows, [m])
    assert sorted((x.s, x.p, x.o) for x in triples.collect()) == [("urn:x#1", "name", "a"), ("urn:x#1", "rdf:type", "Thing"), ("urn:x#1", "size", "5"), ("urn:x#4", "rdf:type", "Thing")]
    assert sorted((x.k or 0, x.error) for x in errors.collect()) == [(0, "the row has no data"), (2, "size: no integer: five")]


def test_predicates_not_read_are_not_made(spark):  # F15, F16, F20-F22
    cols = ["graph", "s", "p", "o", "o_kind", "o_type"]
    whole, some = catalog.star_triples(spark, SF), catalog.star_triples(spark, SF, ["balance", "inNation"])
    want = sorted(map(tuple, whole.where("p in ('balance', 'inNation', 'rdf:type')").select(cols).collect()))
    assert sorted(map(tuple, some.select(cols).collect())) == want and len(want) == len(set(want))
    # a row with an error makes none of its triples, also where the faulty predicate isn't asked for; tables share codes
    m = tableprep.Mapping("thing", "Thing", [("text", "urn:x#"), "k"], {"name": (["name"], "string"), "size": (["size"], "integer")})
    a, b = (spark.createDataFrame(r, "k int, name string, size string") for r in ([(1, "a", "5"), (2, "b", "five")], [(1, "a", "6"), (3, "c", None)]))
    got = tableprep.tables_to_triples([(a, [m]), (b, [m])], ["name"])
    assert sorted((x.s, x.p, x.o) for x in got.collect()) == [("urn:x#1", "name", "a"), ("urn:x#1", "rdf:type", "Thing"), ("urn:x#3", "name", "c"), ("urn:x#3", "rdf:type", "Thing")]
    # what a predicate's triples have in common isn't shuffled
    text = got._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(x for x in text.splitlines() if "Aggregate [" in x)
    assert aggregate.split("Aggregate [")[1].startswith("code") and "Aggregate [graph" not in text and "Generate inline(array(struct(code" in text


def test_similar_is_the_matchers_ratio(spark):  # F2
    r = random.Random(3)
    word = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    for _ in range(20_000):
        start, end, letters = word(r.randrange(0, 12), "abc"), word(r.randrange(0, 4), "ab"), r.choice(["ab", "0123456789"])
        a, b = (start + word(r.randrange(0, 9), letters) + end for _ in "ab")
        for t in (0.5, 0.8, 0.9):
            assert graphmerge.similar(a, b, t) == (SequenceMatcher(None, a, b).ratio() >= t), (a, b, t)


def test_links_of_names_are_read_once(spark):  # F2
    r = random.Random(4)
    pairs = sorted({(a, b) for a in range(1, 3000) for b in [r.randrange(a) for _ in range(r.randrange(6))]})
    firsts, earlier = set(), {}
    for a, b in pairs:
        earlier.setdefault(a, set()).add(b)
    for n in sorted({x for p in pairs for x in p}):
        if firsts.isdisjoint(earlier.get(n, ())):
            firsts.add(n)
    near = spark.createDataFrame([(a << 5, b << 5) for a, b in pairs], "no long, before long")
    jobs = spark.sparkContext.statusTracker()
    for most in (10_000_000, 2_000):
        spark.sparkContext.setJobGroup(f"firsts-{most}", "")
        got = [x.no >> 5 for x in graphmerge.first_names(near, most).collect()]
        assert sorted(got) == sorted(firsts) and len(jobs.getJobIdsForGroup(f"firsts-{most}")) < 40 * (1 + len(pairs) // most)


def test_a_predicates_triples_are_written_by_several_tasks(spark, tmp_path, monkeypatch):  # F5
    assert tableprep.LOAD_ROWS <= 250_000  # more were one task's work
    monkeypatch.setattr(tableprep, "LOAD_ROWS", 20)
    rows, path = table(spark, SF, "customer"), str(tmp_path / "loaded")
    for part in (rows.where("c_custkey % 3 = 0"), rows, rows):
        assert tableprep.load(part, [catalog.CUSTOMER, catalog.NATION_REF], path).isEmpty()
    got = tableprep.read_loaded(spark, path).select("graph", "s", "p", "o", "o_kind", "o_type")
    want = tableprep.rows_to_triples(rows, [catalog.CUSTOMER, catalog.NATION_REF])[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(tableprep.loaded_ids(spark, path)) == 2


def test_sections_are_grouped_once(spark):  # F18
    rows = [(d, s, i) for d in (1, 2) for s, i in ((1, "1"), (2, "1.1"), (3, "1.1"), (4, "2.1"), (5, "2"), (6, "1"), (7, "3.1"), (None, "4"), (8, "4.1"), (9, "4"), (10, "4.2"))]
    got = extraction.validate_sections(spark.createDataFrame(rows, "doc_id int, seq int, section_id string"))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(3, "1.1", "duplicate_id"), (4, "2.1", "missing_parent"), (6, "1", "duplicate_id"), (7, "3.1", "missing_parent"), (8, "4.1", "missing_parent"), (9, "4", "duplicate_id")]
    assert sorted((x.doc_id, x.seq, x.section_id, x.error) for x in got.collect()) == [(d, *x) for d in (1, 2) for x in want]


def _reached(edges, starts):
    after, out = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for s in starts:
        seen, front = set(), after.get(s, set())
        while front:
            seen |= front
            front = {b for a in front for b in after.get(a, ())} - seen
        out |= {(s, n) for n in seen}
    return out


CHAINS = [(100 * c + i, 100 * c + i + 1) for c in range(5) for i in range(11 * c)]
TREE = [(i, i // 2) for i in range(2, 60)]
MANY_STARTS = {
    "chains": CHAINS,
    "up a tree": TREE,
    "down a tree": [(b, a) for a, b in TREE],
    "circles with tails": CHAINS + [(440, 420), (900, 901), (901, 900), (950, 950)],
    "circles that chains leave": [(b, a) for a, b in CHAINS + [(440, 420), (950, 950)]],
    "diamonds": [(i, i + k) for i in range(40) for k in (1, 2)],
}


def test_reach_from_many_starts(spark):  # F8
    for name, edges in MANY_STARTS.items():
        df = spark.createDataFrame([*edges, *edges[:9], (None, 1), (1, None)], "a long, b long")
        starts = sorted({x for e in edges for x in e})[::3] + [-1]
        got = [tuple(r) for r in paths.reach(df, spark.createDataFrame([(s,) for s in [*starts, None, starts[0]]], "a long"), "a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == _reached(edges, starts), name


def test_rounds_from_many_starts_follow_the_depths_logarithm(spark, monkeypatch):  # F8
    written, stage = [], paths.stage
    monkeypatch.setattr(paths, "stage", lambda df, name, *more: written.append(name) or stage(df, name, *more))
    edges = spark.createDataFrame(CHAINS, "a long, b long")
    assert paths.reach(edges, edges.where("a % 4 = 0").select("a"), "a", "b").count() == len(_reached(CHAINS, [a for a, _ in CHAINS if a % 4 == 0]))
    # edges, jumps of 2 to 64 (44 edges: the last are none), pairs after jumps of 32 to 2; the last round's pairs aren't written
    assert len(written) == 1 + 6 + 5


TRIPLE = "graph string, s string, p string, o string, o_kind string, o_type string"


def _shapes_and_triples(seed):
    r = random.Random(seed)
    triples = {("g", f"s{i}", "rdf:type", r.choice("AB"), "uri", "class") for i in range(20)}
    triples |= {("g", f"s{r.randrange(20)}", r.choice("pq"), r.choice(["1", "2", "10", "s4", "s5", "s6", "s7"]), r.choice(["uri", "literal"]), "t") for _ in range(90)}
    kinds = [("minCount", 1), ("class", "A"), ("minInclusive", 2), ("disjoint", "q"), ("closed", ["p", "q"])]
    return [{"target": r.choice("AB"), "path": "p", "kind": k, "value": v} for k, v in kinds], sorted(triples)


def test_checks_are_dealt_by_their_number_and_read_what_they_check(spark, monkeypatch):  # F3, F4 (many_shapes, pruned_graph)
    shapes, triples = _shapes_and_triples(2)
    df = spark.createDataFrame([*triples, *[("g", f"s{i}", "unread", str(i), "literal", "t") for i in range(500)]], TRIPLE)
    whole = sorted(map(tuple, audit.shape_check(df, shapes[:4]).collect()))
    monkeypatch.setattr(audit, "TASK_ROWS", 10)
    got = audit.shape_check(df, shapes[:4])
    assert sorted(map(tuple, got.collect())) == whole and whole
    dealt = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    n = len([x for x in triples if x[2] == "rdf:type"]) + 4 * len([x for x in triples if x[2] == "p"]) + len([x for x in triples if x[2] == "q"])
    assert dealt and all(n // 20 <= int(x.rsplit(",", 1)[1]) <= n // 10 + 1 for x in dealt)
    # texts of shapes join what fails: no shuffle has them
    assert all("message" not in x for x in dealt) and "unread" not in plan(got)


def _pruned(spark, triples, shapes):
    """The rule, round by round over all triples."""
    while True:
        gone = {x.focus for x in audit.shape_check(spark.createDataFrame(triples, TRIPLE), shapes).collect()}
        if not gone:
            return triples
        triples = [x for x in triples if x[1] not in gone and x[3] not in gone]


def test_only_what_pointed_to_deleted_nodes_is_checked_again(spark, monkeypatch):  # F4 (pruned_graph)
    shapes, triples = _shapes_and_triples(2)
    want = sorted(_pruned(spark, triples, shapes))
    for tasks in (1_000_000, 10):
        monkeypatch.setattr(audit, "TASK_ROWS", tasks)
        assert sorted(map(tuple, audit.prune_by_shapes(spark.createDataFrame(triples, TRIPLE), shapes).collect())) == want
    # a class that is deleted itself takes its instances' types along, and what needs these fails then
    kinds = [("a", "rdf:type", "A"), ("b", "rdf:type", "B"), ("c", "rdf:type", "C"), ("A", "rdf:type", "Meta"), ("A", "n", "0"), ("b", "to", "a"), ("c", "to", "b"), ("c", "n", "1")]
    triples = [("g", s, p, o, "uri", "") for s, p, o in kinds]
    shapes = [{"target": "Meta", "path": "n", "kind": "minInclusive", "value": 1}, {"target": "B", "path": "to", "kind": "class", "value": "A"}, {"target": "C", "path": "to", "kind": "minCount", "value": 1}]
    assert sorted(map(tuple, audit.prune_by_shapes(spark.createDataFrame(triples, TRIPLE), shapes).collect())) == sorted(_pruned(spark, triples, shapes)) == []
    written, stage = {}, audit.stage
    monkeypatch.setattr(audit, "stage", lambda df, name, *more: written.setdefault(name, []).append(out := stage(df, name, *more)) or out)
    many = [("g", f"n{i}", p, o, "uri", "") for i in range(200) for p, o in (("rdf:type", "A"), ("n", str(i - 1)), ("to", f"n{i - 1 if i < 4 else i}"))]
    got = audit.prune_by_shapes(spark.createDataFrame(many, TRIPLE), [{"target": "A", "path": "n", "kind": "minInclusive", "value": 0}, {"target": "A", "path": "to", "kind": "minCount", "value": 1}])
    assert got.count() == 3 * 196 and all(x.count() <= 3 for x in written["triples"])


def _greedy_names(rows):
    firsts, out = {}, {}
    for kind, name, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        known = firsts.setdefault(kind, [])
        out[kind, name] = next((k for k in known if graphmerge.similar(name, k, 0.9)), None) or known.append(name) or name
    return out


def test_names_meet_firsts_only_where_most_are_alike(spark, monkeypatch):  # F2 (customer_names_alike)
    listed, pairs = [], graphmerge.alike_pairs
    monkeypatch.setattr(graphmerge, "alike_pairs", lambda *a: listed.append(1) or pairs(*a))
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(12))
    templated = [("c", f"customer#{i:09d}", i) for i in range(100)]
    # the second turn has more names left than a turn takes; long names share segments
    late = templated + [("d", word(), i) for i in range(70)] + [("e", f"{'part of a long name ' * 3}{i:03d}", -i) for i in range(25)]
    unrelated = [("a", word(), i) for i in range(60)] + templated[:20]
    for rows, links in ((templated, 0), (late, 0), (unrelated, 1)):
        listed.clear()
        got = graphmerge.fuzzy_groups(spark.createDataFrame(rows, "entity_type string, norm_name string, pos long"), 0.9, turn=30).collect()
        assert {(x.entity_type, x.norm_name): x.group_name for x in got} == _greedy_names(rows) and len(got) == len(rows) and len(listed) == links


def test_triples_are_dealt_before_they_are_made_distinct(spark, monkeypatch):  # F3, F4 (the star's triples)
    tables = [(table(spark, SF, "orders"), [catalog.ORDER, catalog.CUSTOMER_REF]), (table(spark, SF, "customer"), [catalog.CUSTOMER, catalog.NATION_REF])]
    want = sorted(map(tuple, tableprep.tables_to_triples(tables).collect()))
    monkeypatch.setattr(tableprep, "DISTINCT_ROWS", 500)
    got = tableprep.tables_to_triples(tables)
    assert sorted(map(tuple, got.collect())) == want and len(want) == len(set(want))
    n = 5 * tables[0][0].count() + 6 * tables[1][0].count()
    assert "RepartitionByExpression [code" in (text := got._jdf.queryExecution().optimizedPlan().toString()) and f"], {-(-n // 500)}\n" in text
