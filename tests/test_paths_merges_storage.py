"""Closures and paths, fuzzy names, shapes, merging streams and stored tables: sizes, odd inputs and brute force."""

import random
import re
import uuid
from graphlib import CycleError, TopologicalSorter

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog_more, paths
from loomgraph.operators import audit, content, graphmerge, tableprep, timeseries
from loomgraph.plans.pattern import Graph, Link, Node, closure
from loomgraph.runtime import new_path, table
from loomgraph.sources import io

SF = "/root/testdata/sf0.001"


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for s in after:
        todo, seen = list(after[s]), set()
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += after.get(v, ())
        out |= {(s, v) for v in seen}
    return out


def some_graph(seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range([30, 60, 120][seed])] + [(100 + i, 101 + i) for i in range(50)] + [(151, 3)] * 2
    return edges + [(200 + 2 * i + x, 202 + 2 * i + y) for i in range(12) for x in (0, 1) for y in (0, 1)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_transitive_and_reach_by_brute_force(spark, seed):
    edges = some_graph(seed)
    df, want = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long"), reached(edges)
    assert {tuple(r) for r in paths.transitive(df, "a", "b").collect()} == want
    starts = [*random.Random(seed).sample(sorted({a for a, _ in edges}), 9), 100, 9999]
    for shallow in (1, 8):
        got = [tuple(r) for r in paths.reach(df, spark.createDataFrame([(s,) for s in starts], "a long"), "a", "b", shallow=shallow).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if p[0] in starts}


def test_closure_of_a_long_chain(spark):
    n = 600
    edges = spark.range(n).select(F.concat(F.lit("c"), "id").alias("sub"), F.concat(F.lit("c"), F.col("id") + 1).alias("super"))
    up = closure(edges)
    assert up.count() == n * (n + 1) // 2 + n + 1
    assert up.where("sub = super").count() == n + 1
    assert closure(spark.createDataFrame([], "sub string, super string")).count() == 0


def test_a_path_from_one_start_touches_what_it_reaches(spark):
    n = 100_000
    node = lambda c: F.concat(F.lit("n"), c)
    chain = spark.range(n).select(F.lit("g").alias("graph"), node(F.col("id")).alias("s"), F.lit("next").alias("p"), node(F.col("id") + 1).alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_type"))
    kind = spark.createDataFrame([("g", f"n{n - 40}", "rdf:type", "Start", "uri", ""), ("g", "n3", "rdf:type", "End", "uri", "")], chain.schema)
    g = Graph(chain.unionByName(kind))
    assert g.match(Node("a", "Start", links=[Link("next", Node("b"), qualifier="+")])).count() == 39  # the last isn't a subject
    assert g.match(Node("a", "Start", links=[Link("next", Node("b"), qualifier="*")])).count() == 40
    assert g.match(Node("a", links=[Link("next", Node("b", "End"), qualifier="+")])).count() == 3  # bound at the far end
    assert paths.reach(chain, spark.createDataFrame([("n0",)], "s string"), "s", "o").count() == n


def closes(edges):
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    try:
        tuple(TopologicalSorter(before).static_order())
    except CycleError:
        return True
    return False


def test_circles_in_layers_and_at_random(spark):
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    ladder = [(2 * i + x, 2 * i + 2 + y) for i in range(1000) for x in (0, 1) for y in (0, 1)]
    assert not graphmerge.has_cycle(df(ladder))
    assert graphmerge.has_cycle(df([*ladder, (1998, 4)]))
    for seed in range(6):
        r = random.Random(seed)
        edges = [e for e in ((r.randrange(50), r.randrange(50)) for _ in range([40, 300, 500][seed % 3])) if e[0] < e[1]]
        edges += [(r.randrange(30, 50), r.randrange(20))] if seed > 2 else []
        assert graphmerge.has_cycle(df(edges), spread=1) == closes(edges)
    assert not graphmerge.has_cycle(df([])) and graphmerge.has_cycle(df([(1, 1)])) and not graphmerge.has_cycle(df([(1, None), (None, 2)]))


def greedy(rows, threshold):
    firsts, out = {}, {}
    for kind, name, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        found = next((k for k in firsts.setdefault(kind, []) if graphmerge.similar(name, k, threshold)), None)
        if found is None:
            firsts[kind].append(name)
        out[kind, name] = found or name
    return out


@pytest.mark.parametrize("threshold, most", [(0.9, 300_000), (0.9, 60), (0.8, 200)])
def test_templated_names_follow_the_greedy_rule(spark, threshold, most):
    r = random.Random(1)
    rows = [("c", f"customer#{i:09d}", i) for i in range(120)] + [("p", f"part{i}" * 5, 500 - i) for i in range(60)]
    rows += [("q", "".join(r.choice("ab") for _ in range(r.randrange(1, 14))) + str(i), i % 7) for i in range(60)]
    got = graphmerge.fuzzy_groups(spark.createDataFrame(rows, "entity_type string, norm_name string, pos long"), threshold, most).collect()
    assert {(x.entity_type, x.norm_name): x.group_name for x in got} == greedy(rows, threshold) and len(got) == len(rows)


def test_customers_names_as_they_are(spark):
    c = table(spark, SF, "customer").collect()
    rows = {}
    for r in c:
        name = re.sub(r"[\s\-_.:,;!?]", "", r.c_name.strip().lower())
        rows[name] = min(r.c_custkey, rows.get(name, r.c_custkey))
    want = greedy([("customer", n, k) for n, k in rows.items()], 0.9)
    assert {(x.entity_type, x.norm_name): x.group_name for x in catalog_more.customer_names_alike(spark, SF).collect()} == want


# A9


def shape_faults(triples, shapes):
    """The checks one shape, one instance and one value at a time."""
    out = []
    values = lambda s, p: {(o, k, t) for _, s2, p2, o, k, t in triples if (s2, p2) == (s, p)}
    of_class = lambda c: {s for _, s, p, o, *_ in triples if p == "rdf:type" and o == c}

    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    for sh in shapes:
        kind, want, path = sh["kind"], sh.get("value"), sh.get("path", "")
        for s in of_class(sh["target"]):
            got = values(s, path)
            plain, theirs, each = {o for o, *_ in got}, {o for o, *_ in values(s, str(want))}, [o for o, *_ in got]  # one text may be a uri and a literal
            n = {o: number(o) for o in plain}
            bad = {
                "minCount": lambda: [str(len(plain))] if len(plain) < want else [],  # noqa: B023
                "maxCount": lambda: [str(len(plain))] if len(plain) > want else [],  # noqa: B023
                "class": lambda: [o for o in each if o not in of_class(want)],  # noqa: B023
                "datatype": lambda: [o for o, _, t in got if t != want],  # noqa: B023
                "nodeKind": lambda: [o for o, k, _ in got if k != want],  # noqa: B023
                "minInclusive": lambda: [o for o in each if n[o] is None or n[o] < want],  # noqa: B023
                "maxExclusive": lambda: [o for o in each if n[o] is None or n[o] >= want],  # noqa: B023
                "minLength": lambda: [o for o in each if len(o) < want],  # noqa: B023
                "pattern": lambda: [o for o in each if not re.search(want, o)],  # noqa: B023
                "in": lambda: [o for o in each if o not in want],  # noqa: B023
                "equals": lambda: plain ^ theirs,  # noqa: B023
                "disjoint": lambda: plain & theirs,  # noqa: B023
                "lessThan": lambda: [o for o in plain if any(n[o] is None or number(v) is None or n[o] >= number(v) for v in theirs)],  # noqa: B023
                "closed": lambda: {p for _, s2, p, *_ in triples if s2 == s and p != "rdf:type" and p not in want},  # noqa: B023
            }[kind]()
            out += [(s, path, v, kind, sh.get("severity", "Violation")) for v in bad]
    return sorted(out)


def test_shapes_are_data(spark):
    r = random.Random(8)
    triples = {("g", f"s{i}", "rdf:type", r.choice("AB"), "uri", "class") for i in range(20)} | {("g", "s3", "rdf:type", "A", "uri", "class"), ("g", "s3", "rdf:type", "B", "uri", "class")}
    triples |= {("g", f"s{r.randrange(22)}", r.choice("pq"), r.choice(["1", "2", "10", "x", "s4", "s5", ""]), r.choice(["uri", "literal"]), "t") for _ in range(120)}
    kinds = {"minCount": 2, "maxCount": 2, "class": "A", "datatype": "t", "nodeKind": "uri", "minInclusive": 2, "maxExclusive": 10, "minLength": 1, "pattern": "^1", "in": ["1", "x"], "equals": "q", "disjoint": "q", "lessThan": "q", "closed": ["p"]}
    shapes = [{"target": t, "path": "p", "kind": k, "value": v, "severity": s} for k, v in kinds.items() for t, s in (("A", "Violation"), ("B", "Warning"), ("C", "Info"))]
    df = spark.createDataFrame(sorted(triples), "graph string, s string, p string, o string, o_kind string, o_type string")
    got = audit.shape_check(df, audit.shapes_table(spark, shapes))
    assert sorted((x.focus, x.path, x.value, x["shape"], x.severity) for x in got.collect()) == shape_faults(triples, shapes)
    assert {x.severity for x in audit.shape_check(df, shapes, ["Warning"]).collect()} == {"Warning"}
    assert audit.shape_check(df, []).collect() == []
    size = lambda n: len(audit.shape_check(df, [dict(x, value=x["value"]) for x in shapes] * n)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(1) == size(12)  # 504 shapes, the same plan


# C9


def merged(rows, limit=2048):
    """One document's blocks, in order, by the rules one at a time: (kind, ids)."""
    out, last, now, size = [], None, None, 0
    for r in rows:
        head, chars = r["type"] in ("title", "subtitle"), len(r["text"].strip())
        textual = r["type"] in ("text", "title", "subtitle", "list")
        if r["type"] in ("table", "image", "equation"):
            kind, keep = "atomic", None
        elif not head and textual and content.BOUNDARY.search(r["text"].strip()):
            kind, keep = "industrial_segment", None
        elif head:
            kind = keep = "section"
        elif not textual:
            kind, keep = "standalone", None
        elif now and r["pipeline"] == last["pipeline"] and r["seq"] == last["seq"] + 1 and r["page_idx"] == last["page_idx"] and (size + (2 if size and chars else 0) + chars) // 2 <= limit:
            size += (2 if size and chars else 0) + chars
            if out[-1][0] != "section":
                out[-1][0] = "list_block" if r["type"] == "list" else "paragraph_run"
            out[-1][1].append(r["block_id"])
            last = r
            continue
        else:
            kind = keep = "paragraph_run"
        out.append([kind, [r["block_id"]]])
        now, size, last = keep, chars, r
    return [(k, ids) for k, ids in out]


def test_semantic_merge_carries_its_state_from_batch_to_batch(spark):
    r = random.Random(3)
    rows = []
    for d, n in (("long", 3000), ("short", 5), ("other", 400)):
        for i in range(n):
            kind = r.choice(["text"] * 8 + ["title", "list", "table"])
            rows.append({"doc_id": d, "seq": i + 1, "block_id": f"{d}{i:05d}", "type": kind, "text": r.choice(["word " * r.randrange(300), "必须 x", "", "plain"]), "page_idx": i // 200, "table_body": "|a|" if kind == "table" else None, "img_path": None, "latex": None})
    df = content.route_blocks(spark.createDataFrame(rows, "doc_id string, seq long, block_id string, type string, text string, page_idx int, table_body string, img_path string, latex string"))
    lanes = {x.block_id: x.pipeline for x in df.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = content.merge_semantic_blocks(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = list(dict.fromkeys(content.ROUTES))
    for d in ("long", "short", "other"):
        mine = sorted((dict(x, pipeline=lanes[x["block_id"]]) for x in rows if x["doc_id"] == d and x["block_id"] in lanes), key=lambda x: (order.index(x["pipeline"]) if x["pipeline"] in order else len(order), x["seq"]))
        assert [(x.semantic_type, x.source_block_ids) for x in sorted((x for x in got if x.doc_id == d), key=lambda x: x.group_no)] == merged(mine)


# Stored tables


def test_days_prune_folders(spark):
    path = new_path(spark, "days")
    e = table(spark, SF, "events")
    timeseries.write_by_day(e.unionByName(e.limit(3).withColumn("ts", F.lit(None).cast("timestamp"))), "ts", path)
    day = e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    got = timeseries.read_days(spark, path, "ts", (">=", f"{day} 00:00:00"), ("<=", f"{day} 12:00:00"))
    assert got.count() == e.where(f"ts <= timestamp'{day} 12:00:00'").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan) and re.search(r"PushedFilters: \[[^\]]*ts", plan)


def test_jdbc_in_ranges(spark):
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id", "id * 2 AS twice").write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "numbers").save()
    read = lambda q, **k: io.read_table_jdbc(spark, url, q, driver=driver, **k)
    got = read('SELECT "id", "twice" FROM numbers', column="id", parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("twice")).first()[0] == 9900
    assert read('SELECT "id" FROM numbers', column="id", parts=3, bounds=(10, 20)).count() == 100  # bounds part, they don't filter
    assert read('SELECT "id" FROM numbers WHERE "id" < 0', column="id", parts=3).count() == 0
    assert read('SELECT "twice" FROM numbers').where("twice < 10").count() == 5
    for bad in ("SELECT * FROM numbers", "DELETE FROM numbers", "SELECT 1; DROP TABLE numbers"):
        with pytest.raises(ValueError):
            read(bad)


def test_loading_twice_and_after_a_failure(spark):
    path = new_path(spark, "load-test")
    m = [tableprep.Mapping("x", "Thing", [("text", "urn:x/"), "id"], {"name": (["name"], "string"), "size": (["size"], "int")})]
    rows = spark.createDataFrame([("1", "a", "3"), ("2", "b", None), ("1", "a", "3")], "id string, name string, size string")
    told = lambda: sorted(map(str, tableprep.read_loaded(spark, path).collect()))
    assert told() == []
    tableprep.load(rows, m, path)
    once = told()
    assert len(once) == 5  # two types, two names, one size
    tableprep.load(rows, m, path)
    tableprep.load(rows.unionByName(rows), m, path)
    assert told() == once
    spark.read.parquet(f"{path}/load={tableprep.loaded_ids(spark, path)[0]}").write.parquet(f"{path}/load=broken")  # no mark: a load that failed
    assert told() == once
    errors = tableprep.load(spark.createDataFrame([("3", "c", "many")], rows.schema), m, path)
    assert errors.count() == 1 and told() == once
    tableprep.load(spark.createDataFrame([("2", "b", None), ("4", "d", None)], rows.schema), m, path)
    assert len(told()) == 7


def test_blocks_keep_every_key(spark, tmp_path):
    import json

    blocks = [
        {"type": "text", "text": " "}, {"text": "hi", "page_idx": 2, "score": 1.5, "nested": {"a": [1, {"b": None}]}, "metadata": {"k": "v", "n": 3, "score": "own"}},
        {"type": "code", "content": "x = 1"}, {"type": "image", "img_path": "p.png", "img_caption": ["c1", "c2"], "image_footnote": [], "img_footnote": "alone"}, {"type": "image", "note": "no path"},
        "no object", {"type": "table", "table_body": "|a|", "table_caption": ["t"], "metadata": "plain", "bbox": [1, 2, 3, 4.5], "none": None},
    ]
    lines = [json.dumps({"doc_id": "d", "content_list": blocks}), json.dumps({"doc_id": "e", "content_list": []}), "no json", json.dumps({"doc_id": "f"})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = {r.seq: r for r in io.read_blocks(spark, str(tmp_path)).collect()}
    assert sorted(got) == [2, 3, 4, 7] and all(r.doc_id == "d" for r in got.values())
    assert (got[2].type, got[2].page_idx, json.loads(got[2].metadata.pop("nested"))) == ("text", 2, {"a": [1, {"b": None}]})
    assert got[2].metadata == {"score": "1.5", "k": "v", "n": "3"}
    assert got[3].content == "x = 1" and content.normalize_blocks(io.read_blocks(spark, str(tmp_path))).where("seq = 3").first().text == "x = 1"
    assert got[4].captions == ["c1", "c2"] and got[4].footnotes == ["alone"] and got[4].metadata == {}
    assert got[7].captions == ["t"] and got[7].bbox == [1, 2, 3, 4.5] and got[7].metadata == {"metadata": "plain", "none": "null"}


# A13


def peeled(rows):
    """Rows that are never a leaf, one round at a time."""
    left = dict(rows)
    while True:
        leaves = [r for r, (t, d) in left.items() if not any(d in (t2, d2) for r2, (t2, d2) in left.items() if r2 != r)]
        leaves = [r for r in leaves if left[r][0] != left[r][1]]
        if not leaves:
            return set(left)
        for r in leaves:
            del left[r]


@pytest.mark.parametrize("seed", range(4))
def test_combining_at_once_is_combining_level_by_level(spark, seed):
    r = random.Random(seed)
    parents = {f"n{i}": f"n{r.randrange(i)}" for i in range(1, 30) if i % 7}
    rows = {f"r{i}": (t, d) for i, (d, t) in enumerate(parents.items())}
    if seed % 2:
        rows |= {"x1": ("n1", "loop1"), "x2": ("loop1", "loop2"), "x3": ("loop2", "loop3"), "x4": ("loop3", "loop2"), "y1": ("n2", "n9"), "y2": ("tail", "n0")}
        rows |= {"z1": ("selfish", "selfish")}
    names = [f"n{i}" for i in range(30)] + ["loop1", "loop2", "tail", "else"]
    triples = {("g", n, "rdf:type", r.choice("AB"), "uri", "class") for n in names} | {("g", r.choice(names), r.choice("pqr"), r.choice(names + ["1", "2"]), "uri", "t") for _ in range(90)}
    df = spark.createDataFrame(sorted(triples), "graph string, s string, p string, o string, o_kind string, o_type string")
    same = spark.createDataFrame([(k, t, d) for k, (t, d) in sorted(rows.items())], "row string, target string, duplicate string")
    rules = spark.createDataFrame([("A", "p", "maxCardinality", 3), ("B", "p", "cardinality", 2), ("A", "q", "minCardinality", 1)], "class string, property string, restriction string, limit int")
    lists = [((), ()), ((), ("r",)), (("q",), ()), (("q",), ("r",))][seed]
    got, left = audit.combine_entities(df, same, rules, *lists)
    stuck = peeled(rows)
    assert {x.row for x in left.collect()} == stuck
    good = spark.createDataFrame([(k, t, d) for k, (t, d) in sorted(rows.items()) if k not in stuck], same.schema)
    want = audit._combine_by_level(df, good, rules, *lists)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_combining_a_long_chain(spark):
    n = 1000
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    same = spark.range(n).select(F.col("id").alias("row"), node(F.col("id")).alias("target"), node(F.col("id") + 1).alias("duplicate"))
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("rdf:type", F.lit("A")), ("name", node(F.col("id") % 10)), ("one", F.lit("same")), ("knows", node(F.col("id") + 1)))])
    triples = spark.range(n + 1).select(F.lit("g").alias("graph"), node(F.col("id")).alias("s"), F.inline(made), F.lit("uri").alias("o_kind"), F.lit("").alias("o_type"))
    rules = spark.createDataFrame([("A", "one", "maxCardinality", 1)], "class string, property string, restriction string, limit int")
    got, left = audit.combine_entities(triples, same, rules)
    assert left.isEmpty()
    assert {(r.s, r.p, r.o) for r in got.collect()} == {("n0", "rdf:type", "A"), ("n0", "one", "same"), ("n0", "knows", "n0"), ("n0", "knows", "n1001")} | {("n0", "name", "n0")} | {("n0", "name", "n0" if i <= n else f"n{i}") for i in range(10)}


def test_component_ids_run_over_any_size(spark):
    rows = [("a", f"e{i}") for i in range(500)] + [("b", "é"), ("b", "b"), ("c", "c"), ("c", "c"), (None, "x")]
    members = spark.createDataFrame(rows, "least string, entity_id string")
    none = spark.createDataFrame([], "source_entity string, relation_id string")
    want = {(r.component_id, r.entity_count) for r in graphmerge.component_summary(members.where("least is not null"), none).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = graphmerge.component_ids(members).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.component_id, r.entity_count) for r in got} == want and len(got) == 3
