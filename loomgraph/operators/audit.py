"""Graph statistics, audits and entity resolution over triples."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.paths import on_circles, reach, roots_of
from loomgraph.plans.pattern import TYPE, closure
from loomgraph.runtime import stage


def types(triples: DataFrame, key: str = "s", out: str = "cls") -> DataFrame:
    return triples.where(F.col("p") == TYPE).select(F.col("s").alias(key), F.col("o").alias(out)).distinct()


def predicate_stats(triples: DataFrame) -> DataFrame:
    """Triples per subject class, predicate and object class (null without one); multi-typed nodes multiply (A1)."""
    kept = triples.where(~F.col("p").contains("rdf-schema"))
    joined = kept.join(types(triples), "s").where(~F.col("cls").contains("w3.org")).join(types(triples, "o", "o_cls"), "o", "left")
    return joined.groupBy("cls", "p", "o_cls").agg(F.count("*").alias("n"))


def class_instance_counts(triples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Instances per class, subclasses' included if the class edges are given (A2)."""
    t = types(triples)
    if classes is not None:
        up = closure(classes)
        t = t.join(up, t.cls == up["sub"], "left").select("s", F.coalesce("super", "cls").alias("cls")).distinct()
    return t.groupBy("cls").agg(F.count("*").alias("n"))


def path_instance_count(triples: DataFrame, start: str, steps: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows of a path of typed triples; steps are (predicate, class, forward) (A3)."""
    at = types(triples).where(F.col("cls") == start).select(F.col("s").alias("_0"))
    for i, (p, cls, forward) in enumerate(steps, 1):
        near, far = ("s", "o") if forward else ("o", "s")
        hop = triples.where(F.col("p") == p).select(F.col(near).alias(f"_{i - 1}"), F.col(far).alias(f"_{i}"))
        goal = types(triples, f"_{i}").where(F.col("cls") == cls).select(f"_{i}")
        at = at.join(hop, f"_{i - 1}").join(goal, f"_{i}").select(f"_{i}")
    return at.agg(F.count("*").alias("n"))


def cardinality_rules(model: DataFrame) -> DataFrame:
    """(class, property, restriction, limit) from restriction triples, direct or through unionOf lists of any length (A4).

    A list is walked by jumps that double; a list that turns back on itself ends where nothing is new.
    """
    one = lambda p, out: model.where(F.col("p") == p).select(F.col("s").alias("r"), F.col("o").alias(out))
    limits = reduce(DataFrame.union, [one(f"owl:{k}", "limit").withColumn("restriction", F.lit(k)) for k in ("maxCardinality", "minCardinality", "cardinality")])
    rules = limits.join(one("owl:onProperty", "property"), "r")
    direct = model.where(F.col("p") == "rdfs:subClassOf").select(F.col("s").alias("class"), F.col("o").alias("r"))
    first, rest = (model.where(F.col("p") == f"rdf:{p}").select(F.col("s").alias("cell"), F.col("o").alias(p)) for p in ("first", "rest"))
    at = stage(model.where(F.col("p") == "owl:unionOf").select(F.col("s").alias("u"), F.col("o").alias("cell")).distinct(), "lists")
    jump, n = stage(rest.distinct(), "jumps"), at.count()
    while n:
        at = stage(at.union(at.join(jump, "cell").select("u", "rest")).distinct(), "lists")
        jump = stage(jump.join(jump.select(F.col("cell").alias("rest"), F.col("rest").alias("far")), "rest").select("cell", F.col("far").alias("rest")).distinct(), "jumps")
        before, n = n, at.count()
        if n == before:
            break
    members = at.join(first, "cell").select("u", F.col("first").alias("class"))
    direct = direct.union(direct.join(members, direct["class"] == members["u"]).select(members["class"], "r"))
    return direct.join(rules, "r").select("class", "property", "restriction", F.col("limit").cast("int").alias("limit")).distinct()


def breaks(restriction: Column, n: Column, limit: Column) -> Column:
    return F.when(restriction == "maxCardinality", n > limit).when(restriction == "minCardinality", n < limit).otherwise(n != limit)


def cardinality_violations(triples: DataFrame, rules: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class, property, restriction, limit, subject, property_count), subjects without the property too (A5)."""
    t = types(triples)
    if classes is not None:
        up = closure(classes)
        t = t.join(up, t.cls == up["sub"], "left").select("s", F.coalesce("super", "cls").alias("cls")).distinct()
    due = t.join(rules, t.cls == rules["class"]).select(rules["*"], F.col("s").alias("subject"))
    ruled = triples.join(rules.select(F.col("property").alias("p")).distinct(), "p", "left_semi")  # prunes the partitions of a table by predicate
    counts = ruled.groupBy(F.col("s").alias("subject"), F.col("p").alias("property")).agg(F.count_distinct("o").cast("int").alias("n"))
    got = due.join(counts, ["subject", "property"], "left").withColumn("property_count", F.coalesce("n", F.lit(0)))
    return got.where(breaks(F.col("restriction"), F.col("property_count"), F.col("limit"))).select("class", "property", "restriction", "limit", "subject", "property_count")


def violations_concise(violations: DataFrame, instance_counts: DataFrame) -> DataFrame:
    """Per class, property and count: the class's instances and the sorted subjects."""
    keys = ["class", "property", "restriction", "limit", "property_count"]
    got = violations.groupBy(*keys).agg(F.array_sort(F.collect_set("subject")).alias("subject_list"))
    return got.join(instance_counts.withColumnsRenamed({"cls": "class", "n": "instance_count"}), "class", "left")


def satisfies_cardinality(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``facts``: (id, class, property, n); (id, ok) if no rule of any of its classes is broken."""
    got = facts.join(rules, ["class", "property"], "left")
    ok = F.coalesce(~breaks(F.col("restriction"), F.col("n"), F.col("limit")), F.lit(True))
    return got.groupBy("id").agg(F.bool_and(ok).alias("ok"))


def label_dictionary(triples: DataFrame, max_words: int = 4, specificity: int = 3) -> DataFrame:
    """(label, s, cls, shared) of short string values that at most ``specificity`` subjects share."""
    short = triples.where((F.col("o_kind") == "literal") & (F.size(F.split(F.trim("o"), r"\s+")) <= max_words))
    labels = short.select(F.trim("o").alias("label"), "s").distinct()
    rare = labels.groupBy("label").agg(F.count("*").alias("shared")).where(F.col("shared") <= specificity)
    return labels.join(rare, "label").join(types(triples), "s", "left").select("label", "s", "cls", "shared")


SHAPE_SCHEMA = "id int, target string, path string, kind string, value string, items array<string>, severity string, message string"
SHAPE_COLUMNS = [c.split()[0] for c in SHAPE_SCHEMA.split(", ")]
VALUE_KINDS = ("datatype", "nodeKind", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "in")


def shapes_table(spark, shapes: list[dict]) -> DataFrame:
    """Shapes as rows: a list of {target, path, kind, value, severity} for ``shape_check``; lists (in, closed) go to ``items``."""
    rows = []
    for i, s in enumerate(shapes):
        path, want = s.get("path", ""), s.get("value")
        many = [str(x) for x in want] if isinstance(want, (list, tuple)) else None
        one = None if want is None or many is not None else str(want)
        rows.append((i, s["target"], path, s["kind"], one, many, s.get("severity", "Violation"), f"{s['target']} {path}: {s['kind']} {want}"))
    return spark.createDataFrame(rows, SHAPE_SCHEMA)


#: Values that a task of a check meets, about.
TASK_ROWS = 500_000


def _tasks(spark, rows: int) -> list[int]:
    """The number of tasks for so many rows, as ``repartition`` takes it; none if a task a core will do, to which Spark joins partitions itself.

    Partitions that compress well it joins until a task holds many millions of rows, hence a number for more.
    """
    n = -(-rows // TASK_ROWS)
    return [n] if n > spark.sparkContext.defaultParallelism else []


def _without(df: DataFrame, keys: DataFrame, on: list[str], parts: list[int]) -> DataFrame:
    """``df`` without the rows that have one of ``keys``, by a left join: Spark would take an anti join ahead of the dealing."""
    met = keys.select(*on, F.lit(True).alias("_met")).repartition(*parts, *on)
    return df.repartition(*parts, *on).join(met, on, "left").where("_met is null").select(df.columns)


def _sizes(triples: DataFrame) -> dict[str, int]:
    """Triples by predicate."""
    return {r[0]: r[1] for r in triples.where("p is not null").groupBy("p").agg(F.count("*")).collect()}


def _given(triples: DataFrame, shapes: list[dict] | DataFrame, severity: list[str] | None = None) -> list[dict]:
    """Shapes, numbered anew: they are parameters, which every task gets."""
    given = shapes if isinstance(shapes, DataFrame) else shapes_table(triples.sparkSession, shapes)
    if severity:
        given = given.where(F.col("severity").isin(*severity))
    return [r.asDict() | {"id": i} for i, r in enumerate(given.collect())]


def _odd(shape: dict, predicates) -> set[str]:
    """Predicates that a closed shape doesn't allow."""
    return set() if shape["items"] is None or None in shape["items"] else {p for p in predicates if p != TYPE and p not in shape["items"]}


def _met(given: list[dict], sizes: dict[str, int]) -> int:
    """Values that checks meet, those of the class with most checks on a predicate."""
    checks = Counter((s["target"], p) for s in given if s["kind"] != "closed" for p in {s["path"], s["value"]} if p in sizes)
    most: dict[str, int] = {}
    for (_, p), n in checks.items():
        most[p] = max(most.get(p, 0), n)
    closed = set().union(*[_odd(s, sizes) for s in given if s["kind"] == "closed"])
    return sum(sizes[p] * n for p, n in most.items()) + sum(sizes[p] for p in closed) + sizes.get(TYPE, 0)


def shape_tasks(triples: DataFrame, shapes: list[dict] | DataFrame) -> list[int]:
    """Tasks that ``shape_check`` deals its rows to, enough for what it finds too."""
    return _tasks(triples.sparkSession, _met(_given(triples, shapes), _sizes(triples)))


def shape_check(triples: DataFrame, shapes: list[dict] | DataFrame, severity: list[str] | None = None, typed: DataFrame | None = None) -> DataFrame:
    """(focus, path, value, shape, severity, message) of every flat constraint that fails.

    ``shapes``: rows of ``SHAPE_SCHEMA`` or a list for ``shapes_table``; kinds: minCount, maxCount, class, datatype,
    nodeKind, minInclusive, maxInclusive, minExclusive, maxExclusive, minLength, maxLength, pattern, equals, disjoint, lessThan,
    in, closed.  Checks are data: instances join them by class and values by predicate, so the plan has a part for each
    sort of check, six at most, for any number of shapes.  A value that isn't a number fails number checks.

    A part reads the predicates that it checks, as narrow rows dealt to as many tasks as their number asks for; shapes' texts join only what
    fails.  ``typed``: the triples that have the classes of values, if not ``triples``.
    """
    spark = triples.sparkSession
    given, sizes = _given(triples, shapes, severity), _sizes(triples)
    parts = _tasks(spark, _met(given, sizes))
    used = {s["kind"] for s in given}
    of = lambda *kinds: [s for s in given if s["kind"] in kinds]
    rows = lambda some: F.broadcast(spark.createDataFrame([tuple(s[c] for c in SHAPE_COLUMNS) for s in some], SHAPE_SCHEMA))
    sides = lambda some: F.broadcast(spark.createDataFrame([(s["id"], s["target"], s[c], side) for s in some for c, side in (("path", 1), ("value", 0))], "id int, target string, path string, side int"))
    texts = lambda some: rows(some).select("id", F.col("path").alias("_path"), "kind", F.col("value").alias("_value"), "severity", "message")
    out = lambda df, some, value: df.join(texts(some), "id").select("focus", F.col("_path").alias("path"), value.cast("string").alias("value"), F.col("kind").alias("shape"), "severity", "message")
    facts = lambda paths, *more: triples.where(F.col("p").isin(*paths)).select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", *more)
    typing = lambda some: triples.where((F.col("p") == TYPE) & F.col("o").isin(*{s["target"] for s in some})).select(F.col("s").alias("focus"), F.col("o").alias("target"))
    classed = lambda some: typing(some).repartition(*parts, "focus").distinct()
    number, want, false = F.col("o").try_cast("double"), F.col("value").try_cast("double"), F.lit(False)
    tests = {
        "datatype": ~F.col("o_type").eqNullSafe(F.col("value")),
        "nodeKind": F.col("o_kind") != F.col("value"),
        "minInclusive": ~F.coalesce(F.col("number") >= F.col("want"), false),
        "maxInclusive": ~F.coalesce(F.col("number") <= F.col("want"), false),
        "minExclusive": ~F.coalesce(F.col("number") > F.col("want"), false),
        "maxExclusive": ~F.coalesce(F.col("number") < F.col("want"), false),
        "minLength": F.length("o") < F.col("want"),
        "maxLength": F.length("o") > F.col("want"),
        "pattern": ~F.rlike("o", F.col("value")),
        "in": ~F.array_contains("items", F.col("o")),
    }
    fails = reduce(lambda e, k: e.when(F.col("kind") == k, tests[k]), [k for k in VALUE_KINDS if k in used], F.when(false, false))
    found = []
    if used & {*VALUE_KINDS} or not used:
        some = of(*VALUE_KINDS)
        asked = facts({s["path"] for s in some}, "o_kind", "o_type").repartition(*parts, "focus").withColumn("number", number).join(classed(some), "focus")
        checks = rows(some).select("id", "target", "path", "kind", "value", "items", want.alias("want"))
        failed = asked.join(checks, ["target", "path"]).where(fails).select("id", "focus", "o")
        found.append(out(failed, some, F.col("o")))
    if used & {"minCount", "maxCount"}:
        some = of("minCount", "maxCount")
        due = typing(some).join(rows(some).select("id", "target", "path"), "target").select("id", "focus", "path").repartition(*parts, "focus", "path").distinct()
        counts = facts({s["path"] for s in some}).repartition(*parts, "focus", "path").groupBy("focus", "path").agg(F.count_distinct("o").alias("n"))
        limits = rows(some).select("id", F.col("kind").alias("_kind"), want.alias("want"))
        n = due.join(counts, ["focus", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(limits, "id")
        found.append(out(n.where(F.when(F.col("_kind") == "minCount", F.col("n") < F.col("want")).otherwise(F.col("n") > F.col("want"))), some, F.col("n")))
    if "class" in used:  # values of none of the classes first, which are few, then their instances' classes
        some = of("class")
        asked = facts({s["path"] for s in some}).join(rows(some).select("path", "value").distinct(), "path")
        classes = (typed or triples).where((F.col("p") == TYPE) & F.col("o").isin(*{s["value"] for s in some})).select(F.col("s").alias("o"), F.col("o").alias("value"))
        odd = _without(asked, classes, ["o", "value"], parts).repartition(*parts, "focus")
        found.append(out(odd.join(classed(some), "focus").join(rows(some).select("id", "target", "path", "value"), ["target", "path", "value"]), some, F.col("o")))
    if used & {"equals", "disjoint"}:  # each value once, with the sides that have it
        some = of("equals", "disjoint")
        asked = facts({p for s in some for p in (s["path"], s["value"])}).repartition(*parts, "focus").join(classed(some), "focus").join(sides(some), ["target", "path"])
        both = asked.groupBy("id", "focus", "o").agg((F.max("side") != F.min("side")).alias("both")).join(rows(some).select("id", F.col("kind").alias("_kind")), "id")
        found.append(out(both.where(F.when(F.col("_kind") == "equals", ~F.col("both")).otherwise(F.col("both"))), some, F.col("o")))
    if "lessThan" in used:  # than the least of the other's values, all of which must be numbers
        some = of("lessThan")
        asked = facts({p for s in some for p in (s["path"], s["value"])}).repartition(*parts, "focus").join(classed(some), "focus").join(sides(some), ["target", "path"])
        least = asked.where("side = 0").groupBy("id", "focus").agg(F.min(number).alias("least"), F.bool_or(number.isNull()).alias("odd"))
        below = asked.where("side = 1").join(least, ["id", "focus"]).where(F.col("odd") | ~F.coalesce(number < F.col("least"), false))
        found.append(out(below, some, F.col("o")).distinct())
    if "closed" in used:
        some = of("closed")
        said = facts(set().union(*[_odd(s, sizes) for s in some])).select("focus", "path").repartition(*parts, "focus").join(classed(some), "focus")
        odd = said.join(rows(some).select("id", "target", "items"), "target").where(~F.array_contains("items", F.col("path"))).select("id", "focus", "path").distinct()
        found.append(out(odd, some, F.col("path")))
    return reduce(DataFrame.unionByName, found) if found else triples.sparkSession.createDataFrame([], "focus string, path string, value string, shape string, severity string, message string")


def prune_by_shapes(triples: DataFrame, shapes: list[dict] | DataFrame) -> DataFrame:
    """Delete every node that a shape reports, in and out, until none is reported (A10).  Each round deletes some, so it ends.

    Triples aren't rewritten round by round: after the first, only the nodes that pointed to deleted ones are checked again, as nothing else
    has changed for others (all, if classes themselves are deleted).  The result leaves out deleted nodes as it is read; ``stage`` it if it is read often.
    """
    spark, sizes = triples.sparkSession, _sizes(triples)
    parts, given = _tasks(spark, sum(sizes.values())), _given(triples, shapes)
    checked = {TYPE, *[p for s in given for p in (s["path"], s["value"])]}
    checked = sizes if any(s["kind"] == "closed" for s in given) else [p for p in sizes if p in checked]
    gone, hit = None, set()

    def left(df: DataFrame) -> DataFrame:
        df = _without(df, gone.withColumnRenamed("_x", "s"), ["s"], parts)
        reached = F.coalesce(F.col("p").isin(*hit), F.lit(False))  # no other predicate leads to deleted nodes
        return df.where(~reached).unionByName(_without(df.where(reached), gone.withColumnRenamed("_x", "o"), ["o"], parts))

    some, typed = triples, None
    while True:
        new = stage(shape_check(some, shapes, typed=typed).select(F.col("focus").alias("_x")).distinct(), "pruned")
        if new.isEmpty():
            return triples if gone is None else left(triples)
        gone = new if gone is None else gone.unionByName(new)
        # values are made distinct before they meet the deleted nodes, since many are frequent
        now = {r[0] for r in triples.select("p", "o").distinct().join(new.select(F.col("_x").alias("o")), "o", "left_semi").select("p").distinct().collect()}
        hit |= now
        if TYPE in now:
            some = typed = stage(left(triples), "triples")
            continue
        ends = triples.where(F.col("p").isin(*now)).select("s", "o").repartition(*parts, "o").join(new.select(F.col("_x").alias("o")).repartition(*parts, "o"), "o")
        touched = stage(ends.select("s").distinct(), "touched")
        again = triples.where(F.col("p").isin(*checked)).repartition(*parts, "s").join(touched.repartition(*parts, "s"), "s")
        some, typed = stage(left(again.select(triples.columns)), "triples"), typed or triples


def same_as_precheck(same_as: DataFrame, triples: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, error) of same-as rows (row, target, duplicate) that can't be combined."""
    up = closure(classes)
    twice = same_as.where("duplicate is not null").groupBy("duplicate").agg(F.count_distinct("row").alias("n")).where("n > 1").select("duplicate")
    many = same_as.groupBy("row").agg(F.count_distinct("target").alias("t"), F.count_distinct("duplicate").alias("d")).where("t != 1 or d != 1")
    t = types(triples)
    pairs = same_as.join(t.withColumnsRenamed({"s": "target", "cls": "tc"}), "target").join(t.withColumnsRenamed({"s": "duplicate", "cls": "dc"}), "duplicate")
    fits = pairs.join(up, (F.col("tc") == F.col("sub")) & (F.col("dc") == F.col("super")), "left").where("tc = dc or sub is not null").select("row").distinct()
    return reduce(
        DataFrame.union,
        [
            same_as.join(twice, "duplicate", "left_semi").select("row", F.lit("duplicate is in several rows").alias("error")),
            same_as.where("target = duplicate").select("row", F.lit("target is its own duplicate")),
            many.select("row", F.lit("not one target and one duplicate")),
            pairs.select("row").distinct().join(fits, "row", "left_anti").select("row", F.lit("types differ")),
        ],
    ).distinct()


def same_as_batch(same_as: DataFrame) -> DataFrame:
    """Rows whose duplicate is no other row's target or duplicate: leaves first."""
    others = same_as.select(F.col("row").alias("_r"), F.explode(F.array("target", "duplicate")).alias("_n"))
    used = same_as.join(others, (F.col("duplicate") == F.col("_n")) & (F.col("row") != F.col("_r"))).select("row").distinct()
    return same_as.join(used, "row", "left_anti")


def _stuck(same_as: DataFrame) -> DataFrame:
    """(row) of same-as rows that never become leaves: several rows' duplicates, circles, and what those lead to."""
    after = same_as.select(F.col("row").alias("from"), F.col("target").alias("_n")).join(same_as.select(F.col("duplicate").alias("_n"), F.col("row").alias("to")), "_n").select("from", "to")
    twice = same_as.where("duplicate is not null").groupBy("duplicate").agg(F.count_distinct("row").alias("n")).where("n > 1")
    shared = stage(same_as.join(twice, "duplicate", "left_semi").select("row").distinct(), "stuck")
    led = reach(after, shared.withColumnRenamed("row", "from"), "from", "to").select(F.col("to").alias("row"))
    held = stage(shared.union(led).distinct(), "stuck")
    free = after.join(held.withColumnRenamed("row", "from"), "from", "left_anti").join(held.withColumnRenamed("row", "to"), "to", "left_anti")
    return held.union(on_circles(free, "from", "to").withColumnRenamed("from", "row")).distinct()


def combine_entities(triples: DataFrame, same_as: DataFrame, rules: DataFrame, drop_from_target: list[str] = (), drop_from_duplicate: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Merge duplicates into their targets, leaves first; (triples, rows left over).

    Outgoing triples move unless their predicate is listed, is the type, or the merged count would break a
    cardinality rule; incoming ones are repointed.  Counts are of the round's start.  Left over are rows in circles, rows that share a
    duplicate, and rows that wait for those.

    The order of merging matters only where a limit may be reached or targets lose a listed predicate: there rounds go level by level.
    All other trees of duplicates, however deep, go to their roots at once, found by pointer doubling.
    """
    rows = stage(same_as.select("row", "target", "duplicate"), "same-as")
    stuck = stage(_stuck(rows), "stuck")
    left = rows.join(stuck, "row", "left_semi")
    good = stage(rows.where("target is not null and duplicate is not null").join(stuck, "row", "left_anti"), "same-as")
    top = stage(roots_of(good.select("duplicate", "target").distinct(), "duplicate", "target").select(F.col("duplicate").alias("_d"), F.col("target").alias("_t")), "roots")
    member = stage(top.union(top.select("_t", "_t")).distinct().select(F.col("_d").alias("s"), F.col("_t").alias("root")), "members")
    # trees that must go level by level
    least = rules.where("restriction != 'minCardinality'").groupBy(F.col("property").alias("p")).agg(F.min("limit").alias("limit"))
    facts = triples.join(member, "s")
    ruled = facts.join(least, "p")
    full = ruled.groupBy("root", "p").agg(F.count_distinct("o").alias("n"), F.min("limit").alias("limit")).where("n > limit").select("root")
    if drop_from_target:
        full = full.union(facts.where(F.col("p").isin(*drop_from_target)).select("root"))
    full = stage(full.distinct(), "full")
    # what their ruled triples point to must be repointed in its own time too
    seen = ruled.join(full, "root", "left_semi").select(F.col("o").alias("s")).join(member, "s").select("root")
    slow = stage(full.union(seen).distinct(), "slow")
    slow_rows = good.join(member.join(slow, "root", "left_semi"), good["duplicate"] == member["s"], "left_semi")
    fast = stage(top.join(slow, F.col("_t") == F.col("root"), "left_anti"), "fast")
    moved = triples.join(fast, F.col("s") == F.col("_d"), "left").where(F.col("_d").isNull() | ~F.col("p").isin(TYPE, *drop_from_duplicate)).withColumn("s", F.coalesce("_t", "s")).select(triples.columns)
    both = moved.join(fast, F.col("o") == F.col("_d"), "left").withColumn("o", F.coalesce("_t", "o")).select(triples.columns).distinct()
    return _combine_by_level(stage(both, "combined"), stage(slow_rows, "same-as"), rules, drop_from_target, drop_from_duplicate), left


def _combine_by_level(triples: DataFrame, left: DataFrame, rules: DataFrame, drop_from_target: list[str], drop_from_duplicate: list[str]) -> DataFrame:
    """A round for each level of the trees in ``left``, which hold no circle."""
    cols = triples.columns
    while True:  # each round uses rows up
        batch = stage(same_as_batch(left), "batch")
        if batch.isEmpty():
            return triples
        pairs = batch.select(F.col("target").alias("_t"), F.col("duplicate").alias("_d"))
        tops = rules.where("restriction != 'minCardinality'").select(F.col("class").alias("cls"), F.col("property").alias("p"), "limit")
        moving = triples.join(pairs, F.col("s") == F.col("_d")).where(~F.col("p").isin(TYPE, *drop_from_duplicate))
        merged = (
            moving.select(F.col("_t").alias("s"), "p", "o").union(triples.join(pairs, F.col("s") == F.col("_t")).where(~F.col("p").isin(TYPE, *drop_from_target)).select("s", "p", "o"))
            .groupBy("s", "p").agg(F.count_distinct("o").alias("n"))
        )
        over = merged.join(types(triples), "s").join(tops, ["cls", "p"]).where("n > limit").select(F.col("s").alias("_t"), "p").distinct()
        moved = moving.join(over, ["_t", "p"], "left_anti").withColumn("s", F.col("_t")).select(cols)
        rest = triples.join(pairs.select("_d"), F.col("s") == F.col("_d"), "left_anti")
        if drop_from_target:
            on_target = F.col("p").isin(*drop_from_target)
            rest = rest.where(~on_target).unionByName(rest.where(on_target).join(pairs.select("_t"), F.col("s") == F.col("_t"), "left_anti"))
        both = rest.unionByName(moved).join(pairs, F.col("o") == F.col("_d"), "left").withColumn("o", F.coalesce("_t", "o")).select(cols).distinct()
        triples = stage(both, "combined")
        left = stage(left.join(batch, "row", "left_anti"), "same-as")


def combine_by_lookup(triples: DataFrame, rows: DataFrame, target_cols: dict[str, str], duplicate_cols: dict[str, str], classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(same-as rows, errors) from a table that names target and duplicate by property values.

    ``*_cols``: property to column.  Each side must be one subject, and the duplicate's class a superclass
    (or the class) of the target's; with any error no row is returned.
    """

    def found(cols: dict[str, str], out: str):
        keys = rows.select("row", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in cols.items()])))
        hits = keys.join(triples, ["p", "o"]).groupBy("row", "s").agg(F.count_distinct("p").alias("k")).where(F.col("k") == len(cols))
        n = rows.select("row").join(hits.groupBy("row").agg(F.count("*").alias("n"), F.min("s").alias(out)), "row", "left")
        return n.where("n = 1").select("row", out), n.where("n is null or n != 1").select("row", F.concat(F.lit(f"{out}: subjects found: "), F.coalesce("n", F.lit(0)).cast("string")).alias("error"))

    (targets, bad_t), (duplicates, bad_d) = found(target_cols, "target"), found(duplicate_cols, "duplicate")
    pairs = stage(targets.join(duplicates, "row"), "lookup-pairs")
    errors = stage(bad_t.union(bad_d).union(same_as_precheck(pairs, triples, classes)), "lookup-errors")
    return (pairs if errors.isEmpty() else pairs.limit(0)), errors
