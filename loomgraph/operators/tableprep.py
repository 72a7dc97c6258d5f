"""Cleaning, checking, mapping and loading tables; operations on result tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import blank_to_null
from loomgraph.plans.pattern import TYPE, closure
from loomgraph.runtime import stage

# Date and time formats, tried in order.
DATETIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yy"]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
INTEGER_TYPES = {"integer": None, "int": None, "long": None, "negativeInteger": ("<", 0), "nonNegativeInteger": (">=", 0), "positiveInteger": (">", 0), "nonPositiveInteger": ("<=", 0), "unsignedInt": (">=", 0)}


def lower_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.lower(c) for c in cols})  # T1


def blank_cells(df: DataFrame, nulls: bool = True, na: bool = True) -> DataFrame:
    """Cells that say null or n/a, in any case, become empty."""
    words = ["null"] * nulls + ["n/a"] * na
    return df.select(*[F.when(F.lower(F.trim(c)).isin(words), "").otherwise(F.col(c)).alias(c) for c in df.columns]) if words else df


def split_cell(c: Column, delimiter: str) -> Column:
    """Parts, trimmed, without empty ones at the end; a cell without the delimiter is one part."""
    parts = F.transform(F.split(c, f"\\Q{delimiter}\\E"), lambda x: F.trim(x))
    last = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda a, i: F.when(F.element_at(parts, i) != "", i).otherwise(a))
    return F.when(F.contains(c, F.lit(delimiter)), F.slice(parts, 1, last)).otherwise(F.array(c))


def split_rows(df: DataFrame, delimiters: dict[str, str]) -> DataFrame:
    """Every combination of the parts of the listed columns."""
    for c, d in delimiters.items():
        df = df.withColumn(c, F.explode_outer(split_cell(F.col(c), d)))
    return df


def paired_split_rows(df: DataFrame, sets: list[dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the columns of a set split by position together; lengths that differ are errors (T4)."""
    order, errors = df.columns, []
    for s in sets:
        parts = df.withColumns({f"_p_{c}": split_cell(F.col(c), d) for c, d in s.items()})
        sizes = [F.size(f"_p_{c}") for c in s]
        same = F.coalesce(reduce(lambda a, b: a & b, [n == sizes[0] for n in sizes]), F.lit(False))
        errors.append(parts.where(~same).select(*order, F.lit(f"parts differ in number: {', '.join(s)}").alias("error")))
        zipped = parts.where(same).withColumn("_z", F.explode_outer(F.arrays_zip(*[F.col(f"_p_{c}").alias(c) for c in s])))
        df = zipped.select(*[F.col(f"_z.{c}").alias(c) if c in s else F.col(c) for c in order])
    return df, reduce(DataFrame.unionAll, errors) if errors else df.limit(0).withColumn("error", F.lit(""))


def clean(df: DataFrame, lower=(), nulls=True, na=True, splits=None, paired=()) -> tuple[DataFrame, DataFrame]:
    """Lower, nulls, n/a, splits, paired splits, in this order (T5)."""
    return paired_split_rows(split_rows(blank_cells(lower_columns(df, list(lower)), nulls, na), splits or {}), list(paired))


def parse_time(c: Column, formats=DATETIME_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def cell_error(name: str, rules: dict) -> Column:
    """The first failing rule of a cell, else null (T6).  Patterns match whole cells."""
    c = F.trim(F.coalesce(F.col(name), F.lit("")))
    says = lambda text: F.concat(F.lit(f"{name}: "), c, F.lit(f" {text}"))
    kind = rules.get("type")
    number = c.try_cast("double")
    value = F.unix_timestamp(parse_time(c)) if kind in ("date", "datetime") else number
    bound = lambda v: F.unix_timestamp(parse_time(F.lit(v))) if kind in ("date", "datetime") else F.lit(float(v))
    valid = {"int": c.try_cast("long").isNotNull(), "float": number.isNotNull(), "date": parse_time(c, DATE_FORMATS).isNotNull(), "datetime": parse_time(c).isNotNull(), "time": F.try_to_timestamp(c, F.lit("HH:mm:ss")).isNotNull()}
    tests = []
    if rules.get("notEmpty"):
        tests.append((c == "", says("is empty")))
    tests.append((c == "", F.lit(None).cast("string")))
    if "regexMatches" in rules:
        tests.append((~c.rlike(f"^(?:{rules['regexMatches']})$"), says("does not match")))
    if "regexNoMatch" in rules:
        tests.append((c.rlike(f"^(?:{rules['regexNoMatch']})$"), says("matches")))
    if kind:
        tests.append((~valid[kind], says(f"is no {kind}")))
    for op, bad in (("gt", lambda v: value <= v), ("gte", lambda v: value < v), ("lt", lambda v: value >= v), ("lte", lambda v: value > v), ("ne", lambda v: value == v)):
        if op in rules:
            tests.append((F.coalesce(bad(bound(rules[op])), F.lit(True)), says(f"fails {op} {rules[op]}")))
    out = F.lit(None).cast("string")
    for test, message in reversed(tests):
        out = F.when(test, message).otherwise(out)
    return out


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """1-based numbers in read order: a count per partition, then an offset; no row leaves its partition."""
    marked = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_id", 33))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row per partition
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_n", "_before")


def validate_table(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Error rows with their number and messages; missing columns give the one row 0."""
    missing = [c for c in rules if c not in df.columns and rules[c].get("required", True)]
    if missing:
        row = [f"missing columns: {', '.join(missing)}"]
        return df.sparkSession.createDataFrame([(0, row[0])], "row_number long, errors string")
    errors = F.concat_ws(";", *[cell_error(c, r) for c, r in rules.items() if c in df.columns])
    return numbered(df).withColumn("errors", errors).where("errors != ''")


TRANSFORMS = {
    "toUpperCase": lambda c: F.upper(c),
    "toLowerCase": lambda c: F.lower(c),
    "hashCode": lambda c: F.concat(F.lit("z"), F.sha1(c.cast("binary"))),
}


def transformed(c: Column, steps: list) -> Column:
    """Steps by name, or ("replaceAll", pattern, replacement)."""
    for s in steps:
        c = F.regexp_replace(c, s[1], s[2]) if isinstance(s, tuple) else TRANSFORMS[s](c)
    return c


def mapped_value(items: list, is_node: bool = False) -> tuple[Column, Column]:
    """(value, error) from column names, ("text", constant) and (column, steps) joined.

    Of a node's columns all must be filled or none: none gives a blank value, some an error.
    """
    cols, parts = [], []
    for i in items:
        if isinstance(i, tuple) and i[0] == "text":
            parts.append(F.lit(i[1]))
        else:
            name, steps = i if isinstance(i, tuple) else (i, [])
            cols.append(blank_to_null(F.col(name)))
            parts.append(F.coalesce(transformed(F.col(name), steps), F.lit("")))
    empty = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in cols], F.lit(0))
    value = F.concat(*parts)
    if not cols:
        return value, F.lit(None).cast("string")
    value = F.when(empty == len(cols), F.lit(None)).otherwise(value)
    error = F.when((empty > 0) & (empty < len(cols)), F.lit("some of the node's columns are empty")) if is_node else F.lit(None).cast("string")
    return value, error


def coerce(c: Column, kind: str) -> Column:
    """The ISO or canonical form of a value, null if it is none of the kind."""
    c = F.trim(c)
    if kind == "dateTime":
        return F.date_format(parse_time(c), "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "date":
        return F.date_format(parse_time(c, DATE_FORMATS), "yyyy-MM-dd")
    if kind in INTEGER_TYPES:
        n, sign = c.try_cast("decimal(38,0)"), INTEGER_TYPES[kind]
        fits = c.rlike(r"^[+-]?\d+$")
        if sign:
            fits = fits & {"<": n < 0, ">=": n >= 0, ">": n > 0, "<=": n <= 0}[sign[0]]
        return F.when(fits, n.cast("string"))
    if kind in ("decimal", "double", "float"):
        return F.when(c.try_cast("double").isNotNull(), c)
    if kind == "boolean":
        return F.when(F.lower(c).isin("true", "false", "1", "0"), F.lower(c))
    if kind == "uri":
        return F.when(c.rlike(r"^[^\s<>\"]+(://|#)[^\s<>\"]*$"), c)
    patterns = {"time": r"^\d\d:\d\d:\d\d", "duration": r"^-?P", "gYearMonth": r"^\d{4}-\d\d$", "gMonth": r"^--\d\d$", "gMonthDay": r"^--\d\d-\d\d$"}
    return F.when(c.rlike(patterns[kind]), c) if kind in patterns else c


def facets_ok(c: Column, facets: list[dict], any_of: bool = False) -> Column:
    """All facets hold, or any of them for a union."""
    n, tests = c.try_cast("double"), []
    for f in facets:
        for k, v in f.items():
            tests.append({
                "enumeration": lambda v=v: c.isin(*v) if isinstance(v, list) else c == v, "minInclusive": lambda v=v: n >= v, "maxInclusive": lambda v=v: n <= v,
                "minExclusive": lambda v=v: n > v, "maxExclusive": lambda v=v: n < v, "pattern": lambda v=v: c.rlike(f"^(?:{v})$"),
                "minLength": lambda v=v: F.length(c) >= v, "maxLength": lambda v=v: F.length(c) <= v, "length": lambda v=v: F.length(c) == v,
            }[k]())
    return F.coalesce(reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), tests), F.lit(False)) if tests else F.lit(True)


def build_uri(c: Column, prefix: str = "uri://loomgraph#", members: list[str] | None = None) -> Column:
    """Blank gives none; members of an enumeration match by name; # or :// stays; else the prefix."""
    v = blank_to_null(c)
    if members is not None:
        out = F.lit(None).cast("string")
        for m in members:
            out = F.when(F.lower(v) == m.rsplit("#", 1)[-1].lower(), F.lit(m)).when(v == m, F.lit(m)).otherwise(out)
        return out
    return _uri_of(v, prefix)


def _uri_of(v: Column, prefix: str) -> Column:
    return F.when(F.contains(v, F.lit("#")) | F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit(prefix), F.regexp_replace(v, r"[^\w\-.~]", "_")))


def lookup_uris(rows: DataFrame, keys: dict[str, str], triples: DataFrame, mode: str = "noCreate", cls: str | None = None, out: str = "uri") -> DataFrame:
    """``out`` and ``<out>_error`` of each row, by column to predicate; a blank key looks nothing up.

    Modes: noCreate, createIfMissing (one id per key, by hash, so that retries agree), errorIfExists.
    """
    found = None
    for c, p in keys.items():
        part = triples.where(F.col("p") == p).select("s", F.col("o").alias(c)).distinct()
        found = part if found is None else found.join(part, "s")
    if cls:
        found = found.join(triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s"), "s", "left_semi")
    hits = found.groupBy(*keys).agg(F.count_distinct("s").alias("_n"), F.min("s").alias("_uri"))
    blank = reduce(lambda a, b: a | b, [blank_to_null(F.col(c)).isNull() for c in keys])
    n = F.coalesce("_n", F.lit(0))
    minted = F.concat(F.lit("uri://loomgraph#"), F.sha2(F.concat_ws("\x1f", F.lit(cls or ""), *keys), 256))
    uri = {"noCreate": F.col("_uri"), "createIfMissing": F.coalesce("_uri", minted), "errorIfExists": minted}[mode]
    error = F.when(n > 1, "several matches")
    if mode == "noCreate":
        error = error.when(n == 0, "no match")
    if mode == "errorIfExists":
        error = F.when(n > 0, "exists already")
    # blank keys are many in messy tables, and would meet in one task: they don't join
    filled = rows.where(~blank).join(hits, list(keys), "left").withColumn(out, F.when(error.isNull(), uri)).withColumn(f"{out}_error", error)
    none = rows.where(blank).withColumn(out, F.lit(None).cast("string")).withColumn(f"{out}_error", F.lit(None).cast("string"))
    return filled.select(*none.columns).unionByName(none)


def check_type_restriction(rows: DataFrame, uri_col: str, triples: DataFrame, classes: DataFrame, cls: str) -> DataFrame:
    """Rows whose node has a class that is neither ``cls`` nor a subclass."""
    fine = closure(classes).where(F.col("super") == cls).select(F.col("sub").alias("o"))
    fine = fine.union(fine.sparkSession.createDataFrame([(cls,)], "o string")).distinct()
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias(uri_col), "o")
    bad = types.join(fine, "o", "left_anti").select(uri_col).distinct().join(types.join(fine, "o", "left_semi").select(uri_col).distinct(), uri_col, "left_anti")
    return rows.join(bad, uri_col, "left_semi")


@dataclass
class Mapping:
    """A node made from a row: its URI's items, class, properties (predicate: (items, kind)) and links (predicate: node name)."""

    name: str
    cls: str
    uri: list
    props: dict[str, tuple[list, str]] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)


def rows_to_triples(rows: DataFrame, mappings: list[Mapping], graph: str = "default", prefix: str = "uri://loomgraph#", distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of mapped rows: types, properties and links; empty parts are left out.

    ``distinct=False`` leaves repeats to a caller who drops those of several tables at once.
    """
    coded, kinds, errors = _coded_triples(rows, mappings, graph, prefix)
    return _decoded(coded.distinct() if distinct else coded, kinds), errors


def tables_to_triples(tables: list[tuple[DataFrame, list[Mapping]]], only: list[str] | None = None, graph: str = "default", prefix: str = "uri://loomgraph#") -> DataFrame:
    """Distinct triples of the mapped rows of several tables.

    ``only``: the predicates to make beside types, if no others are to be read; rows with errors are left out by all of theirs.
    More than a task a core can hold are dealt by their number first: few are repeats, so tasks that made theirs distinct before would hold nearly all.
    """
    coded, kinds, n = None, [], 0
    for rows, mappings in tables:
        one, kinds, _ = _coded_triples(rows, mappings, graph, prefix, kinds, only)
        coded = one if coded is None else coded.unionByName(one)
        n += rows.count() * sum(only is None or p in (TYPE, *only) for m in mappings for p in (TYPE, *m.props, *m.links))
    tasks = -(-n // DISTINCT_ROWS)
    if tasks > coded.sparkSession.sparkContext.defaultParallelism:
        coded = coded.repartition(tasks, "code", "s", "o")
    return _decoded(coded.distinct(), kinds)


def _decoded(coded: DataFrame, kinds: list[tuple[str, str, str, str]]) -> DataFrame:
    names = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k, ("graph", "p", "o_kind", "o_type"), strict=True)]) for k in kinds])
    return coded.withColumn("_k", F.get(names, F.col("code"))).select("_k.graph", "s", "_k.p", "o", "_k.o_kind", "_k.o_type")


def _coded_triples(rows: DataFrame, mappings: list[Mapping], graph: str, prefix: str, kinds=(), only: list[str] | None = None) -> tuple[DataFrame, list, DataFrame]:
    """((code, s, o), kinds, errors): a code is the place in ``kinds`` of what a part's triples have in common, which so isn't shuffled."""
    uris = {m.name: mapped_value(m.uri, True) for m in mappings}
    # each value is a column before anything uses it twice, else every use would work it out anew
    given = rows.withColumns({f"_v_{n}": blank_to_null(v) for n, (v, _) in uris.items()})
    given = given.withColumns({f"_u_{n}": _uri_of(F.col(f"_v_{n}"), prefix) for n in uris})
    props = [(m.name, p, items, kind) for m in mappings for p, (items, kind) in m.props.items()]
    given = given.withColumns({f"_w_{i}": mapped_value(items)[0].cast("string") for i, (_, _, items, _) in enumerate(props)})
    given = given.withColumns({f"_p_{i}": coerce(F.col(f"_w_{i}"), kind) for i, (_, _, _, kind) in enumerate(props)})
    parts = [(F.col(f"_u_{m.name}"), TYPE, F.lit(m.cls), "uri", "class") for m in mappings]
    parts += [(F.col(f"_u_{name}"), p, F.col(f"_p_{i}"), "literal", kind) for i, (name, p, _, kind) in enumerate(props)]
    parts += [(F.col(f"_u_{m.name}"), p, F.col(f"_u_{other}"), "uri", "uri") for m in mappings for p, other in m.links.items()]
    no_data = reduce(lambda x, y: x & y, [s.isNull() | o.isNull() for s, _, o, _, _ in parts])
    odd = [F.when(F.col(f"_w_{i}").isNotNull() & F.col(f"_p_{i}").isNull(), F.concat(F.lit(f"{p}: no {kind}: "), F.col(f"_w_{i}"))) for i, (_, p, _, kind) in enumerate(props)]
    problems = [*[e for _, e in uris.values()], *odd, F.when(no_data, F.lit("the row has no data"))]
    marked = given.withColumn("_error", F.coalesce(*problems).isNotNull())
    # tests come after the parts are rows of their own: a filter on rows would go down and work out all values again
    s_if_fine = lambda s: F.when(~F.col("_error"), s).alias("s")
    wanted = [x for x in parts if only is None or x[1] in (TYPE, *only)]
    kinds = list(dict.fromkeys([*kinds, *[(graph, p, kind, t) for _, p, _, kind, t in wanted]]))
    made = F.array(*[F.struct(F.lit(kinds.index((graph, p, kind, t))).alias("code"), s_if_fine(s), o.cast("string").alias("o")) for s, p, o, kind, t in wanted])
    triples = marked.select(F.inline(made)).where("s is not null and o is not null")
    text = F.nullif(F.concat_ws(";", *problems), F.lit(""))
    return triples, kinds, given.withColumn("error", text).where("error is not null").select(*rows.columns, "error")


def loaded_ids(spark, path: str) -> list[str]:
    """Loads whose triples are all there: each has a mark, written after them."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    fs = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(marks)) if fs.exists(marks) else []


def read_loaded(spark, path: str) -> DataFrame:
    """(graph, s, o, o_kind, o_type, p) of all loads that ended; what a failed one has left isn't read."""
    ids = loaded_ids(spark, path)
    folders = [f"{path}/load={i}" for i in ids]
    empty = spark.createDataFrame([], TRIPLE_SCHEMA)
    return spark.read.schema(TRIPLE_SCHEMA).option("basePath", path).parquet(*folders).drop("load") if folders else empty


def load(rows: DataFrame, mappings: list[Mapping], path: str, precheck: bool = True, **kw) -> DataFrame:
    """Write the triples that aren't there yet, a folder for each predicate; with any error and a precheck nothing is written.
    Returns the errors (T17).

    A load is a folder of its own named by a digest of its triples, overwritten if a former try left it half-written, and counts once its mark
    is in the manifest: loading the same rows again, or again after a failure, adds nothing.  A predicate's triples are
    dealt to as many tasks as its share of all triples asks for, so that a frequent one (types) isn't written by one task.
    """
    triples, errors = rows_to_triples(rows, mappings, **kw)
    errors = stage(errors, "load-errors")
    if not (precheck and not errors.isEmpty()):
        triples, spark = stage(triples, "load-triples"), rows.sparkSession
        sums = [F.sum(F.xxhash64(F.lit(x), "graph", "s", "p", "o", "o_kind", "o_type").cast("decimal(38,0)")) for x in "ab"]
        name = hashlib.sha256(repr(tuple(triples.agg(F.count("*"), *sums).first())).encode()).hexdigest()[:32]
        if name in loaded_ids(spark, path):
            return errors
        sizes = triples.groupBy("p").agg(F.count("*").alias("_n"))  # a row a predicate
        there = read_loaded(spark, path).join(sizes.select("p"), "p", "left_semi")
        keys = ["graph", "s", "p", "o", "o_kind", "o_type"]
        # a hash first, by which rows are sorted without comparing texts; none is broadcast, as texts are far larger than their files
        hashed = lambda df: df.withColumn("_h", F.xxhash64(*keys))
        given, there = hashed(triples), hashed(there).hint("merge")
        new = given.join(there, reduce(lambda a, b: a & b, [given["_h"] == there["_h"], *[given[k].eqNullSafe(there[k]) for k in keys]]), "left_anti").drop("_h")
        parts = F.ceil(F.col("_n") / F.lit(LOAD_ROWS)).cast("int")
        dealt = new.join(sizes, "p").withColumn("_part", F.pmod(F.xxhash64("s"), parts)).repartition("p", "_part").sortWithinPartitions("p", "s")
        dealt.drop("_n", "_part").write.mode("overwrite").partitionBy("p").parquet(f"{path}/load={name}")
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{name}")
        mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()
    return errors


TRIPLE_SCHEMA = "graph string, s string, o string, o_kind string, o_type string, p string"
#: Triples of one predicate that a task writes, about.
LOAD_ROWS = 250_000
#: Triples of several tables that a task makes distinct, about.
DISTINCT_ROWS = 1_000_000

# Result tables


def stitch(steps: list[DataFrame], keys: list, common: list[str] = (), names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, conflicts) of successive full outer joins (B1).

    ``keys``: key columns, or a list of them for each step after the first.  Common columns coalesce, and rows where they
    differ are conflicts.  Every other column is <column>-<step's name> (ng1, ng2, ...), or <column> if one step alone has it.
    A column that becomes a key later must have come from one step until then.
    """
    names = names or [f"ng{i}" for i in range(1, len(steps) + 1)]
    each = [list(k) for k in keys] if keys and not isinstance(keys[0], str) else [list(keys)] * (len(steps) - 1)
    made: dict[str, list[str]] = {}  # column: its names so far
    shared, out, conflicts = set(), None, []
    for i, (step, name) in enumerate(zip(steps, names, strict=True)):
        own = each[max(0, i - 1)] if each else []
        if i:
            for k in (k for k in own if k not in shared):
                if len(made.get(k, ())) != 1:
                    raise ValueError(f"{name}: key column {k} is in {len(made.get(k, ()))} steps before it")
                out = out.withColumnRenamed(made.pop(k)[0], k)
                shared.add(k)
        else:
            own = [k for k in own if k in step.columns]
            shared |= set(own)
        for c in (c for c in step.columns if c not in own and c not in common):
            step = step.withColumnRenamed(c, f"{c}-{name}")
            made.setdefault(c, []).append(f"{c}-{name}")
        if out is None:
            out = step
            continue
        twice = [c for c in common if c in step.columns and c in out.columns and c not in own]
        out = out.join(step.withColumnsRenamed({c: f"_again_{c}" for c in twice}), own, "full")
        for c in twice:
            left, right = F.col(f"`{c}`"), F.col(f"`_again_{c}`")
            conflicts.append(out.where(left != right).select(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in own]).alias("key"), F.lit(c).alias("column"), left.cast("string").alias("a"), right.cast("string").alias("b")))
            out = out.withColumn(c, F.coalesce(left, right)).drop(f"_again_{c}")
    out = out.withColumnsRenamed({new[0]: c for c, new in made.items() if len(new) == 1})
    none = out.limit(0).select(*[F.lit("").alias(c) for c in ("key", "column", "a", "b")])
    return out, reduce(DataFrame.unionByName, conflicts) if conflicts else none


def fuse_tables(tables: dict[str, DataFrame], on: list[str], optional: bool = False) -> DataFrame:
    """Inner, or keep-what-exists, join of distinct tables on shared columns; clashes take the table's name (B2)."""
    out = None
    for name, t in tables.items():
        t = t.distinct()
        if out is not None:
            t = t.withColumnsRenamed({c: f"{c}_{name}" for c in t.columns if c in out.columns and c not in on})
        out = t if out is None else out.join(t, on, "full" if optional else "inner")
    return out


def append_tables(tables: list[DataFrame]) -> DataFrame:
    """B3."""
    if any(set(t.columns) != set(tables[0].columns) for t in tables):
        raise ValueError("the tables' columns differ")
    return reduce(DataFrame.unionByName, tables)


def uniquify(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (B4): a partial aggregate."""
    rest = [c for c in df.columns if c not in cols]
    return df.groupBy(*cols).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in cols else F.col(f"_r.{c}").alias(c) for c in df.columns])


def subset_matches(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == value)  # B5


def subset_substring(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in cols]))


def sort_as(df: DataFrame, col: str | None = None, kind: str = "string", descending: bool = False) -> DataFrame:
    """By one column as string, int or double, ties by all columns; without a column by all."""
    key = [F.col(col).try_cast(kind)] if col else []
    return df.orderBy(*[k.desc() if descending else k.asc() for k in key], *df.columns)


def add_joined_column(df: DataFrame, name: str, items: list[str], delimiter: str = "") -> DataFrame:
    """Columns and "quoted" constants joined."""
    return df.withColumn(name, F.concat_ws(delimiter, *[F.lit(i[1:-1]) if i[:1] == '"' else F.coalesce(F.col(i).cast("string"), F.lit("")) for i in items]))


def page(df: DataFrame, order: list[str], offset: int = 0, size: int = 0) -> DataFrame:
    """B8; size 0 is to the end."""
    out = df.orderBy(*order).offset(offset)
    return out.limit(size) if size else out


def unique_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()  # B9


def all_rows_match(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) <= 1).alias(c) for c in cols])


def table_hash(df: DataFrame) -> DataFrame:
    """An MD5 that the order of rows doesn't change and that of columns does (B10): sums of row hashes, at any size."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in df.columns]).cast("binary"))
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"))
    return sums.select(F.md5(F.concat_ws("|", F.lit(",".join(df.columns)), "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("binary")).alias("table_hash"))


def fetch_groups(df: DataFrame, semantic: list[str], source: list[str]) -> DataFrame:
    """One id per combination of semantic columns, with the distinct source columns."""
    out = df.groupBy(*semantic).agg(F.array_sort(F.collect_set(F.struct(*source))).alias("sources"))
    return out.withColumn("group_id", F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in semantic]).cast("binary")))


def regroup(groups: DataFrame, external: DataFrame, columns: list[str]) -> DataFrame:
    """External rows of each group with its semantic columns; a column they lack says ' --- ' (B11)."""
    out = external.join(groups.drop("sources"), "group_id")
    return out.select(*[F.col(c) if c in out.columns else F.lit(" --- ").alias(c) for c in columns])
