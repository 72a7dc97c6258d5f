"""Rules in text: limits, materials, steps, sections, and checks of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import blank_to_null

# Patterns and words of the domain.
LIMITS = [
    r"([A-Za-z\u4e00-\u9fffØΦRaRz0-9_]+)\s*(<=|>=|=|<|>|±)\s*(\d+(?:\.\d+)?)\s*(μm|um|mm|cm|m|HBW|HRC|N·m|%)?",
    r"([\u4e00-\u9fffA-Za-z0-9_]+)\s*(不大于|不小于|大于等于|小于等于)\s*(\d+(?:\.\d+)?)\s*(μm|um|mm|cm|m|HBW|HRC|N·m|%)?",
]
COMPARATORS = {"不大于": "<=", "不小于": ">=", "大于等于": ">=", "小于等于": "<="}
MATERIALS = r"(?i)(铝合金|钛合金|不锈钢|钢|45钢|TC4|Al\d+|Ti[-\s]?\d+|Q\d+)"
TOOLS = r"(?i)(钻头|铣刀|扳手|夹具|胎具|工装|torque\s*wrench|reamer)"
INSPECTIONS = r"(检验|检测|复核|无损检测|目视检查|尺寸检查|验收)"
STEPS = ["制孔", "扩孔", "锪窝", "铆接", "装配", "检测", "清洗", "涂胶", "热处理", "车削", "铣削", "磨削"]
# Patterns of rules; the first pair is (material, process), the second (process, material).
FORBIDDEN_PAIR = r"材料\s*[：: ]\s*([\w\d\-]+).*工艺\s*[：: ]\s*([\w\d\-]+)|工艺\s*[：: ]\s*([\w\d\-]+).*材料\s*[：: ]\s*([\w\d\-]+)"
ORDERED = r"([^\s,\.;，]{2,})\s*(?:之前|先于|须在.*之前)\s*([^\s,\.;，]{2,})"
THICKNESS = r"厚度.{0,8}([><≤≥])\s*(\d+(?:\.\d+)?)"
TEMPERATURE = r"(?:温度|淬火|回火).{0,14}(?:≤|<)\s*(\d+(?:\.\d+)?)"
SECTIONS = [r"^\s*(\d+)\s+(.+)$", r"^\s*(\d+\.\d+)\s+(.+)$", r"^\s*(\d+\.\d+\.\d+)\s+(.+)$", r"^\s*第([一二三四五六七八九十百零\d]+)[章节部分]\s*(.+)$"]


def _matches(blocks: DataFrame, pattern: str, name: str) -> DataFrame:
    return blocks.select("doc_id", "seq", F.col("block_id").alias("source_block_id"), "page", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("match_no", name))


def extract_limits(blocks: DataFrame, patterns=LIMITS) -> DataFrame:
    """One row per parameter, operator, value and unit."""
    found = []
    for no, p in enumerate(patterns):
        groups = [F.regexp_extract_all("text", F.lit(p), i).alias(n) for i, n in enumerate(("parameter", "operator", "value", "unit"), 1)]
        rows = blocks.select("doc_id", "seq", "block_id", "page", F.posexplode(F.arrays_zip(*groups)).alias("match_no", "m")).withColumn("pattern_no", F.lit(no))
        found.append(rows)
    op = F.col("m.operator")
    for k, v in COMPARATORS.items():
        op = F.when(F.col("m.operator") == k, F.lit(v)).otherwise(op)
    return reduce(DataFrame.unionAll, found).select(
        "doc_id", "seq", F.col("block_id").alias("source_block_id"), "page", "pattern_no", "match_no",
        F.trim("m.parameter").alias("parameter"), F.trim(op).alias("operator"), F.col("m.value").try_cast("double").alias("value"), F.trim("m.unit").alias("unit"),
    )


def extract_materials(blocks: DataFrame) -> DataFrame:
    return _matches(blocks, MATERIALS, "material")  # X2


def extract_tools(blocks: DataFrame) -> DataFrame:
    return _matches(blocks, TOOLS, "tool_name")  # X3


def extract_inspections(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("text").rlike(INSPECTIONS)).select("doc_id", "seq", F.col("block_id").alias("source_block_id"), "page", F.trim("text").alias("inspection_text"))  # X4


def extract_steps(blocks: DataFrame, keywords=STEPS) -> DataFrame:
    """Steps numbered in document order, linked to the step before and after."""
    name = F.lit(None).cast("string")
    for k in reversed(keywords):
        name = F.when(F.contains("text", F.lit(k)), F.lit(k)).otherwise(name)
    w = W.partitionBy("doc_id").orderBy("seq", "block_id")
    out = blocks.withColumn("name", name).where("name is not null").withColumn("step_id", F.concat(F.lit("step_"), F.row_number().over(w).cast("string")))
    around = lambda f: F.coalesce(f("step_id").over(w), F.lit(""))
    return out.select("doc_id", "seq", "step_id", "name", F.trim("text").alias("description"), "page", F.col("block_id").alias("source_block_id"), around(F.lag).alias("before"), around(F.lead).alias("next_step"))


def extract_sections(blocks: DataFrame, patterns=SECTIONS) -> DataFrame:
    """Numbered titles: id, title, level."""
    text = F.trim("text")
    part = lambda i: F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, i)) for p in patterns])
    out = blocks.select("doc_id", "seq", "page", "block_id", F.trim(part(1)).alias("section_id"), F.trim(part(2)).alias("title")).where("section_id is not null")
    return out.withColumn("level", F.length("section_id") - F.length(F.replace("section_id", F.lit("."), F.lit(""))) + 1)


def extract_form_fields(blocks: DataFrame) -> DataFrame:
    """``name: value`` blocks, either colon."""
    p = r"^\s*([^:：]{1,40})[:：]\s*(.+)$"
    t = F.trim("text")
    return blocks.where(t.rlike(p)).select("doc_id", "seq", "block_id", "page", F.trim(F.regexp_extract(t, p, 1)).alias("name"), F.trim(F.regexp_extract(t, p, 2)).alias("value"))


def parse_pipe_tables(blocks: DataFrame, unit_words=("unit", "单位")) -> DataFrame:
    """Header, rows and unit columns of pipe tables."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(F.transform(F.split("text", "\n"), cells), lambda r: F.size(r) > 0)
    got = blocks.where(F.contains("text", F.lit("|"))).withColumn("_l", lines).where(F.size("_l") > 0)
    is_unit = lambda h: reduce(lambda a, b: a | b, [F.contains(F.lower(h), F.lit(u)) for u in unit_words])
    return got.select("doc_id", "seq", "block_id", F.col("_l")[0].alias("header"), F.slice("_l", 2, F.size("_l")).alias("rows"), F.filter(F.col("_l")[0], is_unit).alias("unit_columns"))


def extract_rules(blocks: DataFrame, snippet: int = 200) -> DataFrame:
    """Per line: forbidden pairs, orderings, thickness and temperature limits, with their confidence."""
    lines = blocks.select("doc_id", "seq", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line != ''")
    s = F.col("line")
    snip = F.when(F.length(s) > snippet, F.concat(F.substring(s, 1, snippet), F.lit("…"))).otherwise(s)
    got = lambda p, i, c=s: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    mat, proc = F.coalesce(got(FORBIDDEN_PAIR, 1), got(FORBIDDEN_PAIR, 4)), F.coalesce(got(FORBIDDEN_PAIR, 2), got(FORBIDDEN_PAIR, 3))
    order, thick, heat, plain = ORDERED, THICKNESS, TEMPERATURE, F.translate(s, "≤≥", "<>")
    none = F.lit(None)

    def rule(kind, test, a=none, b=none, op=none, value=none, confidence=none):
        cols = {"kind": F.lit(kind), "a": a.cast("string"), "b": b.cast("string"), "op": op.cast("string"), "value": value.cast("double"), "confidence": confidence.cast("double")}
        return lines.where(test).select("doc_id", "seq", "line_no", snip.alias("source"), *[c.alias(n) for n, c in cols.items()])

    return reduce(
        DataFrame.unionAll,
        [
            rule("forbid_pair", F.contains(s, F.lit("禁止")) & (F.contains(s, F.lit("材料")) | F.contains(s, F.lit("工艺"))), F.coalesce(mat, F.lit("__unspecified__")), F.coalesce(proc, F.lit("__unspecified__")), confidence=F.when(mat.isNotNull() | proc.isNotNull(), 0.55).otherwise(0.35)),
            rule("depends_on", s.rlike(order), got(order, 1), got(order, 2), confidence=F.lit(0.5)),
            rule("thickness_limit", plain.rlike(thick), F.lit("thickness_mm"), none, F.when(got(thick, 1, plain) == "<", "lt").otherwise("gt"), got(thick, 2, plain), F.lit(0.6)),
            rule("temperature_limit", s.rlike(heat), F.lit("temperature_c"), none, F.lit("lte"), got(heat, 1), F.lit(0.45)),
        ],
    )


def validate_sections(sections: DataFrame) -> DataFrame:
    """Repeated ids, and dotted ids whose parent has not come before."""
    w = W.partitionBy("doc_id", "section_id").orderBy("seq")
    ranked = sections.withColumns({"n": F.row_number().over(w), "prev": F.lag("seq").over(w)})
    repeated = ranked.where("n > 1").select("doc_id", "seq", "section_id", F.lit("duplicate_id").alias("error"))
    # the least seq is where sorted rows first have one: no second grouping, whose hash map would hold what a task reads
    first = ranked.where("seq is not null and prev is null").select("doc_id", F.col("section_id").alias("parent"), F.col("seq").alias("at"))
    child = sections.where(F.contains("section_id", F.lit("."))).withColumn("parent", F.regexp_replace("section_id", r"\.[^.]*$", ""))
    orphan = child.join(first, ["doc_id", "parent"], "left").where("at is null or at >= seq").select("doc_id", "seq", "section_id", F.lit("missing_parent"))
    return repeated.unionAll(orphan)


def validate_steps(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """Documents without steps; links to unknown steps (X11)."""
    none = docs.select("doc_id").distinct().join(steps, "doc_id", "left_anti").select("doc_id", F.lit("").alias("step_id"), F.lit("no_steps").alias("error"))
    known = steps.select("doc_id", F.col("step_id").alias("next_step"))
    return none.unionAll(steps.where("next_step != ''").join(known, ["doc_id", "next_step"], "left_anti").select("doc_id", "step_id", F.lit("unknown_next_step")))


def _issues(df: DataFrame, tests: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for t, level, code in tests]), lambda x: x.isNotNull())
    return df.select("doc_id", "seq", F.inline(found))


def validate_limits(limits: DataFrame) -> DataFrame:
    """X12."""
    none = lambda c: blank_to_null(F.col(c)).isNull()
    return _issues(limits, [(none("operator"), "error", "missing_operator"), (F.col("value").isNull(), "error", "missing_value"), (none("unit"), "warning", "missing_unit")])


def validate_tables(tables: DataFrame) -> DataFrame:
    """X12; cells that a merge has swallowed show as rows of another width."""
    return _issues(tables, [(F.size("header") == 0, "error", "missing_header"), (F.size("rows") == 0, "warning", "no_rows"), (F.exists("rows", lambda r: F.size(r) != F.size("header")), "warning", "merged_cells")])


def filter_by_rules(candidates: DataFrame, rules: DataFrame, explain_all: bool = False) -> DataFrame:
    """(object_id, constraint_id, ok, reason) of every rule and candidate, and an __aggregate__ row per rejected one.

    candidates: object_id, type, attributes MAP, text.  rules: constraint_id, type, kind (forbid_pair, text_must_not, threshold), a, b, key, op, value.
    A missing or unparsable number fails.  A rule without a type is for each type that occurs, so rules and candidates
    meet on their type.
    """
    kinds = candidates.select("type").distinct()
    typed = rules.where("type is not null").withColumn("_t", F.struct("type"))
    every = rules.where("type is null").join(kinds.select(F.struct("type").alias("_t")))  # types by rules, no candidates
    ruled = typed.unionByName(every).drop("type")
    pairs = candidates.join(ruled, F.struct("type").eqNullSafe(F.col("_t")))
    has = lambda c: F.array_contains(F.map_values("attributes"), F.col(c))
    number, limit, op = F.try_element_at("attributes", F.col("key")).try_cast("double"), F.col("value"), F.col("op")
    met = F.when(op == "lt", number < limit).when(op == "lte", number <= limit).when(op == "gt", number > limit).when(op == "gte", number >= limit).otherwise(number == limit)
    ok = F.when(F.col("kind") == "forbid_pair", ~F.coalesce(has("a") & has("b"), F.lit(False))).when(F.col("kind") == "text_must_not", ~F.contains(F.coalesce("text", F.lit("")), F.col("a"))).otherwise(F.coalesce(met, F.lit(False)))
    judged = pairs.select("object_id", "constraint_id", ok.alias("ok"), F.col("kind").alias("reason"))
    bad = judged.where("not ok")
    total = bad.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("constraint_id")), ",").alias("reason")).select("object_id", F.lit("__aggregate__").alias("constraint_id"), F.lit(False).alias("ok"), "reason")
    return (judged if explain_all else bad).unionByName(total)


def validate_transitions(trajectories: DataFrame, forbidden: DataFrame, before: DataFrame) -> DataFrame:
    """(id, error): forbidden steps (from_state, to_state), then required orders (first, second)."""
    norm = lambda c: F.lower(F.trim(c))
    t = trajectories.select("id", F.transform("states", norm).alias("states"))
    moves = t.where(F.size("states") > 1).select("id", F.inline(F.arrays_zip(F.slice("states", 1, F.size("states") - 1).alias("f"), F.slice("states", 2, F.size("states")).alias("t"))).alias("f", "t"))
    hit = moves.join(F.broadcast(forbidden.select(norm(F.col("from_state")).alias("f"), norm(F.col("to_state")).alias("t"))), ["f", "t"], "left_semi")  # states are hot keys, rules few
    # where a state comes first is asked of the trajectory itself, so that its states aren't grouped again; an order needs both of its states there
    orders = before.select(norm(F.col("first")).alias("a"), norm(F.col("second")).alias("b"))
    at = lambda s: F.array_position("states", F.col(s))
    late = t.select("id", "states", F.explode(F.array_distinct("states")).alias("a")).join(F.broadcast(orders), "a").where((at("b") > 0) & (at("a") > at("b")))
    return hit.select("id", F.concat(F.lit("forbidden: "), "f", F.lit(" -> "), "t").alias("error")).distinct().unionAll(late.select("id", F.concat("a", F.lit(" must come before "), "b")))
