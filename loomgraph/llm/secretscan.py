"""Operator 12: secrets in every version of every text, by an incremental ledger of blobs.

A text is a blob named by its SHA-256.  The ledger keeps what each rule, at its version, found in each blob, so that a run scans
only the pairs of blob and rule version that it has not seen; findings join back to every path that holds the blob.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import raw_texts
from loomgraph.runtime import new_path, stage, table

SPANS = "array<struct<rule:string,first:long,past:long>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, at least ``least`` characters of its ``group``; tried on texts that hold one of ``hints`` in any case."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hints: tuple[str, ...] = ()
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    @property
    def tight(self) -> str:
        """A pattern of the same matches; for runs of one class the least length is in it, since a shorter run holds none."""
        run = self.least > 0 and not self.group and re.fullmatch(r"\[[^\]]+\]\+", self.pattern)
        return f"{self.pattern[:-1]}{{{self.least},}}" if run else self.pattern

    def spans(self, text: str, finder: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in finder.finditer(text) if len(m[self.group]) >= self.least]


# The base patterns.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2,
         ("password", "passwd", "secret", "token", "apikey", "api_key"), any_case=True),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    Rule("hex", 1, "[0-9a-f]+", 24),
)
#: Key blocks and signed web tokens, which the base patterns leave out.
MORE_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40, 0, ("eyj",)),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches):
        finders = {r.name: (r, re.compile(r.tight, re.A | (re.I if r.any_case else 0))) for r in rules}
        for batch in batches:
            found = []
            for raw, todo in zip(raw_texts(batch.column("text")), batch.column("todo").to_pylist(), strict=True):
                low, text, spans = raw.lower(), raw.decode(errors="replace"), []
                for name in todo:
                    rule, finder = finders[name]
                    if not rule.hints or any(h.encode() in low for h in rule.hints):
                        spans += [{"rule": name, "first": a, "past": b} for a, b in rule.spans(text, finder)]
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("todo"), pa.array(found, pa.list_(pa.struct([("rule", pa.string()), ("first", pa.int64()), ("past", pa.int64())])))],
                ["blob", "rules", "spans"],
            )

    return scan


class Ledger:
    """A folder of rows (blob, rules, spans): the rule versions that a scan ran on a blob, and all that they found.

    Rows are whole in themselves, so a write that fails half-way or is repeated leaves a ledger that is right.
    """

    SCHEMA = f"blob string, rules array<string>, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def pending(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, todo): distinct blobs and the rule versions that haven't scanned them."""
        names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...], few: int = 100_000) -> None:
        """Scan what is pending of ``versions`` (blob, text) and add it to the ledger.

        Copies of a blob become one before and after the shuffle.  If ``few`` blobs or fewer are pending, the texts of all others
        don't enter it.
        """
        pending = stage(self.pending(versions, rules), "secret-pending")
        n = pending.count()
        if not n:
            return
        if n <= few:
            versions = versions.join(F.broadcast(pending.select("blob")), "blob", "left_semi")  # at most ``few`` names
        once = versions.groupBy("blob").agg(F.first("text").alias("text"))
        found = once.join(pending.hint("merge"), "blob").select("blob", "text", "todo").mapInArrow(_scanner(rules), self.SCHEMA)
        found.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, spans) of each blob in which any of ``rules``, at its version, found something."""
        wanted = [r.name for r in rules]
        spans = self.rows().select("blob", F.filter("spans", lambda s: s["rule"].isin(wanted)).alias("spans")).where(F.size("spans") > 0)
        return spans.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` (a text column and any others, such as path and commit) with its blob and spans.

    Spans are (first, order of its rule, past, kind) in that order, places in code points, the end exclusive; none: an empty array.
    Columns of ``versions`` named blob or spans are replaced.  A null text is the empty blob.  Bytes that aren't UTF-8 count as one
    replacement character each, as Python decodes them.  Texts of any length are scanned whole, by one task each.
    """
    addressed = versions.drop("blob", "spans").withColumn("blob", blob_id(F.col("text")))
    ledger.scan(addressed.select("blob", "text"), rules)
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), order[s["rule"]].alias("no"), s["past"].alias("past"), kind[s["rule"]].alias("kind"))))
    found = ledger.findings(rules).select("blob", spans.alias("spans"))
    none = F.array().cast("array<struct<first:long,no:int,past:long,kind:string>>")
    keep = [f"`{c}`" for c in addressed.columns if c != "text"]
    return addressed.join(found, "blob", "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["past"].cast("string"))), ",")


def op12_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, scanned once for each distinct text by a ledger that this run begins.

    Null and empty texts have none; rows with one id, and rows without, are reported each.  An empty table gives no row.
    Other columns have no part.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_versions(docs, Ledger(spark, new_path(spark, "secret-ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["no"] < len(BASE_RULES))
    return out.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _spans_sql(no: int, rule: Rule) -> str:
    """(doc_id, first, no, past, kind): a match begins after all that was split off or matched before it."""
    pattern = ("(?i)" if rule.any_case else "") + rule.tight.replace(r"\x20", " ").replace("'", "''")
    return f"""SELECT doc_id, k, {no} AS no, '{rule.kind}' AS kind, length(m[k]) AS size, length(g[k]) AS least, {rule.least} AS wanted,
  list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS first
FROM (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, m, g, gaps FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, regexp_split_to_array(t, '{pattern}') AS gaps FROM docs)
)"""


def _sql() -> str:
    spans = "\nUNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(RULES))
    base = [f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES]
    item = "kind || ':' || first::BIGINT || ':' || (first + size)::BIGINT"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT * FROM ({spans}) WHERE least >= wanted)
SELECT doc_id, {", ".join(base)},
  sha256(coalesce(string_agg({item}, ',' ORDER BY first, no) FILTER (no < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY first, no) FILTER (no IS NOT NULL), '') AS spans
FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""


OP12_SQL = _sql()
