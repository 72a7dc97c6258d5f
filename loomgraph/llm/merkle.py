"""Operator 11: a Merkle manifest of a dataset, its proofs, and what tampering does to them.

Slot pivot: conditional aggregates spread the children of each parent into ``FANOUT`` columns; their concatenation is hashed
into the parent, and a child's siblings are the columns without its own slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import in_fold
from loomgraph.llm.sql import CRC32
from loomgraph.runtime import stage, table

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its UTF-8 byte count in front, so that no two rows of values read alike; null is ``-``."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(*[framed(c) for c in columns.values()])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place within the group from 0, and ``n``, the group's size; nulls come first.

    A range sort over all groups deals a large group out over many tasks; each task's rows of a group are a cell, and only
    cells, not rows, meet in a window.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    at = stage(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("_cell", F.shiftright("_at", 33))
    cells = at.groupBy(group, "_cell").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = W.partitionBy(group)
    cells = cells.select(
        group, "_cell", "_first",
        (F.sum("_rows").over(whole.orderBy("_cell")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("n"),
    )
    return at.join(cells, [group, "_cell"]).withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_cell", "_first", "_before")


def _nodes_at(level: int) -> Column:
    """Nodes of a group that are left ``level`` levels up."""
    return F.ceil(F.col("n") / F.lit(FANOUT**level)).cast("long")


class Tree:
    """Trees over the leaves of groups, ``levels`` levels to a shuffle and a table.

    ``nodes``: g (no nulls), i, n and h, and columns to carry to the leaves' proofs.
    """

    def __init__(self, nodes: DataFrame, levels: int = 3):
        self.levels, self.rounds, self.carried = levels, [], [c for c in nodes.columns if c not in ("g", "i", "n", "h")]
        most = nodes.agg(F.max("n")).first()[0] or 0
        now = nodes.select("g", "i", "n", F.struct("h", *self.carried).alias("x"))
        while True:
            self.rounds.append(stage(self._climbed(now), "merkle-level"))
            most = -(-most // FANOUT**levels)
            now = self.rounds[-1].select("g", "i", _nodes_at(levels).alias("n"), F.struct("x.h").alias("x"))
            if most <= 1:
                break
        self.roots = now.select("g", F.col("x.h").alias("h"))

    def _climbed(self, nodes: DataFrame) -> DataFrame:
        """One row for each node ``levels`` up; its struct ``x`` holds all nodes below.  One shuffle: every level's key begins with it."""
        parents = [F.floor(F.col("i") / F.lit(FANOUT**m)).cast("long").alias(f"p{m}") for m in range(self.levels, 0, -1)]
        now = nodes.select("g", "n", *parents, (F.col("i") % FANOUT).alias("slot"), "x").repartition("g", "n", f"p{self.levels}")
        for m in range(1, self.levels + 1):
            keys = ["g", "n", *[f"p{k}" for k in range(self.levels, m - 1, -1)]]
            slots = [F.max(F.when(F.col("slot") == s, F.col("x"))).alias(f"c{s}") for s in range(FANOUT)]
            one = F.col("c0.h")  # a group's only node goes up as it is
            several = F.sha2(F.concat_ws("", *[F.col(f"c{s}.h") for s in range(FANOUT)]), 256)
            up = F.when(_nodes_at(m - 1) > 1, several).otherwise(one)
            x = F.struct(up.alias("h"), *[f"c{s}" for s in range(FANOUT)])
            now = now.groupBy(*keys).agg(*slots).select(*keys, (F.col(f"p{m}") % FANOUT).alias("slot"), x.alias("x"))
        return now.select("g", "n", F.col(f"p{self.levels}").alias("i"), "x")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(g, i, h, carried columns, columns of ``above``, path) of every leaf.

        ``above``: g, path and any other columns, one row per group.  A path is the siblings (left, right) of each level, the
        leaf's own first; it goes from parent to children, so tables join once in ``levels`` levels.
        """
        extra = [c for c in above.columns if c not in ("g", "path")]
        down = None
        for below in reversed(self.rounds):
            if down is None:
                now = below.join(above, "g")
            else:
                now = below.join(down.select("g", "i", *extra, "path"), ["g", "i"])
            for m in range(self.levels, 0, -1):
                now = self._split(now, m, extra)
            down = now
        return down.select("g", "i", "n", "x.*", *extra, "path")

    def _split(self, rows: DataFrame, level: int, extra: list[str]) -> DataFrame:
        child = lambda s: F.col(f"x.c{s}")
        side = lambda slots: F.concat_ws("", F.lit(""), *[child(s)["h"] for s in slots])
        kids = F.array(
            *[F.struct(F.lit(s).alias("slot"), child(s).alias("x"), side(range(s)).alias("left"), side(range(s + 1, FANOUT)).alias("right")) for s in range(FANOUT)]
        )
        out = rows.select("g", "n", "i", "path", *extra, F.inline(kids)).where("x is not null")
        step = F.array(F.struct("left", "right"))
        path = F.when(_nodes_at(level - 1) > 1, F.concat(step, "path")).otherwise(F.col("path"))
        return out.select("g", "n", (F.col("i") * FANOUT + F.col("slot")).alias("i"), "x", *extra, path.alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each leaf with subroot, root and path: a tree for each group, and one over their roots, groups in UTF-8 order, null first.

    ``leaves`` has ``h`` and the columns that ``group`` and ``order`` name, which it should also be told apart by: equal rows stay as
    many leaves as they are, in any order, which changes no digest.  An empty table gives no row and has no root.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    tree = Tree(placed(leaves.withColumn("g", g), "g", order))
    tops = placed(tree.roots.select(F.lit("").alias("all"), F.col("g").alias("name"), "h"), "all", ["name"])
    top = Tree(tops.withColumnRenamed("all", "g"))
    root = top.roots.first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = top.proofs(top.roots.select("g", F.col("h").alias("root"), none.alias("path")))
    above = above.select(F.col("name").alias("g"), F.col("h").alias("subroot"), F.lit(root.h if root else None).cast("string").alias("root"), "path")
    return tree.proofs(above).drop("g", "i", "n")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, changed) with ``changed`` the leaf without the text's line ends where crc32(doc_id) is even, else null."""
    cols = {c: F.col(c) for c in FIELDS}
    cut = cols | {"text": F.translate("text", "\n", "")}
    return docs.select("doc_id", "source", leaf_digest(cols).alias("h"), F.when(in_fold("doc_id", 2, 0), leaf_digest(cut)).alias("changed"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, digest of the siblings, and the root that the tampered leaf folds to, of every document.

    Nulls in any column are ``-`` in the leaf; a null source is a group of its own and the first; null ids come first in it and
    are never tampered with.  Empty texts are values of no bytes.  Rows with one id follow each other by digest; equal rows are
    leaves each.  A table without rows gives no row.  Columns other than the five hashed ones have no part.
    """
    # digests are made once, before the sort samples its rows; the row's place parts equal rows among tasks
    leaves = stage(document_leaves(table(spark, sf_dir, "documents")).withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    out = manifest(leaves, "source", ["doc_id", "h", "tie"])
    back = folded(F.coalesce("changed", "h"), F.col("path"))
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _leaf_sql(text: str = "text") -> str:
    return "sha256(" + " || ".join(_framed_sql(c) for c in [*FIELDS[:-1], text]) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    """CTEs of a tree's nodes and of each node's siblings to the left and right."""
    return f"""{name}(k, g, i, n, h) AS (
  SELECT 0, g, i, n, h FROM {leaves}
  UNION ALL
  SELECT k + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, g, i // 3, n
), {name}_around AS (
  SELECT a.k, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.k, a.g, a.i
)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC32.format(keys="SELECT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL")},
docs AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE leaf END AS changed
  FROM (SELECT doc_id, source, lang, n_chars, text, coalesce('=' || source, '') AS g, {_leaf_sql()} AS leaf FROM documents) LEFT JOIN crc_of ON s = doc_id::VARCHAR
), leaves AS (
  SELECT doc_id, changed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM docs
), {_levels_sql("low", "leaves")},
tops AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
{_levels_sql("high", "tops")},
folds(doc_id, leaf, subroot, high, k, g, i, back, sibs) AS (
  SELECT doc_id, leaves.h, tops.h, 0, 0, leaves.g, leaves.i, changed, '' FROM leaves JOIN tops ON tops.name = leaves.g
  UNION ALL
  (SELECT f.doc_id, f.leaf, f.subroot, CASE WHEN step.up THEN 1 ELSE f.high END, CASE WHEN step.up THEN 0 ELSE f.k + 1 END,
          CASE WHEN step.up THEN '' ELSE f.g END, step.i, CASE WHEN step.up THEN f.back ELSE sha256(step.l || f.back || step.r) END, f.sibs || step.l || step.r
   FROM folds f JOIN (
     SELECT 0 AS high, k, g, i, i // 3 AS next, l, r, false AS up FROM low_around
     UNION ALL SELECT 1, k, g, i, i // 3, l, r, false FROM high_around
     UNION ALL SELECT 0, low.k, low.g, low.i, tops.i, '', '', true FROM low JOIN tops ON tops.name = low.g WHERE low.n = 1
   ) AS step(high, k, g, was, i, l, r, up) ON step.high = f.high AND step.k = f.k AND step.g = f.g AND step.was = f.i)
)
SELECT doc_id, leaf, subroot, high.h AS root, sha256(sibs) AS proof_sha256, back AS folded_root, back = high.h AS verified
FROM folds JOIN high ON folds.high = 1 AND high.n = 1 AND folds.k = high.k
"""
