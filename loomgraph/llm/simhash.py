"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

Equal fingerprints are one node from the start.  Two fingerprints within two bits agree on at least
two of four 16-bit parts, so each is dealt to the six shards that pairs of parts name; a shard is a
BK-tree over its fingerprints, searched along the edges that the radius allows.  Shards larger than a bound
are cut up, and each piece's tree is sent to the pieces that come before it.  A shard returns links that
span its clusters, never all pairs; components are found over all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.components import connected_components
from loomgraph.llm.common import raw_texts
from loomgraph.runtime import stage, table

RADIUS, PARTS, PART_BITS = 2, 4, 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without a word."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` and each whole text's fingerprint as a signed long (the same 64 bits).

    Null text is empty, and a text without a word has fingerprint 0; a text of any length is read whole.  Repeated
    rows stay, an empty table gives no row; a column called like ``out`` is an error.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")

    def run(batches):
        for batch in batches:
            got = np.fromiter(map(fingerprint, raw_texts(batch.column(text_col))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], [*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0).cast("long")).schema)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    __slots__ = ("nodes",)

    def __init__(self, values=()):
        self.nodes: list[tuple[int, dict[int, int]]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        nodes = self.nodes
        if not nodes:
            nodes.append((value, {}))
            return
        at = 0
        while True:
            other, children = nodes[at]
            d = (value ^ other).bit_count()
            if d == 0:
                return
            if d not in children:
                children[d] = len(nodes)
                nodes.append((value, {}))
                return
            at = children[d]

    def within(self, value: int, radius: int):
        """Values of the tree at most ``radius`` bits away."""
        waiting = [0] if self.nodes else []
        while waiting:
            other, children = self.nodes[waiting.pop()]
            d = (value ^ other).bit_count()
            if d <= radius:
                yield other
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    waiting.append(children[edge])


def spanning_links(own: list[int], tree_of: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: among ``own`` if both lists are the same, else across."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    same = own is tree_of
    tree = BKTree() if same else BKTree(tree_of)
    for v in own:
        for other in tree.within(v, radius):
            a, b = find(v), find(other)
            if a != b:
                root[a] = b
                links.append((v, other))
        if same:
            tree.add(v)
    return links


def link_fingerprints(prints: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all within the radius.

    Fingerprints that repeat or are null have no part in links beyond the first; an empty table gives none.
    """
    part = [F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND((1 << PART_BITS) - 1) for i in range(PARTS)]
    keys = [
        F.struct(F.lit(n).alias("pair"), (part[i] * (1 << PART_BITS) + part[j]).alias("value"))
        for n, (i, j) in enumerate(combinations(range(PARTS), PARTS - RADIUS))
    ]
    dealt = prints.select("fp", F.inline(F.array(*keys)))
    sizes = dealt.groupBy("pair", "value").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / shard_rows).cast("int")
    members = dealt.join(sizes, ["pair", "value"]).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("fp"), pieces).cast("int"))
    # piece i meets the tree of every piece j >= i, in a task of bounded size: a member goes to (i, its piece) and (its piece, j)
    cells = members.select(
        "fp", "pair", "value", "piece",
        F.explode(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("piece")), lambda i: F.struct(i.alias("i"), F.col("piece").alias("j"))),
            F.filter(F.transform(F.sequence(F.col("piece"), F.col("pieces") - 1), lambda j: F.struct(F.col("piece").alias("i"), j.alias("j"))), lambda c: c["j"] > c["i"]),
        )).alias("cell"),
    ).select("fp", "pair", "value", "piece", "cell.i", "cell.j")

    def search(batches):
        def run(cell, rows):
            if cell[2] == cell[3]:
                own = sorted(f for f, _ in rows)
                return spanning_links(own, own, RADIUS)
            return spanning_links(sorted(f for f, p in rows if p == cell[2]), sorted(f for f, p in rows if p == cell[3]), RADIUS)

        now, rows = None, []
        for batch in batches:
            out = []
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for fp, piece, *cell in zip(fps, *(batch.column(c).to_pylist() for c in ("piece", "pair", "value", "i", "j")), strict=True):
                if cell != now:
                    if len(rows) > 1:
                        out += run(now, rows)
                    now, rows = cell, []
                rows.append((fp, piece))
            if out:
                yield _links(out)
        if len(rows) > 1 and (out := run(now, rows)):
            yield _links(out)

    key = ["pair", "value", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long")


def _links(links):
    a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*links, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(printed: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """(fp, component, component_id) of each distinct fingerprint: its component's least fingerprint and least id.

    Ids that are all null give a null component_id; texts without a word share fingerprint 0 and so a component.
    Repeated rows change nothing, an empty table gives no row.
    """
    prints = stage(printed.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first_id")), "prints")
    groups = connected_components(link_fingerprints(prints.select("fp")), "a", "b")
    grouped = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    grouped = stage(grouped, "print-groups")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return grouped.join(least, "component").select("fp", "component", "component_id")


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row; null text is empty, repeated rows each stay."""
    printed = stage(with_fingerprints(docs.select(id_col, text_col), text_col).drop(text_col), "fingerprints")
    groups = near_duplicates(printed, id_col)
    return printed.join(groups, F.col("fingerprint") == F.col("fp"), "left").select(
        F.col(id_col).alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document; cases as in ``dedup_table``."""
    return dedup_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
