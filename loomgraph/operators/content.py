"""Document blocks: normalising, filtering, routing, merging and chunking."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import DISCARD_TYPES, IGNORED_TYPES, ROUTES, TEXT_TYPES, blank_to_null, content_group, first_filled, short_sha1


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Block id, type, text, page and box from whichever field holds them (C1).  Needs doc_id and seq."""
    c = lambda n, k="string": _col(blocks, n, k)
    box = c("bbox", "array<double>")
    return blocks.select(
        "doc_id", "seq",
        F.coalesce(first_filled(c("block_id"), c("id"), c("item_id")), F.concat(F.lit("mineru_block_"), F.col("seq").cast("string"))).alias("block_id"),
        F.coalesce(F.lower(blank_to_null(c("type"))), F.lit("unknown")).alias("type"),
        F.coalesce(first_filled(c("text"), c("content"), c("table_body"), c("latex")), F.lit("")).alias("text"),
        F.coalesce(c("page_idx", "int"), F.lit(0)).alias("page"),
        F.when(F.size(box) >= 4, F.slice(box, 1, 4)).alias("bbox"),
    )


def is_empty(df: DataFrame) -> Column:
    """Emptiness by group."""
    none = lambda n: blank_to_null(_col(df, n)).isNull()
    g = content_group(F.col("type"))
    return (
        F.when(g == "text", none("text")).when(g == "table", none("table_body")).when(g == "vision", none("img_path"))
        .when(g == "formula", none("latex") & none("text")).otherwise(none("text") & none("table_body") & none("img_path") & none("latex"))
    )


def mark_dropped(blocks: DataFrame, keep_types=(), drop_types=(), min_text_length: int = 0, drop_empty: bool = True, keep_page_numbers: bool = True) -> DataFrame:
    """``drop_reason``: the first rule that drops a block, null if it stays."""
    t = F.col("type")
    rules = [
        (~t.isin(*keep_types) if keep_types else F.lit(False), "not_kept_type"),
        (F.lit(not keep_page_numbers) & (t == "page_number"), "page_number"),
        (t.isin(*drop_types) if drop_types else F.lit(False), "dropped_type"),
        (t.isin(TEXT_TYPES) & F.lit(min_text_length > 0) & (F.length(F.trim(F.coalesce(_col(blocks, "text"), F.lit("")))) < min_text_length), "short_text"),
        (F.lit(drop_empty) & is_empty(blocks), "empty"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(rules):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return blocks.withColumn("type", F.coalesce(F.lower(blank_to_null(t)), F.lit("unknown"))).withColumn("drop_reason", reason)


def filter_blocks(blocks: DataFrame, **rules) -> DataFrame:
    return mark_dropped(blocks, **rules).where("drop_reason is null").drop("drop_reason")


def filter_summary(marked: DataFrame) -> DataFrame:
    """Counts before, kept and dropped per type (C4)."""
    return marked.groupBy("type").agg(F.count("*").alias("before"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"))


def route_blocks(blocks: DataFrame, routes: dict[str, list[str]] | None = None, ignore=IGNORED_TYPES, discard=DISCARD_TYPES, drop_discard: bool = True, keep_unrouted: bool = True) -> DataFrame:
    """``pipeline``: the first route that lists a block's type."""
    t = F.col("type")
    out = F.lit("unrouted")
    for name, members in reversed((routes or ROUTES).items()):
        out = F.when(t.isin(members), F.lit(name)).otherwise(out)
    kept = blocks.where(~t.isin(*ignore))
    if drop_discard:
        kept = kept.where(~t.isin(*discard))
    kept = kept.withColumn("pipeline", out)
    return kept if keep_unrouted else kept.where("pipeline != 'unrouted'")


def route_summary(blocks: DataFrame, routed: DataFrame) -> DataFrame:
    """(what, name, n): totals per route and type, ignored and discarded."""
    t = F.col("type")
    kind = F.when(t.isin(IGNORED_TYPES), "ignored").when(t.isin(DISCARD_TYPES), "discarded")
    return (
        routed.groupBy(F.lit("route").alias("what"), F.col("pipeline").alias("name")).agg(F.count("*").alias("n"))
        .unionAll(routed.groupBy(F.lit("type"), "type").agg(F.count("*")))
        .unionAll(blocks.where(kind.isNotNull()).groupBy(F.lit("left_out"), kind).agg(F.count("*")))
    )


def attach_descriptions(blocks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The first description (by pos) of a block's document, type and page."""
    keys = ["doc_id", "type", "page_idx"]
    first = descriptions.groupBy(*keys).agg(F.min_by("description", "pos").alias("description"))
    return blocks.join(first, keys, "left")


def resolve_description(blocks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Own text, else a description by type, page and path, else by type and page."""
    path = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))
    d = descriptions.withColumn("_path", path(F.col("img_path")))
    exact = d.groupBy("doc_id", "type", "page_idx", "_path").agg(F.min_by("description", "pos").alias("_exact"))
    page = d.groupBy("doc_id", "type", "page_idx").agg(F.min_by("description", "pos").alias("_page"))
    got = blocks.withColumn("_path", path(F.col("img_path"))).join(exact, ["doc_id", "type", "page_idx", "_path"], "left").join(page, ["doc_id", "type", "page_idx"], "left")
    return got.withColumn("description", F.coalesce(blank_to_null(F.col("text")), "_exact", "_page")).drop("_path", "_exact", "_page")


# Fixed value: lines that state a rule or open a step stand alone.
BOUNDARY = re.compile(r"^\s*\d+[\.\、]\s*|工序\s*[:：]|步骤\s*[:：]|阶段\s*[:：]|状态\s*[:：]|应满足|不得|必须|应当|严禁|≤|≥|不小于|不大于|不超过|不少于", re.M)
# Fixed value: names of process steps that, alone on a line, open a step.
STEP_HEAD = re.compile(r"^\s*(?:粗加工|精加工|热处理|表面处理|装配|检验|试车|铆接|制孔|焊接|喷涂|包装)\s*$")


def merge_semantic_blocks(routed: DataFrame, token_limit: int = 2048, same_page: bool = True, guard_atomic: bool = True, guard_rules: bool = True, order=tuple(ROUTES)) -> DataFrame:
    """Merge runs of text blocks of a document (C9): one state machine over each document's sorted flags and lengths.

    Sorted rows stream through a task whose memory holds a batch and the open group's state, however many blocks a document has; only
    ids, flags and lengths enter it.  Texts join back and concatenate in Spark.  Returns doc_id,
    group_no, semantic_type, pipeline, text, source_block_ids and page_range.
    """
    limit = max(256, token_limit)
    rank = F.lit(len(order))
    for i, name in enumerate(order):
        rank = F.when(F.col("pipeline") == name, F.lit(i)).otherwise(rank)
    text = F.coalesce(F.trim("text"), F.lit(""))
    g = content_group(F.col("type"))
    head = F.col("type").isin("title", "subtitle")
    flagged = routed.select(
        "doc_id", "seq", "block_id", "type", "pipeline", F.coalesce("page_idx", F.lit(-1)).alias("page_idx"), text.alias("text"),
        rank.alias("rank"), F.length(text).alias("chars"), head.alias("head"), g.isin("table", "vision", "formula").alias("atomic"),
        (g == "text").alias("mergeable"), (~head & (g == "text") & (text.rlike(f"(?m){BOUNDARY.pattern}") | text.rlike(STEP_HEAD.pattern))).alias("boundary"),
    )

    def run(batches):
        """Rows come document by document, in order; only the open group's state goes from row to row and batch to batch."""
        doc, last, no, pos, now, kind, size = object(), None, -1, 0, None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["doc_id"] != doc:
                    doc, last, no, pos, now, kind, size = r["doc_id"], None, -1, 0, None, None, 0
                fresh = None
                if guard_atomic and r["atomic"]:
                    fresh, keep = "atomic", None
                elif guard_rules and r["boundary"]:
                    fresh, keep = "industrial_segment", None
                elif r["head"]:
                    fresh = keep = "section"
                elif not r["mergeable"]:
                    fresh, keep = "standalone", None
                elif (
                    now and last and r["pipeline"] == last["pipeline"] and r["seq"] == last["seq"] + 1
                    and not (same_page and r["page_idx"] >= 0 and last["page_idx"] >= 0 and r["page_idx"] != last["page_idx"])
                    and (size + (2 if size and r["chars"] else 0) + r["chars"]) // 2 <= limit
                ):
                    size += (2 if size and r["chars"] else 0) + r["chars"]
                    if kind != "section":
                        kind = "list_block" if r["type"] == "list" else "paragraph_run"
                else:
                    fresh = keep = "paragraph_run"
                if fresh:
                    no, kind, now, size = no + 1, fresh, keep, r["chars"]
                last = r
                out.append((pos, no, kind))
                pos += 1
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string())]
            given = [batch.column(c) for c in ("doc_id", "block_id", "seq")]
            yield pa.RecordBatch.from_arrays([*given, *made], ["doc_id", "block_id", "seq", "pos", "group_no", "kind"])

    schema = f"doc_id {dict(routed.dtypes)['doc_id']}, block_id string, seq {dict(routed.dtypes)['seq']}, pos int, group_no int, kind string"
    in_order = flagged.drop("text").repartition("doc_id").sortWithinPartitions("doc_id", "rank", "seq", "block_id")
    groups = in_order.mapInArrow(run, schema)
    return (
        groups.join(flagged.select("doc_id", "block_id", "seq", "text", "pipeline", "page_idx"), ["doc_id", "block_id", "seq"])
        .groupBy("doc_id", "group_no")
        .agg(
            F.max_by("kind", "pos").alias("semantic_type"), F.min_by("pipeline", "pos").alias("pipeline"),
            F.array_sort(F.collect_list(F.struct("pos", "block_id", "text", "page_idx"))).alias("_b"),
        )
        .select(
            "doc_id", "group_no", "semantic_type", "pipeline",
            F.array_join(F.filter(F.col("_b.text"), lambda x: x != ""), "\n\n").alias("text"),
            F.col("_b.block_id").alias("source_block_ids"),
            F.array_sort(F.array_distinct(F.filter(F.col("_b.page_idx"), lambda x: x >= 0))).alias("page_range"),
        )
    )


def select_chunk_text(df: DataFrame) -> Column:
    """Text to chunk by group: the first filled field of its list; vision takes the description."""
    c = lambda n: _col(df, n)
    g = content_group(F.col("type"))
    return (
        F.when(g == "table", first_filled(c("table_body"), c("text"), c("description")))
        .when(g == "vision", first_filled(c("description"), c("text")))
        .when(g == "formula", first_filled(c("latex"), c("text"), c("description")))
        .otherwise(first_filled(c("text"), c("content")))
    )


def chunk_by_tokens(df: DataFrame, text_col: str = "text", size: int = 1200, overlap: int = 100, split_by: str | None = None, only: bool = False) -> DataFrame:
    """Windows of ``size`` tokens with stride size - overlap; rows of chunk_index, chunk_text and tokens (C11).

    A token is a run of non-space characters.  ``split_by`` cuts first; with ``only`` pieces aren't cut again.
    """
    pieces = F.split(F.col(text_col), f"\\Q{split_by}\\E") if split_by else F.array(F.col(text_col))
    stride = size - overlap
    words = lambda piece: F.filter(F.split(piece, r"\s+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride)) if not only else F.array(F.lit(0))
    part = lambda w, at: w if only else F.slice(w, at + 1, size)
    filled = F.filter(F.transform(pieces, words), lambda w: F.size(w) > 0)
    parts = F.flatten(F.transform(filled, lambda w: F.transform(starts(w), lambda at: part(w, at))))
    # a row's pieces are numbered where they are made: nothing is shuffled, whatever columns the frame has
    cut = df.select("*", F.posexplode(parts).alias("chunk_index", "_part"))
    return cut.withColumn("chunk_text", F.array_join("_part", " ")).withColumn("tokens", F.size("_part")).drop("_part")


def chunk_id(pipeline: Column, source_item: Column, index: Column, text: Column) -> Column:
    """C12."""
    return short_sha1(F.concat_ws("|", pipeline, source_item, index.cast("string"), F.substring(F.sha1(text.cast("binary")), 1, 16)), 24, "chunk_")


def record_id(pipeline: Column, kind: Column, page: Column, index: Column, text: Column) -> Column:
    return short_sha1(F.concat_ws("|", pipeline, kind, page.cast("string"), index.cast("string"), F.substring(F.sha1(text.cast("binary")), 1, 16)), 24, "emb_")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("pipeline", F.col("type").alias("content_type")).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))  # C13


def embedding_text(df: DataFrame) -> Column:
    """Text to embed by group (C14)."""
    c = lambda n: _col(df, n)
    g = content_group(F.col("type"))
    described = F.when(blank_to_null(c("description")).isNotNull(), F.concat(F.lit("\n[vision_desc] "), F.trim(c("description")))).otherwise(F.lit(""))
    page = F.coalesce(c("page_idx").cast("string"), F.lit("?"))
    return (
        F.when(g == "table", F.concat(F.coalesce(first_filled(c("table_body"), c("text")), F.lit("")), described))
        .when(g == "vision", F.coalesce(first_filled(c("description"), c("text")), F.concat(F.lit("Image on page "), page)))
        .when(g == "formula", F.coalesce(first_filled(c("latex"), c("text"), c("description")), F.concat(F.lit("Formula on page "), page)))
        .otherwise(first_filled(c("text"), c("content")))
    )


def embedding_records(chunks: DataFrame, strategies: dict[str, str], disabled=("discard_pipeline",)) -> DataFrame:
    """Records with an id and their pipeline's strategy; disabled pipelines and blank texts are left out."""
    known = F.create_map(*[F.lit(x) for kv in strategies.items() for x in kv]) if strategies else F.create_map()
    kept = chunks.where(~F.col("pipeline").isin(*disabled)).withColumn("embed_text", embedding_text(chunks)).where(blank_to_null(F.col("embed_text")).isNotNull())
    return kept.withColumn("strategy", known[F.col("pipeline")]).withColumn("record_id", record_id(F.col("pipeline"), F.col("type"), F.col("page_idx"), F.col("chunk_index"), F.col("embed_text")))


def embed(df: DataFrame, fn, text_col: str = "embed_text", batch: int = 16) -> DataFrame:
    """``vector`` from a user's function of a list of texts, for rows without one."""

    def run(parts):
        for pdf in parts:
            pdf = pdf.copy()
            todo = pdf.index[pdf["vector"].isna()]
            vectors = [v for i in range(0, len(todo), batch) for v in fn(pdf.loc[todo[i : i + batch], text_col].tolist())]
            pdf["vector"] = pdf["vector"].astype(object)
            for i, v in zip(todo, vectors, strict=True):
                pdf.at[i, "vector"] = [float(x) for x in v]
            yield pdf

    given = df if "vector" in df.columns else df.withColumn("vector", F.lit(None).cast("array<float>"))
    return given.mapInPandas(run, given.schema)


def resume_vectors(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The latest stored vector of each record id, null for the rest (C17)."""
    return records.join(stored.groupBy("record_id").agg(F.max_by("vector", "written_at").alias("vector")), "record_id", "left")


def context_window(blocks: DataFrame, pages: int = 1, max_tokens: int = 2000, mode: str = "page") -> DataFrame:
    """Text around each non-text block: within so many pages, or so many blocks, up to a token bound."""
    text = blocks.where(content_group(F.col("type")) == "text").select("doc_id", F.col("seq").alias("_s"), F.col("page_idx").alias("_p"), F.col("text").alias("_t"))
    target = blocks.where(content_group(F.col("type")).isin("table", "vision", "formula")).select("doc_id", "seq", "page_idx")
    if mode == "page":
        # a page joins its neighbours by equality, not by a range
        target = target.withColumn("_p", F.explode(F.sequence(F.col("page_idx") - pages, F.col("page_idx") + pages)))
        near = target.join(text, ["doc_id", "_p"])
    else:
        target = target.withColumn("_s", F.explode(F.sequence(F.col("seq") - pages, F.col("seq") + pages)))
        near = target.join(text, ["doc_id", "_s"])
    w = W.partitionBy("doc_id", "seq").orderBy("_s")
    n = F.size(F.filter(F.split("_t", r"\s+"), lambda x: x != ""))
    near = near.withColumn("_n", F.sum(n).over(w)).where(F.col("_n") <= max_tokens)
    return near.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("_s", "_t"))).alias("_b")).select("doc_id", "seq", F.array_join("_b._t", "\n").alias("context"))


def rule_descriptions(df: DataFrame) -> Column:
    """A fallback sentence for a non-text block."""
    body = F.substring(F.coalesce(_col(df, "table_body"), F.lit("")), 1, 200)
    return F.when(content_group(F.col("type")) == "table", F.format_string("Table on page %s: %s", F.col("page_idx").cast("string"), body)).otherwise(F.format_string("%s on page %s", F.col("type"), F.col("page_idx").cast("string")))
