"""The operators as pipeline stages: documents in, the same columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import in_fold, struct_name
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.raking import mix
from loomgraph.llm.rules import apply_rules
from loomgraph.llm.simhash import near_duplicates, with_fingerprints
from loomgraph.llm.zquality import train_quality, with_quality
from loomgraph.runtime import stage, table


def rules_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's and source's thresholds.

    Null and empty texts have no words and go; null languages and sources are groups of their own; equal rows pass or go together.
    """
    own = struct_name(docs.columns, "rule")
    return apply_rules(docs, prefix=f"{own}_").where(F.col(f"{own}_kept")).select(docs.columns)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more, by dictionaries from the labelled documents of the whole table.

    The rules keep next to no document labelled bad, so ``docs`` alone has nothing to learn bad texts from.
    """
    own = struct_name(docs.columns, "quality")
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~in_fold("doc_id", 5, 0))
    return with_quality(docs, model, out=own).where(F.col(own) >= 0.3).select(docs.columns)


def row_identity(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, so that different rows don't pass for one; maps, alone or nested, by their JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return [F.xxhash64(F.lit("a"), *cols), F.xxhash64(F.lit("b"), *reversed(cols))]


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least id's, or one without an id if none has any.

    Of a group's rows that share that id the one with the least ``row_identity`` stays, so that no row of another group takes its
    place; whole rows that are equal stay once.  Null and empty texts are alike, and one of them stays.  No rows give none.
    """
    own = struct_name(docs.columns, "fp")
    rows = [f"{own}_row_a", f"{own}_row_b"]  # two columns: the semi-join and the last step then share one shuffle of the texts
    hashed = docs.withColumns(dict(zip(rows, row_identity(docs), strict=True)))
    printed = stage(with_fingerprints(hashed.select("doc_id", "text", *rows), out=own).drop("text"), "fingerprints")
    groups = near_duplicates(printed, fp_col=own)
    member = printed.join(groups.select(F.col("fp").alias(own), "component"), own)
    first = member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *rows)).alias("r"))
    kept = first.select(*[F.col(f"r.{c}").alias(c) for c in rows]).distinct()
    return hashed.join(kept, rows, "left_semi").dropDuplicates(rows).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that follows the target weights.  Null and empty texts weigh nothing and go; rows with one id and text are drawn alike."""
    own = struct_name(docs.columns, "mix")
    return mix(docs, prefix=f"{own}_")[0].where(F.col(f"{own}_sampled")).select(docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; null and empty texts are a piece of one id, equal rows pieces each."""
    return pack_documents(docs)
