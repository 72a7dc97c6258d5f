"""Column helpers shared by the operators: blanks, names, hashes, content groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by group, in the order in which groups are tried.
TEXT_TYPES = ["title", "subtitle", "text", "list", "reference", "caption", "code", "algorithm"]
TABLE_TYPES = ["table", "table_caption", "table_footnote", "sheet"]
VISION_TYPES = ["image", "figure", "chart", "seal", "image_caption"]
FORMULA_TYPES = ["equation", "inline_formula", "formula", "formula_caption", "formula_label"]
DISCARD_TYPES = ["header", "footer", "page_number", "footnote", "margin_note", "discarded"]
META_TYPES = ["header", "footer", "page_number", "footnote", "margin_note", "layout_region", "multi_column_region"]
GROUPS = {"text": TEXT_TYPES, "table": TABLE_TYPES, "vision": VISION_TYPES, "formula": FORMULA_TYPES, "discard": DISCARD_TYPES, "meta": META_TYPES}
# Routes of types, and types that no route takes.
ROUTES = {"text_pipeline": TEXT_TYPES, "table_pipeline": TABLE_TYPES, "vision_pipeline": VISION_TYPES, "equation_pipeline": FORMULA_TYPES, "discard_pipeline": DISCARD_TYPES}
IGNORED_TYPES = ["layout_region", "multi_column_region"]
# Relation types with another name.
RELATION_SYNONYMS = {k: "developed_by" for k in ("created_by", "made_by", "built_by", "authored_by", "developed_by")}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def content_group(kind: Column) -> Column:
    """The first group that lists a type, else unknown."""
    out = F.lit("unknown")
    for name, members in reversed(GROUPS.items()):
        out = F.when(kind.isin(members), F.lit(name)).otherwise(out)
    return out


def normalize_name(c: Column) -> Column:
    """Lower case without spaces and -_.:,;!?."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s\-_.:,;!?]", "")


def canonical_relation_type(c: Column) -> Column:
    """Normalised relation type, synonyms joined, related_to where blank.

    Normalising drops underscores too, so a synonym is one only if its normalised form is in the list.
    """
    t = normalize_name(c)
    # one look-up: a chain of tests would normalise the name anew for each
    named = F.create_map(*[F.lit(x) for kv in {"": "related_to", **RELATION_SYNONYMS}.items() for x in kv])
    return F.coalesce(F.try_element_at(named, t), t)


def short_sha1(seed: Column, n: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(seed.cast("binary")), 1, n))
