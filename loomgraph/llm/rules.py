"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a table: values fall into buckets whose bounds grow by a fixed factor, so a bucket's count
is all that is kept of it, sketches merge by adding counts, and a quantile is off by one per cent of its
value at most.  Each language and source has sketches of its own; thin ones fall back on their
language's.  Documents join their thresholds.

No threshold is a fixed value.  Word length has a fence of quartiles on both sides.  The other measures are
mostly zero, so that their tail counts: where a sketch has a wide empty stretch that parts off a
hundredth to a quarter of the texts, those are another kind of text and the limit lies in that stretch; else
it lies beyond the 99th percentile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import raw_texts, struct_name
from loomgraph.runtime import stage, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Growth of the buckets' bounds: quantiles are within 1 % of a value.
GAMMA = 1.02
#: Each measure, and whether it has a lower bound too.
MEASURES = {"symbols": False, "dup_lines": False, "repeats": False, "word_length": True}
#: Shares of a text that are no more than this count as none when stretches of a sketch are compared.
RESOLUTION = 0.02
#: A stretch parts kinds of text if its ends differ by this factor, with this share of texts beyond it.
STRETCH, LEAST_BEYOND, MOST_BEYOND = 8.0, 0.01, 0.25
#: How far beyond the 99th percentile a limit lies otherwise.
TAIL = 4 / 3


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        key = ids[:-2].astype(np.int64) << 42 | ids[1:-1].astype(np.int64) << 21 | ids[2:]
    else:
        key = np.unique(np.column_stack([ids[:-2], ids[1:-1], ids[2:]]), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.sort(key)
    twice = order[1:] == order[:-1]
    if not twice.any():
        return 0
    again = np.isin(key, order[1:][twice])
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measure_texts(texts: list[bytes]) -> np.ndarray:
    """A row of COUNTS for each text."""
    words = [t.split() for t in texts]
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    out, at = np.zeros((len(texts), len(COUNTS)), np.int64), 0
    for i, (text, ws) in enumerate(zip(texts, words, strict=True)):
        own = ids[at : at + len(ws)]
        at += len(ws)
        if len(ws):  # code points: bytes that don't continue a character, white space left out
            first, lines = np.unique(own, return_index=True)[0], [x for x in text.split(b"\n") if x and not x.isspace()]
            own = own if len(first) > 1 << 21 else np.searchsorted(first, own)
            bare = text.translate(None, SPACES)
            points = len(bare) if bare.isascii() else int(((np.frombuffer(bare, np.uint8) & 0xC0) != 0x80).sum())
            out[i] = len(ws), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(own), len(lines)
        else:
            out[i, 2] = len(text) - len(text.translate(None, SYMBOLS))
    return out


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and its texts' counts; the text is read once and no row or column is lost."""
    names = [prefix + c for c in COUNTS]
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(set(names) & set(docs.columns))} are there already")

    def count(batches):
        for batch in batches:
            got, texts = [], raw_texts(batch.column(text_col))
            part, size = [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > 2_000_000:
                    got.append(measure_texts(part))
                    part, size = [], 0
            got.append(measure_texts(part))
            rows = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(names)))], [*batch.schema.names, *names])

    return docs.mapInArrow(count, docs.withColumns({n: F.lit(0).cast("long") for n in names}).schema)


def _measures(prefix: str) -> dict[str, Column]:
    c = lambda n: F.col(prefix + n)
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def base_failed(prefix: str) -> Column:
    words = F.col(prefix + "n_words")
    return (words < 50) | (F.col(prefix + "n_repeat_words") * 100 > words * 50)


def sketch(counted: DataFrame, lang: Column, source: Column, prefix: str = "") -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch for each language, source and measure."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-(10**6)))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in _measures(prefix).items()])
    return (
        counted.where(~base_failed(prefix))
        .select(lang.alias("lang"), source.alias("source"), F.inline(pairs))
        .groupBy("lang", "source", "measure", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _value() -> Column:
    """A bucket's middle; within 1 % of every value in it."""
    return F.when(F.col("bucket") <= -(10**6), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * F.lit(2 / (GAMMA + 1)))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles of merged sketches, and ``break``: the middle of the widest stretch that parts off a kind of
    text, null without one.  A group's window holds its buckets, a few hundred at most."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    running = merged.select(
        *keys, "measure", _value().alias("value"), F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("all"), F.lead(_value()).over(w.orderBy("bucket")).alias("next")
    )
    low, high = F.greatest("value", F.lit(RESOLUTION)), F.greatest("next", F.lit(RESOLUTION))
    beyond = 1 - F.col("upto") / F.col("all")
    parts = (high >= low * STRETCH) & (beyond >= LEAST_BEYOND) & (beyond <= MOST_BEYOND)
    return running.groupBy(*keys, "measure").agg(
        F.max("all").alias("rows"),
        F.max_by(F.when(parts, F.sqrt(low * high)), F.when(parts, high / low)).alias("break"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("value"))).alias(n) for n, q in at.items()],
    )


def thresholds(sketches: DataFrame, least_rows: int = 200, reach: float = 6.0) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high).

    Two-sided measures: the quartiles, moved out by ``reach`` times their distance and by ten buckets at least.
    One-sided ones: the break if there is one, else ``TAIL`` times the 99th percentile or the resolution.  A language
    and source with fewer than ``least_rows`` texts takes its language's thresholds.
    """
    at = {"q25": 0.25, "q75": 0.75, "q99": 0.99}
    spread = (F.col("q75") - F.col("q25")) * reach
    two_sided = F.col("measure").isin([m for m, both in MEASURES.items() if both])
    tail = F.coalesce("break", F.greatest("q99", F.lit(RESOLUTION)) * TAIL)
    fences = lambda df: df.select(
        *[c for c in df.columns if c not in (*at, "break")],
        F.when(two_sided, F.greatest(F.col("q75") + spread, F.col("q75") * GAMMA**10)).otherwise(tail).alias("high"),
        F.when(two_sided, F.least(F.col("q25") - spread, F.col("q25") / GAMMA**10)).otherwise(F.lit(-1.0)).alias("low"),
    )
    own, by_lang = fences(quantiles(sketches, ["lang", "source"], at)), fences(quantiles(sketches, ["lang"], at))
    both = own.join(by_lang.select("lang", "measure", F.col("low").alias("l_low"), F.col("high").alias("l_high")), ["lang", "measure"])
    thin = F.col("rows") < least_rows
    picked = both.withColumn("low", F.when(thin, F.col("l_low")).otherwise(F.col("low"))).withColumn("high", F.when(thin, F.col("l_high")).otherwise(F.col("high")))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return picked.groupBy("lang", "source").agg(*[pick(m, c) for m in MEASURES for c in ("low", "high")])


def judged(counted: DataFrame, limits: DataFrame, lang: Column, source: Column, prefix: str = "", out: str = "kept") -> DataFrame:
    """``counted`` and its verdict: false if the base rules fail or a measure is outside its thresholds.

    ``lang`` and ``source`` are expressions over ``counted``.  A group without thresholds has only base rules.
    """
    own = struct_name(counted.columns, "limit")
    limits = limits.select(F.col("lang").alias(f"{own}_lang"), F.col("source").alias(f"{own}_source"), F.struct(*[c for c in limits.columns if c not in ("lang", "source")]).alias(own))
    joined = counted.join(limits, (lang == F.col(f"{own}_lang")) & (source == F.col(f"{own}_source")), "left")
    outside = F.lit(False)
    for m, v in _measures(prefix).items():
        outside = outside | F.coalesce((v > F.col(f"{own}.{m}_high")) | (v < F.col(f"{own}.{m}_low")), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns], (~(base_failed(prefix) | outside)).alias(out))


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prefix: str = "rule_", carry_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with its counts, ``<prefix>base_failed`` and ``<prefix>kept``.

    Thresholds come from all rows that pass the base rules.  Null text has no words and fails; a null
    language or source is the group ''.  Repeated rows count each time and share a verdict; a value on a
    limit is inside.  Whole texts are read, however long.  An empty table gives no row.  Existing columns stay;
    a clash with an added name is an error, for which ``prefix`` is there.
    ``carry_text=False`` leaves the text out and stages the counts, so that texts are measured once.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    counted = with_counts(docs, text_col, prefix)
    if not carry_text:
        counted = stage(counted.drop(text_col), "rule-counts")
    limits = stage(thresholds(sketch(counted, lang, source, prefix)), "rule-thresholds")
    return judged(counted, limits, lang, source, prefix, f"{prefix}kept").withColumn(f"{prefix}base_failed", base_failed(prefix))


def op9_adaptive_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under its language's and source's thresholds; cases as in ``apply_rules``."""
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry_text=False)
    return out.select("doc_id", *[F.col(f"rule_{c}").alias(c) for c in (*COUNTS[:5], "base_failed", "kept")])
