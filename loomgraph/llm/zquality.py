"""Quality scores from compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from texts labelled good, one from texts labelled bad.  The difference
of a text's compressed sizes, over its plain compressed size, becomes a probability by logistic
calibration on labelled texts that the dictionaries haven't seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fit_logistic, in_fold, logistic, raw_texts, sample_labelled
from loomgraph.runtime import table

#: Texts are compressed in pieces of so many bytes, so that a dictionary counts all along a long text.
PIECE = 4096


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """The most useful ``size`` bytes of the texts, or all of them where they are too few to choose from."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class SizeDifference:
    """Compressors are made once for each task."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_good, self.with_bad = (
            zstandard.ZstdCompressor(level=level, dict_data=self._of(d, level), write_content_size=False, write_dict_id=False) if d else self.plain
            for d in (good, bad)
        )

    @staticmethod
    def _of(data: bytes, level: int):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=level)
        return d

    def features(self, text: bytes) -> tuple[float, float]:
        """(bad - good) / plain over the whole text, and the larger pieces' least such value."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        sizes = np.array([[len(c.compress(p)) for c in (self.with_good, self.with_bad, self.plain)] for p in pieces], float)
        good, bad, plain = sizes.sum(0)
        return (bad - good) / plain, float(((sizes[:, 1] - sizes[:, 0]) / sizes[:, 2]).min())


def train_quality(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int = 1500, max_chars: int = 50_000, dict_bytes: int = 65536) -> dict:
    """Fit on at most about ``per_class`` labelled texts of each class, of ``max_chars`` characters at most.

    Null and empty texts aren't sampled; of labels that repeat for an id the greatest counts; with fewer than eight
    texts of a class no dictionary is built and every text scores the good share among the labels.
    """
    rows, counts = sample_labelled(docs, labels, label, keep, per_class, max_chars)
    by = {y: [t for t, z in rows if z == y] for y in (0, 1)}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if min(len(by[0]), len(by[1])) < 8:
        return {"good": b"", "bad": b"", "beta": None, "prior": prior}
    good, bad = (_dictionary(by[y][0::2], dict_bytes) for y in (1, 0))
    measure = SizeDifference(good, bad)
    rest = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    y = np.array([z for _, z in rest], float)
    x = np.array([measure.features(t) for t, _ in rest])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "beta": fit_logistic((x - mean) / scale, y, weight, ridge=1e-4), "prior": prior}


def quality_scores(texts: list[bytes], model: dict, measure: SizeDifference | None) -> np.ndarray:
    if model["beta"] is None or not texts:
        return np.full(len(texts), model["prior"])
    x = (np.array([measure.features(t) for t in texts]) - model["mean"]) / model["scale"]
    return logistic(x @ model["beta"][:-1] + model["beta"][-1])


def with_quality(docs: DataFrame, model: dict, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` and the score (double, 0 to 1) of each whole text, null counting as empty; all rows and columns stay.

    A text of any length is compressed whole, in pieces.  Repeated rows score alike and an empty table gives no row.  A column called like ``out`` is an error.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    known = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def score(batches):
        m = known.value
        measure = SizeDifference(m["good"], m["bad"]) if m["beta"] is not None else None
        for batch in batches:
            got = quality_scores(raw_texts(batch.column(text_col)), m, measure)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(score, docs.withColumn(out, F.lit(0.0)).schema)


def op3_compression_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels not in fold 0 of 5; cases as in ``with_quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold("doc_id", 5, 0)
    model = train_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", ~held_out)
    return with_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted")
    )
