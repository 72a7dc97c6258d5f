"""Language identification with a bit-sliced Bloom filter of character n-grams.

The filter is one array of slots; bit L of every slot belongs to language L, so the AND of an
n-gram's slots is the mask of all languages that contain it.  A text's score for a language is the
number of its n-grams whose mask has that bit, corrected for the language's false positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import in_fold, raw_texts
from loomgraph.runtime import table

PROBES = 3
WORD = 62  # languages in one mask word, a signed 64-bit number


def ngrams(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams of letters and the spaces between words; others count as spaces."""
    s = "".join(c if c.isalpha() else " " for c in text.decode("utf-8", "replace").lower()) if len(text) < 64 else None
    if s is None:
        s = text.decode("utf-8", "replace").lower().translate(_TO_SPACE)
    codes = np.frombuffer(f" {' '.join(s.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < size:
        codes = np.concatenate([codes, np.full(size - len(codes), 32, np.uint64)])
    if not (codes != 32).any():
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - size + 1, np.uint64)
        for i in range(size):
            h = (h ^ codes[i : len(codes) - size + 1 + i]) * np.uint64(0x100000001B3F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class _Spaces(dict):
    """Translation table that sends every character but letters to a space; filled as characters occur."""

    def __missing__(self, code):
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_TO_SPACE = _Spaces()


def _slots(h: np.ndarray, bits: int):
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((h + np.uint64(i) * step) >> np.uint64(5)) & np.uint64((1 << bits) - 1) for i in range(PROBES)]


def _distinct(batches, size: int):
    """(number, text) to (gram, number), distinct within a batch."""
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for number, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            by.setdefault(number, []).append(ngrams(text, size))
        for number, parts in by.items():
            grams = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), number, np.int32))], ["gram", "number"])


def _set_slots(batches, bits: int):
    """(gram, number of a language that holds it) to (slot, word, mask), one row for each slot of a batch."""
    for batch in batches:
        grams = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        number = batch.column(1).to_numpy(zero_copy_only=False)
        for lang in np.unique(number):
            slot = np.unique(np.concatenate(_slots(grams[number == lang], bits))).view(np.int64)
            word, bit = divmod(int(lang), WORD)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), word)), pa.array(np.full(len(slot), 1 << bit))], ["slot", "word", "mask"])


def train_filter(
    docs: DataFrame, keep: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", size: int = 5, bits: int = 20, per_language: int = 4000
) -> dict:
    """Fit the filter on about ``per_language`` whole texts a language at most, chosen by hash of id and text.

    A language's bit is set for every n-gram that occurs in its texts.  There is a word of 62 languages for each
    62, and each has 2**bits slots whatever the input, so the filter may be broadcast; only it and one row a
    language come to the driver.
    """
    given = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r.lang: r.n for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    slots = np.zeros((-(-len(langs) // WORD), 1 << bits), np.int64)
    if not langs:
        return {"langs": [], "size": size, "bits": bits, "slots": slots, "rates": [], "prior": None}
    known = docs.sparkSession.createDataFrame([(x, i, min(1.0, per_language / counts[x])) for i, x in enumerate(langs)], "lang string, number int, share double")
    draw = F.shiftrightunsigned(F.xxhash64("id", "text"), 1) / F.lit(float(1 << 63))
    sample = given.join(F.broadcast(known), "lang").where(draw < F.col("share")).select("number", "text")
    grams = sample.mapInArrow(lambda x: _distinct(x, size), "gram long, number int").distinct()
    got = grams.mapInArrow(lambda x: _set_slots(x, bits), "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2**bits rows a word at most
    slots[got.column(1).to_numpy(), got.column(0).to_numpy()] = got.column(2).to_numpy()
    rates = [float(np.mean((slots[i // WORD] >> (i % WORD)) & 1)) ** PROBES for i in range(len(langs))]
    prior = max(langs, key=lambda x: (counts[x], x))
    return {"langs": langs, "size": size, "bits": bits, "slots": slots, "rates": rates, "prior": prior}


def ngram_languages(grams: np.ndarray, model: dict) -> np.ndarray:
    """For each n-gram (column) the mask words (rows) of all languages that hold it: its slots' AND."""
    at = [s.view(np.int64) for s in _slots(grams, model["bits"])]
    return np.stack([np.bitwise_and.reduce([word[s] for s in at]) for word in model["slots"]])


def language_hits(text: bytes, model: dict) -> tuple[np.ndarray, int]:
    """Corrected hits for each language, and the number of n-grams."""
    grams = ngrams(text, model["size"])
    if not len(grams) or not model["langs"]:
        return np.zeros(len(model["langs"])), len(grams)
    mask = ngram_languages(grams, model)
    hits = np.array([np.count_nonzero(mask[i // WORD] & (1 << i % WORD)) for i in range(len(model["langs"]))], float)
    rates = np.array(model["rates"])
    return np.clip((hits - len(grams) * rates) / np.maximum(1 - rates, 1e-9), 0, None), len(grams)


def _decide(text: bytes, model: dict) -> tuple[str, float]:
    hits, n = language_hits(text, model)
    if not n or not model["langs"]:
        return "und", 0.0
    if hits.sum() <= 0:
        return model["prior"], 0.0
    best = int(hits.argmax())
    return model["langs"][best], float(hits[best] / hits.sum())


def _predict(batches, model):
    for batch in batches:
        got = [_decide(t, model.value) for t in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learnt from rows not held out.

    A null ``held_out`` is false.  Text that is null or has no letter is ``und`` with score 0, and so
    is all text if there is nothing to learn from; letters that no filter knows give the commonest
    language with score 0.  Ties go to the language that sorts first.  Any number of languages may be
    learnt.  Whole texts are read, however long.  Repeated rows are predicted alike, an empty table gives no
    row, other columns, ``fit``'s names among them, are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(train_filter(docs, ~held, id_col, lang_col, text_col, **fit))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        lambda x: _predict(x, model), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op2_language_bitmask(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not in fold 1 of 3; cases as in ``identify_languages``."""
    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), in_fold("doc_id", 3, 1))
