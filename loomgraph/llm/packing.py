"""Packing token sequences by patterns of few documents, fitted to the length histogram.

The histogram has as many bins as a sequence has tokens, whatever the input.  Patterns are the
pairs and triples of lengths that fill a sequence exactly; how often each is to be repeated is a
non-negative least-squares fit to the histogram, rounded down to what is there.  What is left is
placed by best fit, length by length.  Documents then take the places of the plan by their rank
among those of their length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.runtime import stage, table

TOKENIZER_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
SEPARATOR = 2
#: A space that no word follows; where a text has none, each space starts a new unit of the tokenizer.
LOOSE_SPACE = r" (?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|\z)"


class TokenBytes:
    """Texts to ids as little-endian unsigned 32-bit numbers, with the ids of words kept.

    The tokenizer joins a space to the word after it and never joins across that space, so a text
    in which every space precedes a word is encoded word by word, each distinct word once, from the
    same vocabulary's ranks.  Other texts, and those with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, ranks_path: str, most: int = 150_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def word(self, text: str) -> bytes:
        return array("I", self.words.encode_ordinary(text)).tobytes()

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        return list(self.each(texts))

    def each(self, texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[bytes]:
        """As ``batch``, text by text; memory is for runs of ``most_bytes``, or for one longer text."""
        texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most_bytes, side="right")))
            yield from self.run(texts.slice(a, b - a))
            a = b

    def run(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, LOOSE_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        at = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = array("I", self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids).tobytes()
        if not len(at):
            return out
        split = pc.split_pattern(texts.take(pa.array(at)), " ")
        starts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, distinct))
        for i, ids in enumerate(found):
            if ids is None:
                w = distinct[i]
                found[i] = self.known[w] = self.word(" " + w)
        heads = [self.word(distinct[i]) for i in index[starts[:-1]]]
        index[starts[:-1]] = len(distinct) + np.arange(len(heads))
        ids = pa.array(found + heads, pa.large_binary()).take(pa.array(index))
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][starts]
        data = memoryview(ids.buffers()[2] or b"")
        for i, a, b in zip(at, bounds[:-1], bounds[1:], strict=True):
            out[i] = bytes(data[a:b])
        return out


_ENCODERS: dict[str, TokenBytes] = {}  # of this Python process, which Spark uses for several tasks


def token_bytes(path: str, ranks_path: str) -> TokenBytes:
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenBytes(path, ranks_path)
    return _ENCODERS[path]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, tokenizer: tuple[str, str] | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the separator, cut into pieces.

    Texts of ``size`` ids or fewer are one piece; of longer ones the first piece takes what the whole
    pieces after it leave over.  ``tokenizer``: paths of the tokenizer's file and its ranks.
    """

    def cut(batches):
        encode = token_bytes(*(tokenizer or (public_tokenizer(TOKENIZER_FILE), public_tokenizer(RANKS_FILE))))
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.each(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % size or size
                view = memoryview(ids)
                at = [0, *range(first, n + 1, size)]
                out += [(doc, p, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )
        encode.known.clear()  # the process lives on for other tasks, which have words of their own

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(size: int) -> np.ndarray:
    """Pairs and triples of ascending lengths that sum to ``size``; a pair has length 0 in front."""
    i = np.arange(0, size // 3 + 1)
    pairs = [np.arange(max(1, a), (size - a) // 2 + 1) for a in i]
    first = np.repeat(i, [len(p) for p in pairs])
    second = np.concatenate(pairs)
    return np.column_stack([first, second, size - first - second])


def fit_patterns(histogram: np.ndarray, table_: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that make A x close to the histogram, by multiplicative updates."""
    size = len(histogram)

    def times(x):  # A x
        return sum(np.bincount(table_[:, c], weights=x, minlength=size) for c in range(3))

    def back(v):  # transposed A v, where length 0 is no document
        v = v.copy()
        v[0] = 0
        return v[table_].sum(1)

    b = histogram.astype(float)
    b[0] = 0
    x = back(b) / 9 + 1e-9
    up = back(b)
    for _ in range(rounds):
        x *= up / np.maximum(back(times(x)), 1e-9)
    return x


def plan_packing(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up ``histogram`` (index: length, up to ``size``) exactly."""
    left = histogram.astype(np.int64).copy()
    plan = []
    if left[size]:
        plan.append(((size,), int(left[size])))
        left[size] = 0
    if left.any():
        made = patterns(size)
        made = made[(left[made] > 0).sum(1) + (made == 0).sum(1) == 3]
        if len(made):
            repeats = fit_patterns(left[:size], made)
            for r in np.argsort(-repeats, kind="stable"):
                lengths = tuple(int(v) for v in made[r] if v)
                want = min(int(repeats[r] + 0.5), *(int(left[v]) // lengths.count(v) for v in lengths))
                if want > 0:
                    plan.append((lengths, want))
                    for v in lengths:
                        left[v] -= want
    # best fit, longest first, over bins of equal room: each entry of ``open_`` is (room, lengths, bins)
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room, lengths, bins):
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((lengths, bins))

    for v in range(size - 1, 0, -1):
        n = int(left[v])
        while n:
            k = bisect.bisect_left(rooms, v)
            if k == len(rooms):  # no bin has room: open bins with as many of this length as fit at once
                each = size // v
                if n >= each:
                    put(size - each * v, (v,) * each, n // each)
                    n -= n // each * each
                else:
                    put(size - n * v, (v,) * n, 1)
                    n = 0
                continue
            room = rooms[k]
            lengths, bins = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            used = min(n, bins)
            put(room - v, (*lengths, v), used)
            if bins > used:
                put(room, lengths, bins - used)
            n -= used
    plan += [(lengths, bins) for group in open_.values() for lengths, bins in group]
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length and rank its place: (length << 40 | first rank), first sequence, offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, repeats in plan:
        offset = 0
        for v in lengths:
            r = rank.get(v, 0)
            rows.append((v << 40 | r, sequence, offset))
            rank[v] = r + repeats
            offset += v
        sequence += repeats
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Every piece of every text with its sequence and offset; no sequence is over ``size`` ids.

    Null text is empty: its one id is the separator.  A text of any length is cut into pieces.  Repeated rows are packed each for itself,
    null ids stay null, an empty table gives no row, other columns are ignored.
    """
    pieces = stage(tokenize_pieces(docs, id_col, text_col, size, tokenizer), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # ``size`` rows at most
        histogram[r.length] = r.n
    spread = max(1, int(histogram.max()) // 20_000 + 1)  # ranks are counted in so many parts of a length
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(spread)).cast("int"))
    parts = stage(parts, "ranked-pieces")
    first = (
        parts.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n"))
        .select("length", "part", "before")
    )
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parts.withColumn("own", own).join(first, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    plan = docs.sparkSession.sparkContext.broadcast(places(plan_packing(histogram, size)))  # bounded by the histogram's bins

    def place(batches):
        keys, sequences, offsets = plan.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 ids; cases as in ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
