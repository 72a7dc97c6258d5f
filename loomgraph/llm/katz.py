"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Texts are cut into tokens once.  A task packs them as *blocks* of some hundred thousand tokens: the block's distinct
words and each text as positions in that list.  Every later pass reads the block table, never the texts.

1. Each block lists its distinct n-grams of every order with their counts.  Lists are summed over the corpus and the
   sums come back to each block (``exchange``), which names one block as each n-gram's owner.
2. With the sums a block knows the discounted probability of each seen n-gram.  It keeps each text's sum, and lists
   the histories whose backoff weight an unseen token needs and, of the n-grams that it owns, each history's seen mass
   and the same words' mass one order lower.
3. These lists are summed by history in the same way; what comes back are the backoff weights.

For a text, P(w | h) is the discounted estimate at the longest order at which h w was seen, times the backoff weights
of the longer histories (a history that was never seen has 1): backoff goes on, order by order, for each token.

``exchange`` adds up lists that no task could hold together.  A list is cut into ranges of its sorted keys, and the
ranges of up to ``FAN`` lists are merged to one list of that range; merged lists are cut and merged again until each range
has one list.  Sums go down the same way.  A merge makes as many lists as it takes, so rows and bytes of each level
are in proportion to the input, and levels grow with its logarithm.  Up to ``FAN`` blocks there is one level.

``fit_katz`` writes the model as tables: counts (gram_order, gram, count) and weights (gram_order, history, log_weight),
both partitioned by order; ``score_katz`` scores other texts with them.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import in_fold, pack, pack_sorted, raw_texts, unpack, unpack_sorted
from loomgraph.runtime import discard, stage, table

END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xC2B2AE3D27D4EB4F)
MAX_COUNT = 5
#: Lists that one merge takes, about.
FAN = 256

BLOCK_SCHEMA = (
    "block long, ids array<long>, train array<boolean>, sizes binary, words binary, tokens binary, n_tokens long"
)
LIST_SCHEMA = "space int, prefix long, node long, keys binary, sums binary, asked binary"
PIECE_SCHEMA = "space int, prefix long, parent long, node long, keys binary, sums binary, asked binary"
ANSWER_SCHEMA = "kind int, space int, prefix long, node long, part long, answers binary, firsts binary, stats array<long>, keys binary"
PART_SCHEMA = "kind int, block long, ids array<long>, train array<boolean>, texts binary, needs binary, " + LIST_SCHEMA
SCORE_SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    with np.errstate(over="ignore"):
        h = left * np.uint64(0x9DDFEA08EB382D69) + right
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def encode_blocks(batches, block_tokens: int, group_tokens: int = 250_000):
    """(doc_id, text, train) batches to blocks."""
    part, serial = TaskContext.get().partitionId(), 0
    ids, train, sizes, hashes, total = [], [], [], [], 0
    words, waiting = [], 0

    def hashed():
        nonlocal words, waiting
        if words:
            coded = pa.array(words, pa.binary()).dictionary_encode()
            distinct = np.fromiter(
                (END if w == b"" else xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()),
                np.uint64,
                len(coded.dictionary),
            )
            hashes.append(distinct[coded.indices.to_numpy(zero_copy_only=False)])
        words, waiting = [], 0

    def block():
        nonlocal ids, train, sizes, hashes, total, serial
        hashed()
        known, local = np.unique(np.concatenate(hashes), return_inverse=True)
        out = pa.RecordBatch.from_pylist(
            [
                {
                    "block": part << 24 | serial,
                    "ids": ids,
                    "train": train,
                    "sizes": pack(np.array(sizes, np.int64)),
                    "words": pack_sorted(known),
                    "tokens": pack(local.astype(np.uint32)),
                    "n_tokens": total,
                }
            ],
            schema=pa.schema(
                [
                    ("block", pa.int64()),
                    ("ids", pa.list_(pa.int64())),
                    ("train", pa.list_(pa.bool_())),
                    ("sizes", pa.binary()),
                    ("words", pa.binary()),
                    ("tokens", pa.binary()),
                    ("n_tokens", pa.int64()),
                ]
            ),
        )
        ids, train, sizes, hashes, total, serial = [], [], [], [], 0, serial + 1
        return out

    for batch in batches:
        for doc, text, learn in zip(
            batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True
        ):
            tokens = text.lower().split()  # of bytes: ASCII letters and the six white-space bytes only
            tokens.append(b"")  # the end
            ids.append(doc)
            train.append(learn)
            sizes.append(len(tokens))
            words.extend(tokens)
            total += len(tokens)
            waiting += len(tokens)
            if waiting >= group_tokens:
                hashed()
            if total >= block_tokens:
                yield block()
    if ids:
        yield block()


def _read_block(row: dict):
    """Word hashes of all tokens, and the first position of each text with a last one past the end."""
    words = unpack_sorted(row["words"])
    sizes = unpack(row["sizes"], np.int64)
    tokens = words[unpack(row["tokens"], np.uint32)]
    return tokens, np.concatenate([[0], np.cumsum(sizes)])


def _grams(tokens: np.ndarray, starts: np.ndarray, order: int):
    """For each order its n-gram hash and its history's hash at every token, of 64 bits."""
    first = starts[:-1]
    grams, histories, before = [tokens], [None], START
    for _ in range(1, order):
        history = np.empty_like(tokens)
        history[1:] = grams[-1][:-1]
        history[first] = before
        grams.append(_mix(history, tokens))
        histories.append(history)
        before = _mix(np.array([before]), np.array([START]))[0]
    return grams, histories


def discounts(of_counts: list[int], k: int = MAX_COUNT) -> list[float]:
    """Discount factors of counts 1 to ``k`` and, last, what is taken from each larger count.

    Katz's formula over Good-Turing's r* = (r + 1) n(r+1) / n(r), where the counts of counts allow
    it (every factor between 0 and 1, from the largest ``k`` down); else the absolute discount
    n1 / (n1 + 2 n2).  Larger counts lose what count k loses, between 1/20 and 1/2 of a count, so that
    every history keeps mass to give and its weight is never zero.
    """
    n = [0, *of_counts]
    for top in range(k, 0, -1):
        if min(n[1 : top + 2]) <= 0:
            continue
        common = (top + 1) * n[top + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) for r in range(1, top + 1)]
        if all(0 < x < 1 for x in d):
            break
    else:
        loss = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        top, d = 1, [1 - min(0.95, max(0.05, loss))]
    taken = min(0.5, max(0.05, (1 - d[-1]) * top))
    d += [1 - min(taken, 0.5 * r) / r for r in range(top + 1, k + 1)]
    return [*d, taken]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    small = np.concatenate([[0.0], [r * x for r, x in enumerate(d[:-1], 1)]])
    return np.where(counts < len(small), small[np.minimum(counts, len(small) - 1)], counts - d[-1])


def hash_width(tokens: int) -> int:
    """Bits of a hash that tell about as many n-grams apart: 22 more than their number takes."""
    return min(64, max(40, int(tokens).bit_length() + 22))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _table(schema: str, rows: list[dict]) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields})


def _pack_lines(lines: np.ndarray) -> bytes:
    """Two lines of numbers; doubles each as distinct values and their places, of which few bytes differ."""
    if lines.dtype.kind == "i":
        return pack(lines.reshape(-1))
    parts = []
    for line in lines:
        values, place = np.unique(line, return_inverse=True)
        place = place.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32)
        for x in (values, place):
            data = pack(x)
            parts += [len(data).to_bytes(4, "little"), data]
    return b"".join(parts)


def _unpack_lines(data: bytes, n: int, dtype) -> np.ndarray:
    if np.dtype(dtype).kind == "i":
        return unpack(data, dtype).reshape(2, -1)
    parts, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : end])
        at = end
    lines = []
    for values, place in zip(parts[0::2], parts[1::2], strict=True):
        known = unpack(values, dtype)
        lines.append(known[unpack(place, np.uint16 if len(known) <= 1 << 16 else np.uint32)])
    return np.stack(lines) if lines and n else np.zeros((2, n), dtype)


def _list_row(space: int, prefix: int, node: int, keys: np.ndarray, sums: np.ndarray, asked: np.ndarray | None = None) -> dict:
    """A list as a row: ascending keys, two lines of ``sums``, and which keys want an answer (None: all)."""
    return {"space": space, "prefix": prefix, "node": node, "keys": pack_sorted(keys), "sums": _pack_lines(sums), "asked": None if asked is None else pack(np.packbits(asked))}


def _read_list(row: dict, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = unpack_sorted(row["keys"])
    asked = np.ones(len(keys), bool) if row["asked"] is None else np.unpackbits(unpack(row["asked"], np.uint8), count=len(keys)).astype(bool)
    return keys, _unpack_lines(row["sums"], len(keys), dtype), asked


def stored_lists(batches, dtype):
    """Rows of LIST_SCHEMA as (space, prefix, node, keys, sums, asked)."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, sums, asked = _read_list(row, dtype)
            yield row["space"], row["prefix"], row["node"], keys, sums, None if row["asked"] is None else asked


def split(lists, bits: int, shift: int, parents: int):
    """Lists to pieces of one range each: ``prefix`` takes ``bits`` more, which are the keys' bits from ``shift`` on."""
    for space, _, node, keys, sums, asked in lists:
        if not len(keys):
            continue
        ranges, start = np.unique(keys >> np.uint64(shift), return_index=True)
        parent = int(_mix(np.array([node]).astype(np.uint64), END)[0] % np.uint64(parents))
        out = []
        for r, a, b in zip(ranges.tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True):
            out.append(_list_row(space, r, node, keys[a:b], sums[:, a:b], None if asked is None else asked[a:b]) | {"parent": parent})
        yield from _table(PIECE_SCHEMA, out).to_batches()


def _merged(pieces: pa.Table, dtype):
    """Rows in order of node, their asked marks, the distinct keys, each row's places among them, and the sums."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["node"])
    lists = [_read_list(r, dtype) for r in rows]
    distinct, local = np.unique(np.concatenate([k for k, _, _ in lists]), return_inverse=True)
    sums = np.concatenate([s for _, s, _ in lists], axis=1)
    totals = np.stack([np.bincount(local, weights=line, minlength=len(distinct)) for line in sums]).astype(dtype)
    first = np.full(len(distinct), len(local), np.int64)  # the first place where a key's first quantity is not 0
    held = np.flatnonzero(sums[0] > 0)
    np.minimum.at(first, local[held], held)
    owner = np.zeros(len(local) + 1, bool)
    owner[first] = True
    return rows, [a for _, _, a in lists], distinct, local, totals, owner[:-1]


def merge(pieces: pa.Table, dtype) -> pa.Table:
    """The pieces of one range as one list."""
    rows, asked, distinct, local, totals, _ = _merged(pieces, dtype)
    wanted = np.bincount(local, weights=np.concatenate(asked), minlength=len(distinct)) > 0
    return _table(LIST_SCHEMA, [_list_row(rows[0]["space"], rows[0]["prefix"], rows[0]["parent"], distinct, totals, wanted)])


def _answers(rows, asked, local, values, owner, bits: int, stats: list[int]) -> list[dict]:
    out, at = [], 0
    for n, (row, mask) in enumerate(zip(rows, asked, strict=True)):
        place, own = local[at : at + len(mask)][mask], owner[at : at + len(mask)][mask]
        at += len(mask)
        up, part = row["prefix"] >> bits, row["prefix"] & ((1 << bits) - 1)
        out.append({"kind": 0, "space": row["space"], "prefix": up, "node": row["node"], "part": part, "answers": _pack_lines(values[:, place]), "firsts": pack(np.packbits(own)), "stats": [] if n else stats})
    return out


def finish(pieces: pa.Table, known: pa.Table | None, dtype, stats, bits: int, keep: bool) -> pa.Table:
    """The last merge of a range: its sums are the answers, or ``known`` (key and two values) has them.

    With ``keep`` a row of kind 1 holds the keys whose first sum is not 0, and their sums.
    """
    if not pieces.num_rows:
        return _table(ANSWER_SCHEMA, [])
    rows, asked, distinct, local, totals, owner = _merged(pieces, dtype)
    told = stats(totals)
    if known is not None:
        totals = np.zeros_like(totals)
        if known.num_rows:
            names = known.column(0).to_numpy().view(np.uint64)
            order = np.argsort(names)
            at = order[np.minimum(np.searchsorted(names, distinct, sorter=order), len(names) - 1)]
            there = names[at] == distinct
            for line in (0, 1):
                totals[line, there] = known.column(line + 1).to_numpy()[at[there]]
    out = _answers(rows, asked, local, totals, owner, bits, told)
    if keep:
        held = totals[0] > 0
        out.append({"kind": 1, "space": rows[0]["space"], "prefix": rows[0]["prefix"], "keys": pack_sorted(distinct[held]), "answers": _pack_lines(totals[:, held])})
    return _table(ANSWER_SCHEMA, out)


def _joined(answers: list[dict], dtype) -> tuple[np.ndarray, np.ndarray]:
    """A list's answers, two lines, and which of its keys it owns, from its ranges in order."""
    values, firsts = [np.empty((2, 0), dtype)], [np.empty(0, bool)]
    for r in sorted(answers, key=lambda r: r["part"]):
        lines = _unpack_lines(r["answers"], 1, dtype)
        values.append(lines)
        firsts.append(np.unpackbits(unpack(r["firsts"], np.uint8), count=lines.shape[1]).astype(bool))
    return np.concatenate(values, axis=1), np.concatenate(firsts)


def pass_down(pieces: pa.Table, answers: pa.Table, dtype, bits: int) -> pa.Table:
    """The answers of a merged list, to the lists that it was merged from."""
    if not pieces.num_rows or not answers.num_rows:
        return _table(ANSWER_SCHEMA, [])
    rows, asked, distinct, local, _, owner = _merged(pieces, dtype)
    got, first = _joined(answers.to_pylist(), dtype)
    wanted = np.bincount(local, weights=np.concatenate(asked), minlength=len(distinct)) > 0
    values, owned = np.zeros((2, len(distinct)), dtype), np.zeros(len(distinct), bool)
    values[:, wanted], owned[wanted] = got, first
    return _table(ANSWER_SCHEMA, _answers(rows, asked, local, values, owner & owned[local], bits, []))


def _passing(dtype, bits: int):
    return lambda pieces, answers: pass_down(pieces, answers, dtype, bits)


def exchange(source: DataFrame, lists, n: int, width: int, bits: int, dtype, stats, name: str, known: DataFrame | None = None, keep: bool = False, fan: int = FAN) -> DataFrame:
    """Answers (ANSWER_SCHEMA, a row for each list and range) of ``n`` lists, which the function ``lists`` takes from
    the batches of ``source``; ``known``: (space, key, first, second) to look up instead of the lists' sums."""
    levels, nodes = [], n
    while not levels or nodes > 1:
        nodes = -(-nodes // fan)
        levels.append((max(1, nodes), bits if nodes <= 1 else min(bits, max(1, fan.bit_length() - 1))))
    shift, pieces = width, []
    for parents, take in levels:
        take = min(take, shift)
        shift -= take
        cut = lambda batches, read=lists, take=take, shift=shift, parents=parents: split(read(batches), take, shift, parents)
        pieces.append((source.mapInArrow(cut, PIECE_SCHEMA), take))
        if len(pieces) < len(levels):
            source, lists = stage(pieces[-1][0].groupBy("space", "prefix", "parent").applyInArrow(lambda t: merge(t, dtype), LIST_SCHEMA), f"{name}-lists"), partial(stored_lists, dtype=dtype)
    last, take = pieces.pop()
    if known is None:
        done = last.groupBy("space", "prefix").applyInArrow(lambda t: finish(t, None, dtype, stats, take, keep), ANSWER_SCHEMA)
    else:
        found = known.select("key", "first", "second", "space", F.shiftrightunsigned("key", shift).alias("prefix")).groupBy("space", "prefix")
        done = last.groupBy("space", "prefix").cogroup(found).applyInArrow(lambda t, k: finish(t, k, dtype, stats, take, False), ANSWER_SCHEMA)
    answers = stage(done, name, ["kind"] if keep else None)
    kept = answers
    while pieces:
        up, take = pieces.pop()
        below = answers.where("kind = 0").withColumn("parent", F.col("node")).groupBy("space", "prefix", "parent")
        answers = stage(up.groupBy("space", "prefix", "parent").cogroup(below).applyInArrow(_passing(dtype, take), ANSWER_SCHEMA), name)
    return answers if answers is kept else answers.unionByName(kept.where("kind = 1 or size(stats) > 0").withColumn("kind", F.when(F.col("kind") == 0, 2).otherwise(F.col("kind"))))


def count_lists(batches, order: int, width: int):
    """A block's list for each order: its distinct n-grams, how often training texts have them, and how often others."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens, starts = _read_block(row)
            learn = np.repeat(np.array(row["train"], bool), np.diff(starts))
            for k, gram in enumerate(_grams(tokens, starts, order)[0], 1):
                distinct, local = np.unique(gram >> np.uint64(64 - width), return_inverse=True)
                counts = np.stack([np.bincount(local, weights=w, minlength=len(distinct)) for w in (learn, ~learn)]).astype(np.int64)
                counts[1] = counts[1] > 0
                yield k, 0, row["block"], distinct, counts, None


def _count_stats(totals: np.ndarray) -> list[int]:
    """Numbers of n-grams that occur once, twice, ... ``MAX_COUNT`` + 1 times, of all tokens and of all n-grams."""
    seen = totals[0][totals[0] > 0]
    of_counts = np.bincount(np.minimum(seen, MAX_COUNT + 2), minlength=MAX_COUNT + 3)[1 : MAX_COUNT + 2]
    return [*map(int, of_counts), int(seen.sum()), len(seen)]


def score_block(block: pa.Table, answers: pa.Table, order: int, width: int, model: dict, every: bool) -> pa.Table:
    """A block's sums by text and needs (kind 0), and its lists of histories (kind 1).

    A history's list has the discounted counts of what follows it, and of the same words after the shorter history; who
    asks divides them by the histories' counts.  All that follows a history in a training text was seen, so only histories
    of other texts may need a weight; with ``every`` all are listed, and divided already.
    """
    out, by = [], {}
    for r in answers.to_pylist():
        by.setdefault(r["space"], []).append(r)
    for row in block.to_pylist():
        tokens, starts = _read_block(row)
        grams, histories = _grams(tokens, starts, order)
        cut, begins = np.uint64(64 - width), starts[:-1]

        def before(of_token, at_start, begins=begins):
            """What holds of the n-gram that ends just before each token."""
            out = np.empty_like(of_token)
            out[1:] = of_token[:-1]
            out[begins] = at_start
            return out

        log_p = below = count_below = due_below = under = None
        lists, needs = {}, []
        for k in range(1, order + 1):
            distinct, first, local = np.unique(grams[k - 1] >> cut, return_index=True, return_inverse=True)
            (totals, others), owned = _joined(by[k], np.int64)
            taken, count, due = _discounted(totals, model["discounts"][k - 1]), totals[local], (others > 0)[local]
            if k == 1:
                known, base = count > 0, np.log10((count + 1) / (model["n"] + model["types"] + 1))
                log_p = np.log10(np.where(totals > 0, taken / max(1, model["n"]), model["unknown"]))[local]
                below, under = taken[local], np.full(len(tokens), max(1, model["n"]))
            else:
                # how often the history was followed: as often as it was seen, since a text's end follows
                followed, history, seen = before(count_below, model["texts"]), histories[k - 1] >> cut, count > 0
                over = np.maximum(followed, 1)
                log_p = np.where(seen, np.log10(np.where(seen, taken[local] / over, 1.0)), log_p)
                for n in needs:
                    n["unseen"][seen] = False  # a longer n-gram was seen: no weight of a shorter history is needed
                needs.append({"k": k, "unseen": ~seen & (followed > 0), "over": over, "under": under})
                at = first[owned]
                at = at if every else at[before(due_below, True)[at]]
                ctx, of = np.unique(history[at], return_inverse=True)
                parts = (taken[local[at]], below[at])
                parts = (parts[0] / over[at], parts[1] / under[at]) if every else parts
                lists[k] = history, ctx, [np.bincount(of, weights=x, minlength=len(ctx)) for x in parts]
                below, under = taken[local], over
            count_below, due_below = count, due
        sizes = np.diff(starts)
        owed, doc = [], np.repeat(np.arange(len(sizes)), sizes)
        for n in needs:
            history, ctx, masses = lists[n["k"]]
            at = np.flatnonzero(n["unseen"])
            asked, one, place = np.unique(history[at], return_index=True, return_inverse=True)
            one = at[one]
            owed += [doc[at], place, *(np.ones_like(one) if every else n[x][one] for x in ("over", "under"))]
            keys = np.union1d(ctx, asked)
            sums, mark = np.zeros((2, len(keys))), np.zeros(len(keys), bool)
            sums[:, np.searchsorted(keys, ctx)] = masses
            mark[np.searchsorted(keys, asked)] = True
            out.append({"kind": 1} | _list_row(n["k"], 0, row["block"], keys, sums, mark))
        summed = lambda x: np.add.reduceat(x.astype(float), begins)  # noqa: E731  no text is without its end
        texts = np.stack([sizes.astype(float), summed(known), summed(base), summed(log_p)])
        flat = np.concatenate([np.array([len(x) for x in owed], np.int64), *owed])
        out.append({"kind": 0, "block": row["block"], "ids": row["ids"], "train": row["train"], "texts": pack(texts.reshape(-1)), "needs": pack(flat.astype(np.int64))})
    return _table(PART_SCHEMA, out)


def settle(parts: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    """Scores of a block's texts: their sums, and the logarithms of the weights that they need."""
    by, out = {}, [_table(SCORE_SCHEMA, [])]
    for r in answers.to_pylist():
        by.setdefault(r["space"], []).append(r)
    for row in parts.to_pylist():
        sizes, known, base, log_p = unpack(row["texts"], np.float64).reshape(4, -1)
        flat = unpack(row["needs"], np.int64)
        at = 4 * (order - 1)
        owed = np.split(flat[at:], np.cumsum(flat[:at])[:-1]) if at else []
        for k in range(2, order + 1):
            doc, place, over, under = owed[4 * (k - 2) : 4 * (k - 1)]
            if len(doc):
                (seen, lower), _ = _joined(by.get(k, []), np.float64)
                weights = log_weight(seen / over, lower / under)
                log_p = log_p + np.bincount(doc, weights=weights[place], minlength=len(log_p))
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log_p)]
        out.append(pa.table(columns, names=out[0].schema.names))
    return pa.concat_tables(out)


def log_weight(seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """What a history's unseen words share, over their mass one order lower, as a logarithm."""
    return np.log10((1 - seen) / np.maximum(1 - lower, 1e-12))


def _unigram_rest(stats: list[int], d: list[float]) -> float:
    """The mass that the discounts free: the unknown class's."""
    of, n, types = stats[: MAX_COUNT + 1], *stats[-2:]
    counted, larger = sum(r * c for r, c in enumerate(of[:MAX_COUNT], 1)), types - sum(of[:MAX_COUNT])
    kept = sum(d[r - 1] * r * of[r - 1] for r in range(1, MAX_COUNT + 1)) + (n - counted) - d[-1] * larger
    return 1 - kept / n if n else 1.0


def _run(docs: DataFrame, train: Column, id_col: str, text_col: str, order: int, block_tokens: int, fan: int, bucket_tokens: int, keep: bool, given: dict | None):
    """(scores, model, count answers, weight answers); ``given``: a model and its tables, else one is learnt."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = stage(texts.mapInArrow(partial(encode_blocks, block_tokens=block_tokens), BLOCK_SCHEMA), "katz-blocks")
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0)).alias("texts")).first()
    width = given["width"] if given else hash_width(size.n)
    bits = max(4, int(size.n // bucket_tokens).bit_length())
    swap = lambda what, rows, lists, dtype, stats: exchange(rows, lists, size.blocks, width, bits, dtype, stats, f"katz-{what}", given[what] if given else None, keep, fan)
    counts = swap("counts", blocks, partial(count_lists, order=order, width=width), np.int64, _count_stats)
    if given:
        model = given["model"]
    else:
        sums = counts.where(F.size("stats") > 0).groupBy("space").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(MAX_COUNT + 3)]).alias("x"))
        stats = {r.space: r.x for r in sums.collect()}  # a row an order
        none = [0] * (MAX_COUNT + 3)
        d = [discounts(stats.get(k, none)[: MAX_COUNT + 1]) for k in range(1, order + 1)]
        n_all, types = stats.get(1, none)[-2:]
        model = {"n": n_all, "types": types, "texts": size.texts, "discounts": d, "unknown": _unigram_rest(stats.get(1, none), d[0])}
    every = keep or given is not None
    back = counts.where("kind = 0").select("space", "part", "answers", "firsts", F.col("node").alias("block")).groupBy("block")
    parts = stage(blocks.groupBy("block").cogroup(back).applyInArrow(lambda b, a: score_block(b, a, order, width, model, every), PART_SCHEMA), "katz-parts", ["kind"])
    discard(blocks)
    if not keep:
        discard(counts)
    owing = parts.where("kind = 1").select(*[f.split(" ")[0] for f in LIST_SCHEMA.split(", ")])
    weights = swap("weights", owing, partial(stored_lists, dtype=np.float64), np.float64, lambda totals: [])
    back = weights.where("kind = 0").select("space", "part", "answers", "firsts", F.col("node").alias("block")).groupBy("block")
    scores = parts.where("kind = 0").select("block", "ids", "train", "texts", "needs").groupBy("block").cogroup(back).applyInArrow(lambda b, a: settle(b, a, order), SCORE_SCHEMA)
    scores = scores.withColumn("train_tokens", F.lit(model["n"]).cast("long")).select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scores, model | {"width": width, "order": order}, counts, weights


def katz_scores(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_tokens: int = 1_000_000, fan: int = FAN, bucket_tokens: int = 1_200_000
) -> DataFrame:
    """log10 probability of every text under a Katz model of the texts where ``train`` holds.

    Returns one row per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams)
    and score.  Words are maximal runs without ASCII white space, A-Z lower-cased; each text ends in one more token.
    Unknown words are one class, which has the mass that the unigram discounts free, so each history's probabilities sum
    to one over the known words and that class.  Null text is empty (its end alone is scored), a null ``train`` is
    false, repeated rows count each time, a text of any length is read whole, an empty table gives no row, other columns
    are ignored.  N-grams are told apart by hashes of 22 bits more than the number of tokens takes, 64 at most.
    """
    return _run(docs, train, id_col, text_col, order, block_tokens, fan, bucket_tokens, False, None)[0]


def _rows_of(batches, dtype):
    """Kept lists to rows (space, key, value)."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = unpack_sorted(row["keys"])
            lines = _unpack_lines(row["answers"], len(keys), dtype)
            values = lines[0] if dtype is np.int64 else log_weight(*lines)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["space"], np.int32)), pa.array(keys.view(np.int64)), pa.array(values)], ["space", "key", "value"])


def fit_katz(docs: DataFrame, path: str, text_col: str = "text", order: int = 3, block_tokens: int = 1_000_000, fan: int = FAN, bucket_tokens: int = 1_200_000) -> None:
    """Write a model of all texts under ``path``: counts (gram_order, gram, count), weights (gram_order, history,
    log_weight), both partitioned by order, and one row of totals and discounts.  Cases as in ``katz_scores``.

    The weights of an order are those of histories one word shorter.
    """
    _, model, counts, weights = _run(docs.withColumn("_id", F.lit(0)), F.lit(True), "_id", text_col, order, block_tokens, fan, bucket_tokens, True, None)
    for rows, kind, dtype, key, value in ((counts, "long", np.int64, "gram", "count"), (weights, "double", np.float64, "history", "log_weight")):
        kept = rows.where("kind = 1").select("space", "keys", "answers").mapInArrow(partial(_rows_of, dtype=dtype), f"space int, key long, value {kind}")
        kept.select(F.col("space").alias("gram_order"), F.col("key").alias(key), F.col("value").alias(value)).write.partitionBy("gram_order").parquet(f"{path}/{'counts' if kind == 'long' else 'weights'}")
    docs.sparkSession.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.text(f"{path}/model")


def score_katz(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1_000_000, fan: int = FAN, bucket_tokens: int = 1_200_000) -> DataFrame:
    """Scores of texts by the model that ``fit_katz`` wrote under ``path``; columns and cases as in ``katz_scores``."""
    spark = docs.sparkSession
    model = json.loads(spark.read.text(f"{path}/model").first()[0])
    read = lambda what, key, value: spark.read.parquet(f"{path}/{what}").select(F.col("gram_order").cast("int").alias("space"), F.col(key).alias("key"), F.col(value).alias("value"))
    counts = read("counts", "gram", "count").select("space", "key", F.col("value").alias("first"), F.lit(1).cast("long").alias("second"))
    weights = read("weights", "history", "log_weight").select("space", "key", (1 - F.pow(F.lit(10.0), "value")).alias("first"), F.lit(0.0).alias("second"))
    given = {"width": model["width"], "model": model, "counts": counts, "weights": weights}
    return _run(docs, F.lit(False), id_col, text_col, model["order"], block_tokens, fan, bucket_tokens, False, given)[0]


def op1_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by trigrams, bigrams and words of those not in fold 2 of 7; cases as in ``katz_scores``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = katz_scores(docs, ~in_fold("doc_id", 7, 2), order=3)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
