"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (words the training sample has often enough) and as the mean of its
character trigrams' vectors.  The network reads windows of words that overlap, and a text scores as its
highest window.  Training takes, for each labelled text, the window that scores highest so far.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fit_logistic, in_fold, logistic, raw_texts, sample_labelled
from loomgraph.runtime import table

WINDOW, STRIDE = 64, 32
EMBED, HIDDEN, CHAR_ROWS = 8, 8, 8191
EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(EDGE) for w in text.lower().split()]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; an empty text has one empty window."""
    last = max(0, n - WINDOW)
    starts = [*range(0, last, STRIDE), last]
    return [(s, min(n, s + WINDOW)) for s in starts]


def trigram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all words' byte trigrams, ends marked, one word after the other; and each word's first."""
    data = np.frombuffer(b"".join([b"^%b$" % w for w in words]) + b"$$", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * 2654435761 % (1 << 61)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    longer = sizes > 2  # an empty word keeps one trigram
    inside[ends - 1] = False
    inside[ends[longer] - 2] = False
    return (codes[inside] >> 7) % CHAR_ROWS, np.concatenate([[0], np.cumsum(np.maximum(sizes - 2, 1))[:-1]])


def _summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values' rows by index."""
    flat, values = index.reshape(-1), values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(flat, weights=values[:, c], minlength=rows) for c in range(values.shape[1])], 1).astype(np.float32)


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}  # row 0: any other word
        self.p = {"word": rng.standard_normal((len(vocabulary) + 1, EMBED)).astype(np.float32) * 0.1, "char": rng.standard_normal((CHAR_ROWS, EMBED)).astype(np.float32) * 0.1}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"wx{side}": init(2 * EMBED, 3 * HIDDEN), f"wh{side}": init(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"attention": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}

    def inputs(self, words: list[bytes]):
        rows = np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))
        return rows, *trigram_rows(words)

    def vectors(self, rows: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first, append=len(grams))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][rows], np.add.reduceat(self.p["char"][grams], first) / n], 1)

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logit of each window; ``at``: rows of ``x`` by window and step, -1 beyond a window's end."""
        p, (n, steps) = self.p, at.shape
        mask = (at >= 0).astype(np.float32)[:, :, None]
        hidden = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        trace = {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = x @ p[f"wx{side}"] + p[f"b{side}"]
            h, wh, part = np.zeros((n, HIDDEN), np.float32), p[f"wh{side}"], slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            for t in order:
                gi, gh = gates[at[:, t]], h @ wh
                rz = 1 / (1 + np.exp(-(gi[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])))
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(gi[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                new = h + mask[:, t] * (1 - z) * (c - h)
                if keep:
                    trace[side, t] = h, r, z, c, gh[:, 2 * HIDDEN :]
                h = new
                hidden[:, t, part] = h
        e = np.where(mask[:, :, 0] > 0, hidden @ p["attention"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True)) * mask[:, :, 0]
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = (a[:, :, None] * hidden).sum(1)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (x, at, mask, hidden, a, pooled, trace)) if keep else logit

    def backward(self, error: np.ndarray, kept, inputs) -> dict[str, np.ndarray]:
        p, (x, at, mask, hidden, a, pooled, trace) = self.p, kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"][0] = pooled.T @ error, error.sum()
        d_pooled = error[:, None] * p["out"]
        d_hidden = a[:, :, None] * d_pooled[:, None, :]
        d_a = (hidden * d_pooled[:, None, :]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["attention"] = np.tensordot(d_e, hidden, ((0, 1), (0, 1)))
        d_hidden += d_e[:, :, None] * p["attention"]
        d_x = np.zeros_like(x)
        for side, order in (("f", range(at.shape[1] - 1, -1, -1)), ("b", range(at.shape[1]))):
            part = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            steps_, d_h, wh = np.zeros((*at.shape, 3 * HIDDEN), np.float32), 0.0, p[f"wh{side}"]
            for t in order:
                h, r, z, c, gh = trace[side, t]
                d = d_hidden[:, t, part] + d_h
                m = mask[:, t]
                d_c = d * m * (1 - z) * (1 - c * c)
                d_z = d * m * (h - c) * z * (1 - z)
                d_r = d_c * gh * r * (1 - r)
                d_gi = np.concatenate([d_r, d_z, d_c], 1)
                d_gh = np.concatenate([d_r, d_z, d_c * r], 1)
                g[f"wh{side}"] += h.T @ d_gh
                steps_[:, t] = d_gi
                d_h = d * (1 - m * (1 - z)) + d_gh @ wh.T
            d_gates = _summed(np.maximum(at, 0), steps_, len(x))  # beyond a window's end it is 0
            g[f"wx{side}"] = x.T @ d_gates
            g[f"b{side}"] = d_gates.sum(0)
            d_x += d_gates @ p[f"wx{side}"].T
        rows, grams, first = inputs
        n = np.diff(first, append=len(grams))
        g["word"] = _summed(rows, d_x[:, :EMBED], len(p["word"]))
        g["char"] = _summed(grams, np.repeat(d_x[:, EMBED:] / n[:, None], n, 0), len(p["char"]))
        g["word"][0] = 0
        return g


def lay_out(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, their rows by window and step (-1 beyond the end), and each window's text."""
    coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    starts, lengths, owner, first = [], [], [], 0
    for i, t in enumerate(texts):
        for a, b in windows_of(len(t)):
            starts.append(first + a)
            lengths.append(b - a)
            owner.append(i)
        first += len(t)
    step = np.arange(WINDOW)
    at = np.array(starts, np.int64)[:, None] + step
    inside = step < np.array(lengths)[:, None]
    index = np.append(index, -1).astype(np.int32)
    return coded.dictionary.to_pylist(), np.where(inside, index[np.minimum(at, len(index) - 1)], -1), np.array(owner, np.int64)


def text_logits(net: Network, texts: list[list[bytes]], most: int = 8192) -> np.ndarray:
    """The highest window's logit of each text."""
    words, at, owner = lay_out(texts)
    x = net.vectors(*net.inputs(words or [b""]))
    logits = np.concatenate([net.forward(x, at[i : i + most]) for i in range(0, len(at), most)])
    out = np.full(len(texts), -np.inf)
    np.maximum.at(out, owner, logits)
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int = 1500, max_chars: int = 20_000, vocabulary: int = 20_000, rounds: int = 8, least: int = 6, decay: float = 2e-3, miss_cost: float = 2.5) -> dict:
    """Fit on at most about ``per_class`` labelled texts of each class, of ``max_chars`` characters at most.

    A fifth of them is kept from the network and calibrates its scores.  Null and empty texts aren't sampled; of labels that
    repeat for an id the greatest counts; fewer than ten texts of a class make the score a constant, the toxic share.  A toxic text that is missed counts as
    ``miss_cost`` false alarms: scores are calibrated as if toxic texts were that many times as frequent.
    """
    rows, counts = sample_labelled(docs, labels, label, keep, per_class, max_chars)
    return fit_network(rows, counts, vocabulary, rounds, least, decay, miss_cost)


def fit_network(every: list[tuple[bytes, int]], counts: dict[int, int], vocabulary: int = 20_000, rounds: int = 8, least: int = 6, decay: float = 2e-3, miss_cost: float = 2.5) -> dict:
    """``train_toxicity`` on (text, label) pairs and the labels' counts."""
    seen = {0: 0, 1: 0}
    rows, aside = [], []
    for t, z in every:  # each class's every fifth text
        seen[z] += 1
        (aside if seen[z] % 5 == 0 else rows).append((t, z))
    y = np.array([z for _, z in rows], np.float32)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return {"net": None, "prior": prior}
    texts = [words_of(t) for t, _ in rows]
    often = Counter(w for t in texts for w in set(t))
    net = Network(sorted(w for w, n in often.most_common(vocabulary) if n >= least))
    words, at, owner = lay_out(texts)
    inputs = net.inputs(words)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rng, serial = np.random.default_rng(11), 0
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(rounds):
        x = net.vectors(*inputs)
        logits = np.concatenate([net.forward(x, at[i : i + 8192]) for i in range(0, len(at), 8192)])
        best = np.lexsort((-logits, owner))
        best = best[np.unique(owner[best], return_index=True)[1]]
        clean = np.flatnonzero(y[owner] == 0)  # every window of a clean text is clean
        chosen = rng.permutation(np.concatenate([best, rng.choice(clean, min(len(clean), len(best)), replace=False)]))
        for i in range(0, len(chosen), 256):
            part = chosen[i : i + 256]
            used, local = np.unique(at[part], return_inverse=True)
            local = local.reshape(at[part].shape) - (used[0] < 0)
            used = used[used >= 0]
            if not len(used):
                continue
            sub = net.inputs([words[u] for u in used])
            logit, kept = net.forward(net.vectors(*sub), local, keep=True)
            error = ((logistic(logit) - y[owner[part]]) * weight[owner[part]] / len(part)).astype(np.float32)
            grads = net.backward(error, kept, sub)
            serial += 1
            for k, grad in grads.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.p[k] *= 1 - 0.01 * decay
                net.p[k] -= 0.01 * (m / (1 - 0.9**serial)) / (np.sqrt(v / (1 - 0.999**serial)) + 1e-8)
    z, y = text_logits(net, [words_of(t) for t, _ in aside]), np.array([z for _, z in aside], float)
    real = np.where(y == 1, miss_cost * prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    scale = float(z.std()) + 1e-9
    return {"net": net, "prior": prior, "scale": scale, "beta": fit_logistic((z / scale)[:, None], y, real, ridge=1e-4)}


def toxicity_scores(texts: list[bytes], model: dict) -> np.ndarray:
    if model["net"] is None or not texts:
        return np.full(len(texts), model["prior"])
    out, part, size = [], [], 0
    for t in texts:
        part.append(words_of(t))
        size += len(part[-1])
        if size > 250_000:
            out.append(text_logits(model["net"], part))
            part, size = [], 0
    if part:
        out.append(text_logits(model["net"], part))
    return logistic(np.concatenate(out) / model["scale"] * model["beta"][0] + model["beta"][1])


def with_toxicity(docs: DataFrame, model: dict, text_col: str = "text", out: str = "toxicity_score") -> DataFrame:
    """``docs`` and the score (double, 0 to 1) of each whole text, null counting as empty; all rows and columns stay.

    A text of any length is read whole, in windows of 64 words of which the next starts 32 words on.  Without labelled texts of both classes every text scores the toxic share among the labels.
    Repeated rows score alike, an empty table gives no row; a column called like ``out`` is an error.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    known = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the parameters

    def score(batches):
        for batch in batches:
            got = toxicity_scores(raw_texts(batch.column(text_col)), known.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(score, docs.withColumn(out, F.lit(0.0)).schema)


def op8_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels not in fold 0 of 5; cases as in ``with_toxicity``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold("doc_id", 5, 0)
    model = train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", ~held_out)
    return with_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted")
    )
