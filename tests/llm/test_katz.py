"""Katz models of any order against a model in plain Python: joint scores, merges in levels, stored tables."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import katz


class Model:
    """P(w | h) by definition: discounted where h w was seen, else the weight of h times the shorter history's P."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            for i in range(len(t)):
                for k in range(1, order + 1):
                    self.counts[k][self.gram(t, i, k)] += 1
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.MAX_COUNT + 2)]
        self.d = [None] + [katz.discounts(of(c)) for c in self.counts[1:]]
        self.n = sum(self.counts[1].values())
        self.following = [None] + [collections.Counter() for _ in range(order)]
        self.words = collections.defaultdict(set)
        for k in range(1, order + 1):
            for g, c in self.counts[k].items():
                self.following[k][g[:-1]] += c
                self.words[k, g[:-1]].add(g[-1])
        self.weights = {}

    @staticmethod
    def gram(t, i, k):
        padded = ["<s>"] * (k - 1) + t
        return tuple(padded[i : i + k])

    def discounted(self, k, g):
        c, d = self.counts[k][g], self.d[k]
        return (c * d[c - 1] if c <= katz.MAX_COUNT else c - d[-1]) / self.following[k][g[:-1]]

    def p(self, k, g):
        if k == 1:
            return self.discounted(1, g) if g in self.counts[1] else 1 - sum(self.discounted(1, w) for w in self.counts[1])
        if g in self.counts[k]:
            return self.discounted(k, g)
        return self.weight(k, g[:-1]) * self.p(k - 1, g[1:])

    def weight(self, k, h):
        if h not in self.following[k]:
            return 1.0
        if (k, h) not in self.weights:
            seen = [h + (w,) for w in self.words[k, h]]
            self.weights[k, h] = (1 - sum(self.discounted(k, g) for g in seen)) / (1 - sum(self.p(k - 1, g[1:]) for g in seen))
        return self.weights[k, h]

    def score(self, t):
        return sum(math.log10(self.p(self.order, self.gram(t, i, self.order))) for i in range(len(t)))


def tokens(text):
    return (text or "").encode().lower().decode().split() + ["</s>"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(30)], k=r.randrange(0, 60)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (None, "w1 W2\nw3"), (5, rows[5][1]), (72, "never  seen\twords w1"), (73, "w1 w2 " * 1500)]


@pytest.mark.parametrize("order,fan", [(3, 256), (3, 2), (4, 3)])
def test_orders_and_levels(spark, texts, order, fan):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).withColumns({"block": F.lit("x"), "node": F.lit(1)})
    got = katz.katz_scores(df, F.col("doc_id") % 4 != 1, order=order, block_tokens=200, fan=fan, bucket_tokens=500).collect()
    model = Model([tokens(t) for i, t in texts if i is not None and i % 4 != 1], order)
    want = sorted((-1 if i is None else i, i is not None and i % 4 != 1, len(tokens(t)), round(model.score(tokens(t)), 6)) for i, t in texts)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.train, r.n_tokens, round(r.score, 6)) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-4) for a, b in zip(have, want, strict=True))
    words = [*model.counts[1], ("unknown",)]
    for h in list(model.following[order])[:6]:
        assert math.isclose(sum(model.p(order, h + w) for w in words), 1, abs_tol=1e-9)


def test_stored_tables_score_new_texts(spark, texts, tmp_path):
    known, new = [x for x in texts if x[0] is not None and x[0] < 40], [x for x in texts if x[0] is None or x[0] >= 40]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    katz.fit_katz(df(known), f"{tmp_path}/m", block_tokens=200, fan=2, bucket_tokens=500)
    model = Model([tokens(t) for _, t in known], 3)
    for k in (1, 2, 3):
        counts = spark.read.parquet(f"{tmp_path}/m/counts").where(F.col("gram_order") == k)
        assert sorted(r["count"] for r in counts.collect()) == sorted(model.counts[k].values())
    weights = [10**r.log_weight for r in spark.read.parquet(f"{tmp_path}/m/weights").where("gram_order = 3").collect()]
    want = sorted(model.weight(3, h) for h in model.following[3])
    assert len(weights) == len(want) and all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(sorted(weights), want, strict=True))
    got = katz.score_katz(df(new), f"{tmp_path}/m", block_tokens=150, fan=3).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-4) for a, b in zip(have, sorted((-1 if i is None else i, model.score(tokens(t))) for i, t in new), strict=True))
    assert katz.score_katz(df(new).limit(0), f"{tmp_path}/m").count() == 0


def test_rows_grow_with_the_input(spark, texts):
    """Twice the texts give about twice the pieces at each level, not four times."""
    df = spark.createDataFrame([(i, f"{t} x{(i or 0) % 7}") for i, t in texts * 8], "doc_id long, text string")
    n = []
    for part in (df.where("doc_id < 30"), df):
        lists = part.select("doc_id", "text", F.lit(True).alias("train")).repartition(4).mapInArrow(lambda b: katz.encode_blocks(b, 300), katz.BLOCK_SCHEMA)
        n.append((lists.count(), lists.mapInArrow(lambda b: katz.split(katz.count_lists(b, 3, 40), 3, 37, 4), katz.PIECE_SCHEMA).count()))
    assert n[1][0] > 1.5 * n[0][0] and n[1][1] / n[1][0] < 1.3 * n[0][1] / n[0][0]
