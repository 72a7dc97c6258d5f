"""Each operator against brute force, and on nulls, empty tables, repeats and clashing columns."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import katz, langmask, packing, queries, raking, rules, simhash, topk, toxgru, warc, zquality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 90)))
        rows.append((i, text, r.choice(["en", "fr"]), f"s{i % 3}", len(text)))
    rows += [(100, None, None, None, None), (None, "w1 w2\nw3", "en", "s0", 8), (7, rows[7][1], "en", "s0", 1), (7, rows[7][1], "en", "s0", 1), (101, "", "en", "s0", 0), (102, "x " * 5000, "en", "s1", 10000)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"block": F.lit(1), "score": F.lit("x")})


def test_katz_is_normalised_and_matches_brute_force(spark):
    docs = make(spark)
    got = katz.katz_scores(docs, F.col("doc_id") % 5 != 0, block_tokens=700).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    toks = lambda t: (t or "").lower().split() + ["</s>"]
    train = [toks(r.text) for r in rows if r.doc_id is not None and r.doc_id % 5]
    uni = collections.Counter(w for t in train for w in t)
    bi = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [sum(x == k for x in c.values()) for k in range(1, 7)]
    d1, d2 = katz.discounts(of(uni)), katz.discounts(of(bi))
    disc = lambda c, d: c * d[c - 1] if c <= 5 else c - d[-1]
    p1 = {w: disc(c, d1) / n for w, c in uni.items()}
    unk = 1 - sum(p1.values())
    ctx = collections.Counter(h for h, _ in bi.elements())
    seen = collections.defaultdict(dict)
    for (h, w), c in bi.items():
        seen[h][w] = disc(c, d2) / ctx[h]
    alpha = {h: (1 - sum(s.values())) / (1 - sum(p1[w] for w in s)) for h, s in seen.items()}
    for h in list(seen)[:5]:
        total = sum(seen[h].get(w, alpha[h] * p1[w]) for w in uni) + alpha[h] * unk
        assert math.isclose(total, 1, abs_tol=1e-9)

    def score(t):
        s = b = 0.0
        for h, w in zip(["<s>", *t], t, strict=False):
            s += math.log10(seen[h][w] if w in seen.get(h, {}) else alpha.get(h, 1) * p1.get(w, unk))
            b += math.log10((uni[w] + 1) / (n + v + 1))
        return round(s, 6), round(b, 6), len(t), sum(w in uni for w in t)

    want = sorted(score(toks(r.text)) for r in rows)
    assert np.allclose(sorted((r.score, r.base_score, r.n_tokens, r.n_known) for r in got), want, atol=1e-5)
    assert {r.train_tokens for r in got} == {n}


def test_katz_order_three_and_empty(spark):
    docs = make(spark)
    three = katz.katz_scores(docs, F.lit(True), order=3).agg(F.sum("score")).first()[0]
    two = katz.katz_scores(docs, F.lit(True), order=2).agg(F.sum("score")).first()[0]
    assert two < three < 0
    assert katz.katz_scores(docs.limit(0), F.lit(True)).count() == 0


def test_languages(spark):
    rows = [(i, ("the thing and other words " if i % 2 else "quelque chose déjà là été ") * 3, "en" if i % 2 else "fr") for i in range(60)] + [(90, None, "en"), (91, "12 34", "fr"), (None, "other things", None), (92, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("slot", F.lit(1))
    got = {r.doc_id: r for r in langmask.identify_languages(df, F.col("doc_id") % 3 == 1).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60)) and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91, 92))
    assert langmask.identify_languages(df.limit(0), F.lit(False)).count() == 0


def test_quality_and_toxicity_held_out(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "river", "stone", "walks", "gently", "by"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["buy$$$", "###", "click", "now!!", "|"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (None, "the river"), (901, "")], "doc_id long, text string").withColumn("y", F.lit(9))
    labels = spark.createDataFrame([(x[0], x[2], 1 - x[2]) for x in rows], "doc_id long, quality int, toxic int")
    model = zquality.train_quality(docs, labels, "quality", F.col("doc_id") % 5 != 0)
    got = {x.doc_id: x.quality_score for x in zquality.with_quality(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(0, 300, 5)) and 0 <= got[900] <= 1 and got[900] == got[901]
    tox = toxgru.train_toxicity(docs, labels, "toxic", F.col("doc_id") % 5 != 0)
    got = {x.doc_id: x.toxicity_score for x in toxgru.with_toxicity(docs, tox).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(0, 300, 5)) and 0 <= got[900] <= 1
    none = zquality.train_quality(docs, labels.limit(0), "quality", F.lit(True))
    assert zquality.with_quality(docs, none).where("quality_score = 0.5").count() == docs.count()
    with pytest.raises(ValueError):
        zquality.with_quality(docs, none, out="y")


def test_network_gradient():
    net = toxgru.Network([b"bad", b"good"])
    words, at, _ = toxgru.lay_out([[b"bad", b"good", b"else"], [b"good"], []])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sub = net.inputs(words)
    _, kept = net.forward(net.vectors(*sub), at, keep=True)
    grads = net.backward(np.array([1.0, 0.5, 0.25]), kept, sub)
    loss = lambda: float(net.forward(net.vectors(*sub), at) @ np.array([1.0, 0.5, 0.25]))
    for name in ("whf", "whb", "wxf", "bb", "attention", "out", "word", "char"):
        p = net.p[name].reshape(-1)
        i = int(np.abs(grads[name].reshape(-1)).argmax())
        p[i] += 1e-4
        up = loss()
        p[i] -= 2e-4
        assert abs((up - loss()) / 2e-4 - grads[name].reshape(-1)[i]) < 1e-3
        p[i] += 1e-4


def test_windows_overlap_and_cover():
    for n in (0, 1, 64, 65, 200, 1000):
        w = toxgru.windows_of(n)
        assert set(range(n)) == {i for a, b in w for i in range(a, b)} and all(b > c for (_, b), (c, _) in zip(w, w[1:], strict=False))


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([("a", "en", "t", 100), ("a", "fr", "u", 50), ("b", "en", "u", 30), ("b", "fr", "t", 20), ("c", "en", "t", 0)], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame(v, "value string, target double") for d, v in {"source": [("a", 0.5), ("b", 0.5), ("zz", 3.0)], "lang": [("en", 0.6), ("fr", 0.4)], "topic": [("t", 0.5), ("u", 0.5)]}.items()}
    got = raking.rake(cells, targets, 40).collect()
    for d, v in {"source": {"a": 0.5, "b": 0.5, "c": 0}, "lang": {"en": 0.6, "fr": 0.4}}.items():
        for k, want in v.items():
            assert abs(sum(r.weight for r in got if r[d] == k) - want) < 1e-3
    docs = make(spark)
    out, _ = raking.mix(docs)
    assert out.count() == docs.count() and out.where("mix_sampled and mix_tokens = 0").count() == 0 and raking.mix(docs.limit(0))[0].count() == 0
    kept, every = out.where("mix_sampled").agg(F.sum("mix_tokens")).first()[0], out.agg(F.sum("mix_tokens")).first()[0]
    assert 0 < kept < every


def test_packing_round_trip(spark):
    docs = make(spark).select("doc_id", "text", F.lit(1).alias("piece"))
    got = packing.pack_documents(docs, size=128).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 128
    tokens = packing.token_bytes(packing.public_tokenizer(packing.TOKENIZER_FILE), packing.public_tokenizer(packing.RANKS_FILE))
    end = np.array([2], "<u4").tobytes()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(tokens.whole.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes() + end
        n = len(ids) // 4
        first = n % 128 or 128
        for p, a in enumerate([0, *range(first, n, 128)]):
            b = first if p == 0 else a + 128
            want[r.doc_id, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(by) <= math.ceil(sum(r.length for r in got) / 128) * 1.1 + 1 and packing.pack_documents(docs.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer():
    import pyarrow as pa

    tokens = packing.token_bytes(packing.public_tokenizer(packing.TOKENIZER_FILE), packing.public_tokenizer(packing.RANKS_FILE))
    texts = ["", " ", " a", "a  b", "a \n b", "it's 3rd 'S we 'll", "été 12३ 　x", "a <|endoftext|> b", "\x1f x \x85y", "a\n\nb ", None]
    assert tokens.batch(pa.array(texts)) == [np.array(tokens.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_warc_round_trip(spark, tmp_path):
    import hashlib

    long = "é" * 90_000 + warc.RECORD_START + "x" * 50_000 + warc.RECORD_START
    pages = [(1, "http://a", "p" * 100), (2, None, "p" * 100), (3, "u\r\nv", "short"), (4, "u", "short"), (5, "u", long), (6, "u", long), (7, "u", None), (8, "u", ""), (None, "u", "q" * 200), (9, "u", "a\r\n\r\nb\r\n\r\n"), (9, "u", "a\r\n\r\nb\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit(0))
    warc.write_archives(df, f"{tmp_path}/w")
    got = collections.Counter(tuple(r) for r in warc.verified_records(warc.read_archives(spark, f"{tmp_path}/w")).collect())
    want = collections.Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = {2: 1, 6: 5}.get(i)
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", revisit] += 1
    assert got == want
    first = [tuple(r) for r in warc.chunk_records(df.where("page_id = 5"), size=1000).orderBy("chunk_no").select("chunk", "digest").collect()]
    assert "".join(c for c, _ in first) == long and first[0][1] == hashlib.sha256(first[0][0].encode()).hexdigest()
    warc.write_archives(df.limit(0), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0


def test_top_k_ties_and_tiles(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25]) for _ in range(4)]) for i in range(120)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (None, [1.0] * 4), (503, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("rank", F.lit(1))
    got = topk.exact_top_k(df, df.where("vec_id % 10 = 0"), k=5, shard_rows=30, tile_rows=5, fan=2)
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows[:120]}
    want = []
    for q in range(0, 120, 10):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_rules_counts(spark):
    text = "a b c a b c\n# x\n# x\n\n \n|é"
    got = dict(zip(rules.COUNTS, rules.measure_texts([text.encode(), b"", b" # "])[0].tolist(), strict=True))
    words = text.split()
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    assert got == {"n_words": 11, "word_chars": 12, "n_symbols": 3, "n_dup_lines": 1, "n_repeat_words": len(inside), "n_lines": 4}
    docs = make(spark)
    out = rules.apply_rules(docs)
    assert out.count() == docs.count() and out.where("rule_base_failed and rule_kept").count() == 0 and rules.apply_rules(docs.limit(0)).count() == 0


def test_sketch_quantiles_are_close(spark):
    r = random.Random(6)
    rows = [(i, 60, int(60 * r.uniform(3, 9)), 0, 0, 0, 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    s = rules.sketch(df, F.lit("en"), F.col("doc_id").cast("string").substr(1, 1))
    got = rules.quantiles(s, ["lang"], {"q": 0.75}).where("measure = 'word_length'").first()
    want = sorted(x[2] / 60 for x in rows)[1499]
    assert abs(got.q / want - 1) < 0.011 and got["rows"] == 2000


def test_limits_follow_each_source(spark):
    r = random.Random(11)
    rows = []  # of 100 words and 100 lines: in "dup" each text has duplicate lines and repeats, in "clean" hardly one, in "junk" a tenth has symbols
    for i in range(1500):
        s, odd = ("clean", "dup", "junk")[i % 3], i < 30
        many = {"clean": 30 if odd else 0, "dup": r.randrange(10, 26), "junk": 0}[s]
        rows.append((i, s, 100, 500, 250 if s == "junk" and i < 150 else 0, many if i < 15 else 0 if s == "clean" else many, many if i >= 15 else 0 if s == "clean" else many, 100))
    df = spark.createDataFrame(rows, "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    lang, source = F.lit("en"), F.col("source")
    limits = rules.thresholds(rules.sketch(df, lang, source))
    by = {x.source: x for x in limits.collect()}
    for m in ("dup_lines", "repeats"):  # 5 of the clean texts, a hundredth, are extreme for their source though not for another
        assert by["clean"][f"{m}_high"] < 0.2 and 0.25 < by["dup"][f"{m}_high"] < 0.35
    assert by["junk"].symbols_high < 2.5
    kept = {x.doc_id for x in rules.judged(df, limits, lang, source).where("kept").select("doc_id").collect()}
    assert {x[0] for x in rows} - kept == {x[0] for x in rows if x[1] == "clean" and x[0] < 30 or x[4]}


def test_simhash_against_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:
        for _ in range(6):
            x = b
            for _ in range(r.randrange(0, 6)):
                x ^= 1 << r.randrange(64)
                prints.add(x)
    prints |= {1 << i for i in range(64)} | {0}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for size in (4096, 8):  # the second cuts shards up
        got = simhash.link_fingerprints(df, size).collect()
        parent = {p: p for p in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in got:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
            parent[find(a)] = find(b)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    assert find(a) == find(b)


def test_fingerprint_and_table(spark):
    words = [f"w{i % 17}" for i in range(50)]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(48)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 48)
    assert simhash.fingerprint(" ".join(words).upper().encode()) == want and simhash.fingerprint(b" ") == 0
    got = {}
    for r in simhash.dedup_table(make(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert len(got[7]) == 3 and len(set(got[7])) == 1 and got[100] == got[101] and got[100][0][0] == "0" * 16
    assert simhash.dedup_table(make(spark).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: " ".join(r.choice("alpha beta gamma delta river stone light water green house walks slowly".split()) for _ in range(120))
    rows = [(i, text(), "en", f"s{i % 2}", 0) for i in range(80)]
    rows += [(200 + i, rows[3][1], "en", "s0", 0) for i in range(5)] + [(300, "no", "en", "s0", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    assert docs.where("doc_id >= 200").count() == 0 and docs.count() >= 70 and len(names) == 5
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_quality_stage_learns_from_what_the_rules_reject(spark, tmp_path):
    from loomgraph.llm import stages

    r = random.Random(10)
    words = {1: "alpha beta gamma delta river stone light water green house walks slowly", 0: "casino bonus prize viagra click winner poker loans cheap deals offer clicks"}
    text = lambda y: " ".join(r.choice(words[y].split()) for _ in range(120))
    rows = [(i, text(1), "en", "s0", 0) for i in range(300)]  # labelled good where the id is below 200
    rows += [(1000 + i, text(0) + " $$ || ##" * 40, "en", "s0", 0) for i in range(60)]  # labelled bad, and the rules see it
    rows += [(2000 + i, text(0), "en", "s0", 0) for i in range(20)]  # bad without a label, and the rules don't
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i < 200 or 1000 <= i < 2000], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    ruled = stages.rules_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    into = {x.doc_id for x in ruled.select("doc_id").collect()}
    assert not any(1000 <= i < 2000 for i in into) and sum(i >= 2000 for i in into) >= 15
    out = {x.doc_id for x in stages.quality_stage(spark, ruled, str(tmp_path)).select("doc_id").collect()}
    assert not any(i >= 2000 for i in out) and {i for i in into if i < 1000} == out


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
