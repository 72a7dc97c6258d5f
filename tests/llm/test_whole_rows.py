"""Rows that must come through whole: bytes that aren't text, maps, equal rows; targets that can be met; held-out figures."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langmask, raking, rules, stages, warc, zquality
from loomgraph.runtime import new_path, table

SF = "/root/testdata/sf0.01"


def test_archives_hold_any_bytes(spark):
    r = random.Random(4)
    payloads = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 50, 300, 5000)] + ["é".encode() * 400 + b"\xff" + b"x" * 2000, "plain é".encode(), b"", b"\xc3"]
    payloads += [payloads[3]]
    rows = [(i, f"u{i}", bytearray(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "page_id long, url string, b binary").select("page_id", "url", F.expr("cast(b as string)").alias("html"))
    path = new_path(spark, "bytes")
    warc.write_archives(df, path, size=1000)
    read = warc.read_archives(spark, path)
    got = {x.page_id: x for x in warc.verified_records(read).collect()}
    import hashlib

    assert {i: (x.payload_bytes, x.payload_digest) for i, x in got.items()} == {i: (len(p), hashlib.sha256(p).hexdigest()) for i, p in enumerate(payloads)}
    assert got[8].record_type == "revisit" and got[8].refers_to == 3 and warc.unsound_records(read).isEmpty()
    assert {x.coded for x in read.where("page_id = 4").collect()} == {True, False}  # only the chunk with the odd byte


def test_near_duplicates_of_rows_with_maps(spark):
    rows = [(1, "one two three four", {"k": "v"}), (1, "one two three four", {"k": "v"}), (1, "one two three four", {"k": "w"}), (2, "something else here now", None), (3, "", {}), (None, None, {"a": "b"}), (7, "one two three four", {"k": "v"})]
    df = spark.createDataFrame(rows, "doc_id long, text string, notes map<string,string>").withColumns({"_fp": F.lit(1), "_fp_row_a": F.lit(2), "nested": F.struct(F.col("notes").alias("m"))})
    out = stages.dedup_stage(spark, df, "")
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "2", "3"]
    assert stages.dedup_stage(spark, df.limit(0), "").collect() == []


def test_targets_can_be_met(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source", "lang")
    out, marginals = raking.mix(docs, carry_text=False)
    assert marginals.agg(F.max(F.abs("residual"))).first()[0] < 0.01
    assert out.count() == docs.count()
    cells = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0)], "source string, tokens long")
    got = {r.value: r.target for r in raking.tempered_targets(cells, "source", 0.0, budget=0.5).collect()}
    assert got["c"] == 0 and 10 / 1010 < got["b"] <= 2 * 10 / 1010 and abs(sum(got.values()) - 1) < 1e-9
    free = {r.value: r.target for r in raking.tempered_targets(cells, "source", 0.5, budget=1e-9).collect()}
    assert abs(free["b"] / free["a"] - 0.1) < 1e-9  # as tempered, where nothing stands against it
    assert raking.tempered_targets(cells.where("tokens = 0"), "source", 0.5).collect()[0].target == 0


def fold(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.mark.parametrize("name", ["language", "quality", "rules"])
def test_held_out_rows_of_real_tables(spark, name):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    if name == "language":
        docs = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
        got = [r for r in langmask.op2_language_bitmask(spark, SF).collect() if fold(r.doc_id, 3) == 1 and docs[r.doc_id]]
        assert sum(r.lang_pred == docs[r.doc_id] for r in got) >= 0.98 * len(got) > 0
    elif name == "quality":
        got = [r for r in zquality.op3_compression_quality(spark, SF).collect() if fold(r.doc_id, 5) == 0 and r.doc_id in labels]
        bad, good = ([r for r in got if labels[r.doc_id] == y] for y in (0, 1))
        assert sum(r.predicted == 0 for r in bad) >= 0.7 * len(bad) > 0 and sum(r.predicted == 0 for r in good) <= 0.03 * len(good)
    else:
        got = [r for r in rules.op9_adaptive_rules(spark, SF).collect() if not r.base_failed and r.doc_id in labels]
        bad, good = ([r for r in got if labels[r.doc_id] == y] for y in (0, 1))
        assert sum(not r.kept for r in bad) >= 0.95 * len(bad) > 0 and sum(not r.kept for r in good) <= 0.03 * len(good)
