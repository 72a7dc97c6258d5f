"""Searches for whole benchmark texts: words after the first 60 characters count."""

from loomgraph import catalog_text


def test_words_after_sixty_characters_count(spark, tmp_path):
    same = "one two three four five six seven eight nine ten eleven twelve "  # 63 characters
    spark.createDataFrame([(1, same + "river"), (2, same + "stone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, same + "stone"), (11, same + "river")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r["rank"]): (r.record_id, r.score) for r in catalog_text.benchmark_lexical_whole(spark, str(tmp_path)).collect()}
    part = round(2 * 12 / 13, 6)
    assert got == {(1, 1): (11, 7.0), (1, 2): (10, part), (2, 1): (10, 7.0), (2, 2): (11, part)}
    words = {r.query_id: r.keywords for r in catalog_text.benchmark_keywords_whole(spark, str(tmp_path)).collect()}
    assert words[1].split() == same.split()  # 12 at most, taken from the whole text
