"""Operator 13: spelling variants, found by a trie of letter-group counts.

A word's vector holds how many letters of each group it has: first the coarse groups, then finer ones.  One edit adds a letter to
one group at most (surplus) and takes one from one group at most (deficit), so a depth-first search that has one of each to
spend in each tier reaches every word one edit away; the words at its leaves are verified.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import raw_texts
from loomgraph.llm.sql import CRC32
from loomgraph.runtime import stage, table

LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC0, 0x100))]
COARSE = 8  #: groups of the trie's first levels, which shards are cut by
FINE = 31  #: groups of the levels below
RUNS = "[a-zÀ-ÿ]{%d,}"


def coarse_group(letter: str) -> int:
    return ord(letter) % COARSE


def fine_group(letter: str) -> int:
    return ord(letter) % FINE


# words of documents


def count_words(docs: DataFrame, least_chars: int = 6, drop_every: int = 199) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one letter dropped from those that ``drop_every`` picks.

    Shorter words than ``least_chars`` are left out.  Counted within tasks first, in tables of 200,000 words at most, so a word
    that a third of all runs are is a row a table.  A null id reads as the empty text; null and empty texts have no words.
    """

    def run(batches):
        runs, counts = re.compile(RUNS % least_chars), Counter()
        for batch in batches:
            for ident, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                front = b"%s:" % (b"" if ident is None else str(ident).encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(runs.findall(raw.lower().decode(errors="replace"))).items():
                    h = crc32(front + word.encode())
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    counts[word] += n
                if len(counts) > 200_000:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


# shards: the trie cut at a depth


def with_counts(words: DataFrame) -> DataFrame:
    """Adds ``v``, the letters of each coarse group, without a Python worker."""
    of = [[x for x in LETTERS if coarse_group(x) == g] for g in range(COARSE)]
    return words.withColumn("v", F.array(*[F.length("word") - F.length(F.translate("word", "".join(x), "")) for x in of]))


def shard_at(depth: int, change: tuple[int, ...] | None = None) -> Column:
    """The name of the trie's node at a depth, or of the one that a change of the counts leads to; null if there is none."""
    counts = [F.get("v", F.lit(k)) + (change[k] if change else 0) for k in range(depth)]
    name = F.concat_ws(",", *[c.cast("string") for c in counts])
    return F.when(F.least(F.lit(0), F.lit(0), *counts) >= 0, name) if change else name


def depth_for(words: DataFrame, most: int) -> tuple[int, int]:
    """The least depth at which no shard has more than ``most`` words, and the largest shard's words there."""
    keys = F.array(*[F.struct(F.lit(d).alias("depth"), shard_at(d).alias("shard")) for d in range(1, COARSE + 1)])
    sizes = words.select(F.inline(keys)).groupBy("depth", "shard").agg(F.count("*").alias("n")).groupBy("depth").agg(F.max("n").alias("n"))
    found = sorted((r.depth, r.n) for r in sizes.collect())  # a row for each depth
    return next(((d, n) for d, n in found if n <= most), found[-1] if found else (1, 0))


def offsets(depth: int) -> list[tuple[int, ...]]:
    """Changes of a vector's first ``depth`` counts by one edit, but for none, that lead to a lesser vector.

    A pair of words is looked for in the lesser one's shard alone.
    """
    out = set()
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up != down:
                out.add(tuple((k == up) - (k == down) for k in range(depth)))
    return sorted(x for x in out if x < (0,) * depth)


def sharded(words: DataFrame, depth: int, largest: int, most: int) -> DataFrame:
    """(shard, block, member, home, word, n): every word in its own shard as a member, and as a query in each lesser one that it can reach.

    If even the deepest cut leaves shards over ``most``, members are dealt to blocks by hash, and queries, members among them,
    go to every block of a shard; nothing is dropped.
    """
    keys = F.array(*[F.struct(shard_at(depth, x).alias("shard"), F.lit(False).alias("member")) for x in offsets(depth)], F.struct(shard_at(depth).alias("shard"), F.lit(True).alias("member")))
    rows = words.select("word", "n", shard_at(depth).alias("home"), F.inline(keys)).where("shard is not null")
    if largest <= most:
        return rows.withColumn("block", F.lit(0))
    sizes = rows.where("member").groupBy("shard").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(sizes, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.select("shard", "word", "n", "home", "member", own.alias("own"), block.alias("block")).withColumn("member", F.col("member") & (F.col("own") == F.col("block"))).drop("own")


# the trie


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the coarse groups, then of the fine ones, a row a word."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.empty((len(words), COARSE + FINE), np.int32)
    out[:, :COARSE] = np.bincount(row * COARSE + codes % COARSE, minlength=len(words) * COARSE).reshape(-1, COARSE)
    out[:, COARSE:] = np.bincount(row * FINE + codes % FINE, minlength=len(words) * FINE).reshape(-1, FINE)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter parts the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def trie_search(known: np.ndarray, asked: np.ndarray, leaf: int = 6, chunk: int = 2_000_000):
    """Yield (indices of ``asked``, indices of ``known``) of vectors within a surplus and a deficit of one each in either tier.

    ``known`` must be sorted by its columns: a trie's node is then a range of rows, its children the runs of the next column.  The
    search goes depth-first, once to a node with all queries that have the budget to reach it; ranges of ``leaf`` rows or fewer,
    and rows that are equal, are leaves.
    """
    n = np.arange(len(asked))
    zero = np.zeros(len(asked), np.int8)
    stack = [(0, len(known), 0, n, zero, zero)]
    while stack:
        low, high, level, who, over, under = stack.pop()
        if level == COARSE:
            over, under = np.zeros_like(over), np.zeros_like(under)
        if not len(who):
            continue
        if high - low <= leaf or level == known.shape[1]:
            step = max(1, chunk // ((high - low) * known.shape[1]))
            for at in range(0, len(who), step):
                part = who[at : at + step]
                diff = asked[part][:, None, :] - known[None, low:high, :]
                more, less = np.maximum(diff, 0), np.maximum(-diff, 0)
                ok = (more[..., :COARSE].sum(-1) <= 1) & (less[..., :COARSE].sum(-1) <= 1) & (more[..., COARSE:].sum(-1) <= 1) & (less[..., COARSE:].sum(-1) <= 1)
                q, k = np.nonzero(ok)
                if len(q):
                    yield part[q], k + low
            continue
        column = known[low:high, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        have = asked[who, level]
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, high - low], strict=True):
            diff = have - column[a]
            o, u = over + np.maximum(diff, 0), under + np.maximum(-diff, 0)
            ok = (o <= 1) & (u <= 1)
            stack.append((low + a, low + b, level + 1, who[ok], o[ok].astype(np.int8), u[ok].astype(np.int8)))


def near_in_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, n, near, near_n) in both directions for the pairs of a member and a query, or of two members."""
    member = pdf["member"].to_numpy(bool)
    members = pdf[member]
    words, counts = members["word"].tolist(), members["n"].to_numpy()
    out = {"word": [], "n": [], "near": [], "near_n": []}
    if words:
        known = vectors(words)
        order = np.lexsort(known.T[::-1])
        known, words, counts = known[order], [words[i] for i in order], counts[order]
        home = members["shard"].iat[0]
        del members
        asked, asked_n = pdf["word"].tolist(), pdf["n"].to_numpy()
        # a query from this very shard meets each other member once: the greater word asks
        own = pdf["home"].to_numpy() == home
        for q, k in trie_search(known, vectors(asked)):
            for i, j in zip(q.tolist(), k.tolist(), strict=True):
                a, b = asked[i], words[j]
                if (not own[i] or a > b) and one_edit(a, b):
                    out["word"] += [a, b]
                    out["n"] += [asked_n[i], counts[j]]
                    out["near"] += [b, a]
                    out["near_n"] += [counts[j], asked_n[i]]
    return pd.DataFrame({k: pd.Series(v, dtype="int64" if k.endswith("n") else "str") for k, v in out.items()})


def near_words(words: DataFrame, most: int = 10_000) -> DataFrame:
    """(word, n, near, near_n): every two distinct words one edit apart, in both directions.

    ``words``: distinct word, n and ``with_counts``' v, staged or cheap to read twice.  ``most``: members of a shard of the trie.
    """
    depth, largest = depth_for(words, most)
    return sharded(words, depth, largest, most).groupBy("shard", "block").applyInPandas(near_in_shard, "word string, n long, near string, near_n long")


def forms(words: DataFrame, pairs: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, the least by code points of equal ones, if n is ``times`` the word's."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("f"))).alias("b"))
    out = words.join(best, "word", "left")
    good = -F.col("b.m") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.f")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds ``root``, the end of a word's chain of forms: each round follows twice as many, until none goes on.

    Every form has a greater count, so chains end and are short.
    """
    links = stage(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        wider = stage(links.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "forms")
        links = wider.select("word", "root")
        if wider.where("moved").isEmpty():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, times: int = 5, drop_every: int = 199, most: int = 10_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text) with ``least_n`` occurrences or more.

    Equal rows count each; an empty table gives no row; columns other than the two have no part.
    """
    words = stage(with_counts(count_words(docs, least_chars, drop_every).where(F.col("n") >= least_n)), "spelling-words")
    found = stage(forms(words.drop("v"), near_words(words, most), times), "spelling-forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_trie(spark, sf_dir: str) -> DataFrame:
    """Spelling variants over all words of whole documents; see ``spelling_variants``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


_RUN = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+'))"
OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM (SELECT doc_id, {_RUN} AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
), {CRC32.format(keys="SELECT s FROM runs")},
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM runs JOIN crc_of USING (s)
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
  )
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word
), found AS (
  SELECT words.word, CASE WHEN top >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN top END AS form_n FROM words LEFT JOIN best USING (word)
), chain(word, tip, k) AS (
  SELECT word, word, 0 FROM found
  UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN found ON found.word = chain.tip WHERE form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(tip, k) FROM chain WHERE chain.word = found.word) AS root, n, n_near, form_n FROM found
"""
