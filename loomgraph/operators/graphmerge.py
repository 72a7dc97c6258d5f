"""Merging entity and relation mentions into one graph."""

from __future__ import annotations

import hashlib
import math
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.components import connected_components as label_components
from loomgraph.functions.text import blank_to_null, canonical_relation_type, normalize_name, short_sha1
from loomgraph.paths import has_cycle  # noqa: F401  (G18, one of this module's operators)
from loomgraph.runtime import new_path, stage


MOST_RESTS = 400  #: of one name for one length: above, names are matched by segments
MOST_LINKS = 4_000_000  #: between names alike that a turn decides, about
MOST_NAMES = 100_000  #: alike no first of former turns that one task decides in a turn, about


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the first in order: a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedupe_mentions(rows: DataFrame, names: list[str], prefix: str = "ent_") -> DataFrame:
    """The first mention per chunk and name (or both ends), with a stable id (G1).  Needs source_chunk_id and pos."""
    keys = ["source_chunk_id", *names]
    return _first(rows, keys, "pos").withColumn("mention_id", short_sha1(F.concat_ws("|", *keys), 24, prefix))


def canonical_entities(entities: DataFrame, by_type: bool = True) -> DataFrame:
    """One row per type and normalised name, or per normalised name alone: canonical_id, canonical_name, entity_type,
    norm_name, description, mentions and pos.  Only partial aggregates, so that a name may hold any share of all rows;
    ``entity_members`` has the ids.

    entities: entity_id, entity_name, entity_type, description, source_chunk_id, pos.
    """
    e = entities.withColumn("norm_name", normalize_name(F.col("entity_name")))
    keys = ["entity_type", "norm_name"] if by_type else ["norm_name"]
    out = e.groupBy(*keys).agg(
        F.min_by("entity_name", "pos").alias("canonical_name"),
        F.min_by("entity_type", "pos").alias("_type"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos"))).alias("description"),
        F.count("*").alias("mentions"),
        F.min("pos").alias("pos"),
    )
    out = out.withColumn("entity_type", F.col("_type")).drop("_type")
    return out.withColumn("canonical_id", short_sha1(F.concat_ws("|", "canonical_name", "entity_type"), 24, "canon_ent_"))


def entity_members(entities: DataFrame, canonical: DataFrame, by_type: bool = True) -> DataFrame:
    """(raw_id, canonical_id) of every mention: a row each, however many share a name."""
    e = entities.withColumn("norm_name", normalize_name(F.col("entity_name")))
    same = e["norm_name"] == canonical["norm_name"]
    same = same & e["entity_type"].eqNullSafe(canonical["entity_type"]) if by_type else same
    return e.join(canonical, same).select(e["entity_id"].alias("raw_id"), canonical["canonical_id"])


def merge_entities_exact(entities: DataFrame, by_type: bool = True) -> DataFrame:
    """``canonical_entities`` with arrays of names, ids and chunks (G3), or per normalised name alone (G7, with 64 source ids at most).

    Arrays hold a whole group; for groups of unbounded size take ``canonical_entities`` and ``entity_members``.
    """
    e = entities.withColumn("norm_name", normalize_name(F.col("entity_name")))
    keys = ["entity_type", "norm_name"] if by_type else ["norm_name"]
    ids = e if by_type else e.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("pos", "entity_id"))).where("_n <= 64")  # a partial limit comes before the shuffle
    of = ids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))).getField("entity_id").alias("merged_from"))
    sets = e.groupBy(*keys).agg(F.array_sort(F.collect_set("entity_name")).alias("source_names"), F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids"))
    out = canonical_entities(entities, by_type).join(sets.withColumnsRenamed({k: f"_{k}" for k in keys}), _same(keys)).drop(*[f"_{k}" for k in keys])
    return out.join(of.withColumnsRenamed({k: f"_{k}" for k in keys}), _same(keys)).drop(*[f"_{k}" for k in keys])


def _same(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def alias_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id): mentions of a type that share a normalised name or alias."""
    names = F.array_distinct(F.transform(F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize_name))
    keys = entities.select("entity_id", "entity_type", F.explode(names).alias("k")).where("k != ''")
    # a star per name: each mention links to the name's first, never to all others
    star = keys.join(keys.groupBy("entity_type", "k").agg(F.min("entity_id").alias("hub")), ["entity_type", "k"]).select("entity_id", "hub")
    comp = label_components(star, "entity_id", "hub")
    return entities.select("entity_id").join(comp, F.col("entity_id") == F.col("node"), "left").select("entity_id", F.coalesce("component", "entity_id").alias("group_id"))


@lru_cache(300_000)
def _matches(new: str, known: str) -> int:
    return sum(x.size for x in SequenceMatcher(None, new, known).get_matching_blocks())


def similar(new: str, known: str, threshold: float) -> bool:
    """Matching-blocks ratio, after bounds that cost little."""
    n, m = len(new), len(known)
    if 0 < n and 0 < m < 200:  # from 200 on the matcher leaves out frequent characters
        p = next((i for i, (x, y) in enumerate(zip(new, known)) if x != y), min(n, m))
        # all stretches of p + 1 of the new name hold the same middle: without it no block is longer than the common start, the
        # first block then, and what follows, much the same for many names, is matched by itself
        if 2 * p + 2 > n and p < min(n, m) and new[n - p - 1 : p + 1] not in known:
            return 2 * min(n, m) / (n + m) >= threshold and 2.0 * (p + _matches(new[p:], known[p:])) / (n + m) >= threshold
    found = SequenceMatcher(None, new, known)
    return found.real_quick_ratio() >= threshold and found.quick_ratio() >= threshold and found.ratio() >= threshold


def _errors(a: int, b: int, threshold: float) -> int:
    """Characters outside matching blocks, of both names together, that a ratio of ``threshold`` allows."""
    return int((1 - threshold) * (a + b) + 1e-9)


def _deletions(n: int, m: int, threshold: float) -> int | None:
    """Characters that a name of ``n`` can lose to what it shares with one of ``m`` at that ratio; None if lengths forbid it."""
    shared = math.ceil(threshold * (n + m) / 2 - 1e-9)
    return n - shared if 0 < shared <= min(n, m) else None


def _by_rest(n: int, m: int, threshold: float) -> bool:
    """Whether names of these lengths are matched by what deletions leave (few enough to list) rather than by segments."""
    d, e = _deletions(n, m, threshold), _deletions(m, n, threshold)
    return d is not None and e is not None and max(math.comb(n, d), math.comb(m, e)) <= MOST_RESTS


def _by_segment(n: int, lengths: list[int], threshold: float) -> list[int]:
    return [m for m in lengths if _deletions(n, m, threshold) is not None and not _by_rest(n, m, threshold)]


def name_rests(name: str, lengths: list[int], threshold: float) -> list[tuple[int, int, str]]:
    """(less length, greater length, rest) of all that deletions leave of a name.

    Names alike share a common subsequence at least as long as their matching blocks, so they share a rest.  Only as many names
    have one rest as there are ways to put deleted letters back, however many names begin alike.
    """
    n, out = len(name), set()
    for m in lengths:
        if _by_rest(n, m, threshold):
            left = n - _deletions(n, m, threshold)
            rests = (name[:i] + name[i + 1 :] for i in range(n)) if left == n - 1 else ("".join(x) for x in combinations(name, left))
            out |= {(min(n, m), max(n, m), x) for x in rests}
    return sorted(out)


def name_segments(name: str, lengths: list[int], threshold: float) -> list[tuple[int, int, str]]:
    """(length, number, segment): more segments than errors, so that one at least is whole in every name alike."""
    n = len(name)
    if not _by_segment(n, lengths, threshold):
        return []
    parts = _errors(n, int(n * (2 - threshold) / threshold), threshold) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(n, i, name[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def name_probes(name: str, lengths: list[int], threshold: float) -> list[tuple[int, int, str]]:
    """(length, number, text) of all that may be a segment of a name alike: lengths within the ratio, places within the errors."""
    out, n, low = set(), len(name), threshold / (2 - threshold)
    for m in _by_segment(n, lengths, threshold):
        parts = _errors(m, int(m / low), threshold) + 1
        cuts = [m * i // parts for i in range(parts + 1)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out |= {(m, i, name[s : s + b - a]) for s in range(max(0, a - parts + 1), min(n - (b - a), a + parts - 1) + 1)}
    return sorted(out)


def _lengths(names: DataFrame) -> list[int]:
    return sorted(r[0] for r in names.select(F.length("norm_name")).distinct().collect())  # lengths, not names


def _keyed(names: DataFrame, make, lengths: list[int], threshold: float, n: int | None = None) -> DataFrame:
    """(entity_type, norm_name, pos, key) of all keys that ``make`` lists for a name; ``n``: names, if so few that fewer tasks do."""

    def run(batches):
        for batch in batches:
            keys = [make(n, lengths, threshold) for n in batch.column("norm_name").to_pylist()]
            for a in range(0, len(keys), 256):  # a name may have hundreds
                rows = pa.array([i for i, k in enumerate(keys[a : a + 256], a) for _ in k], pa.int32())
                texts = pa.array([f"{size}:{no}:{text}" for k in keys[a : a + 256] for size, no, text in k], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, texts], [*batch.schema.names, "key"])

    # by a hash of the key, as what shares one by chance isn't alike; names are few for a file and keys many, so names are dealt first
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if n is None else max(1, min(parts, n // 5_000))
    made = names.repartition(parts, "norm_name").select("entity_type", "norm_name", "pos").mapInArrow(run, f"entity_type string, norm_name string, pos {dict(names.dtypes)['pos']}, key string")
    return made.withColumn("key", F.xxhash64("entity_type", "key"))


def _sought(name: str, lengths: list[int], threshold: float) -> list[tuple]:
    """What a name shares one of with every earlier name alike, which lists it by ``_listed``."""
    return [("r", *k) for k in name_rests(name, lengths, threshold)] + [("s", *k) for k in name_probes(name, lengths, threshold)]


def _listed(name: str, lengths: list[int], threshold: float) -> list[tuple]:
    return [("r", *k) for k in name_rests(name, lengths, threshold)] + [("s", *k) for k in name_segments(name, lengths, threshold)]


def alike_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(entity_type, norm_name, pos, earlier, before) of every two names alike, the earlier by pos and name second.

    names: entity_type, norm_name, pos, distinct and not null.  Candidates share a rest or a segment; only they are compared.
    """
    lengths = _lengths(names)
    keyed = lambda make: _keyed(names, make, lengths, threshold)
    # Spark takes keys for as few as names, and would broadcast them
    second = lambda df: df.withColumnsRenamed({"norm_name": "earlier", "pos": "before", "entity_type": "_type"}).hint("merge")
    rests = keyed(name_rests)
    pairs = rests.join(second(rests), "key")
    if any(_by_segment(n, lengths, threshold) for n in lengths):
        pairs = pairs.unionByName(keyed(name_probes).join(second(keyed(name_segments)), "key"))
    pairs = pairs.where("entity_type = _type")
    pairs = pairs.where("before < pos or (before = pos and earlier < norm_name)").select("entity_type", "norm_name", "pos", "earlier", "before").distinct()

    def alike(parts):
        for pdf in parts:
            yield pdf[[similar(a, b, threshold) for a, b in zip(pdf["norm_name"], pdf["earlier"], strict=True)]]

    return pairs.mapInPandas(alike, pairs.schema)


def first_names(near: DataFrame, most: int) -> DataFrame:
    """(no) of the names in ``near`` (no, before: numbers of two names alike, the earlier second) that no earlier first is alike.

    Blocks of names in order, of about ``most`` links each, are decided one after another; each link is read in its later name's turn only.
    Firsts of former blocks put off what they are alike; one task streams through the rest of the block and holds its firsts alone.
    """
    spark, folder = near.sparkSession, new_path(near.sparkSession, "firsts")
    # who has no earlier name alike is first; joins are by merge, else firsts would go to the driver each turn
    heads = near.select(F.col("before").alias("no")).distinct().join(near.select("no").hint("merge"), "no", "left_anti")
    heads.write.parquet(f"{folder}/turn=-1")
    sizes = near.groupBy(F.shiftright("no", 8).alias("bin")).agg(F.count("*").alias("n"))
    blocks = stage(sizes.select("bin", F.floor((F.sum("n").over(W.orderBy("bin")) - 1) / most).alias("block")), "blocks")  # a row for 256 names
    starts = [r.low << 8 for r in blocks.groupBy("block").agg(F.min("bin").alias("low")).orderBy("low").collect()]
    numbered = blocks.groupBy("block").agg(F.min("bin").alias("low")).select("block", (F.row_number().over(W.orderBy("low")) - 1).alias("turn"))  # a row a block
    turns = blocks.join(numbered, "block").select("bin", "turn")
    dealt = near.withColumn("bin", F.shiftright("no", 8)).join(turns.hint("merge"), "bin").select("no", "before", "turn")
    dealt = stage(dealt.repartition("turn", F.pmod("no", F.lit(8))), "links", ["turn"])

    def pick(batches):
        chosen = set()
        for pdf in batches:
            new = []
            for no, alike in zip(pdf["no"].tolist(), pdf["alike"], strict=True):
                if chosen.isdisjoint(alike.tolist()):
                    chosen.add(no)
                    new.append(no)
            yield pd.DataFrame({"no": new}, dtype="int64")

    known = lambda: spark.read.schema("no long").parquet(folder).select("no")
    for turn, low in enumerate(starts):
        now = dealt.where(F.col("turn") == turn).select("no", "before")
        told = now.join(known().select(F.col("no").alias("before"), F.lit(True).alias("first")).hint("merge"), "before", "left")
        left = told.groupBy("no").agg(F.bool_or(F.coalesce("first", F.lit(False))).alias("beaten"), F.collect_list(F.when(F.col("before") >= low, F.col("before"))).alias("alike"))
        picked = left.where("not beaten").select("no", "alike").repartition(1).sortWithinPartitions("no").mapInPandas(pick, "no long")
        picked.write.mode("overwrite").parquet(f"{folder}/turn={turn}")
    return known()


def _first_alike(names: DataFrame, listed: DataFrame, lengths: list[int], threshold: float, n: int) -> DataFrame:
    """(no, before): the least-numbered first alike of each name that has one; ``listed``: (key, before, earlier) of all keys of firsts.

    A name's candidates come in order and are compared until one is alike, which is mostly the first.
    """

    def run(batches):
        at = last = done = None
        for pdf in batches:
            nos, befores = [], []
            for no, before, name, earlier in zip(pdf["no"].tolist(), pdf["before"].tolist(), pdf["norm_name"], pdf["earlier"], strict=True):
                if no != at:
                    at, last, done = no, None, False
                if not done and before != last:
                    last = before
                    if similar(name, earlier, threshold):
                        done = True
                        nos.append(no)
                        befores.append(before)
            yield pd.DataFrame({"no": nos, "before": befores}, dtype="int64")

    keys = _keyed(names, lambda *a: [(k[0], k[1], k[2:]) for k in _sought(*a)], lengths, threshold, n).select("key", "norm_name", F.col("pos").alias("no"))
    met = keys.join(listed.hint("merge"), "key").select("no", "before", "norm_name", "earlier")
    return met.repartition("no").sortWithinPartitions("no", "before").mapInPandas(run, "no long, before long")


def _decided(names: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """(no, before) of names that no former first is alike, one after another in one task: the first among them that is alike, null for firsts."""

    def run(batches):
        listed, texts = {}, {}
        for pdf in batches:
            found = []
            for kind, name, no in zip(pdf["entity_type"], pdf["norm_name"], pdf["pos"].tolist(), strict=True):
                met = set().union(*[listed.get((kind, *k), ()) for k in _sought(name, lengths, threshold)])
                first = next((x for x in sorted(met) if similar(name, texts[x], threshold)), None)
                if first is None:
                    texts[no] = name
                    for k in _listed(name, lengths, threshold):
                        listed.setdefault((kind, *k), []).append(no)
                found.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(pdf["pos"].tolist(), pa.int64()), pa.array(found, pa.int64())], ["no", "before"])

    return names.repartition(1).sortWithinPartitions("pos").mapInArrow(lambda batches: run(x.to_pandas() for x in batches), "no long, before long")


def _groups_by_turns(names: DataFrame, total: int, threshold: float, turn: int) -> DataFrame | None:
    """(no, before) of all names by turns of names in order; None if the first turn shows that few are alike.

    names: entity_type, norm_name, pos, the last a number under ``total``.  A turn's names meet the keys of former firsts; those alike none of them, the fewer the
    more names are alike, go through one task.  Turns grow while these are few.  So names are compared with firsts only, not with all that are alike.
    """
    spark, lengths = names.sparkSession, _lengths(names)
    folder, at, size, no = new_path(spark, "turns"), 0, turn // 5 + 1, 0
    listed = lambda: spark.read.schema("key long, before long, earlier string").parquet(f"{folder}/listed")
    while at < total:
        end = min(at + size, total)
        block = names.where((F.col("pos") >= at) & (F.col("pos") < end))
        left = block
        if no:
            beaten = stage(_first_alike(block, listed(), lengths, threshold, end - at), "beaten")
            left = stage(block.join(beaten.select(F.col("no").alias("pos")).hint("merge"), "pos", "left_anti").select(names.columns), "left")
            n = left.count()
            if n > 2 * turn:  # the rest waits for the next turn
                end = left.agg(F.percentile_approx("pos", turn / n)).first()[0] + 1
                left, beaten = left.where(F.col("pos") < end), beaten.where(F.col("no") < end)
            beaten.write.parquet(f"{folder}/best/turn={no}/by=former")
        _decided(left, lengths, threshold).write.parquet(f"{folder}/best/turn={no}/by=own")
        own = spark.read.schema("no long, before long").parquet(f"{folder}/best/turn={no}/by=own")
        firsts = stage(left.join(own.where("before is null").select(F.col("no").alias("pos")).hint("merge"), "pos", "left_semi").select(names.columns), "firsts")
        many = firsts.count()
        if not no and end < total and 2 * many > own.count():
            return None
        _keyed(firsts, lambda *a: [(k[0], k[1], k[2:]) for k in _listed(*a)], lengths, threshold, many).select("key", F.col("pos").alias("before"), F.col("norm_name").alias("earlier")).write.parquet(f"{folder}/listed/turn={no}")
        if no:
            size = max(turn // 5 + 1, min(2 * size, size * turn // max(1, n), 10 * turn))
        at, no = end, no + 1
    return spark.read.schema("no long, before long").option("recursiveFileLookup", True).parquet(f"{folder}/best") if no else None


def fuzzy_groups(names: DataFrame, threshold: float = 0.9, most: int = MOST_LINKS, turn: int = MOST_NAMES) -> DataFrame:
    """(entity_type, norm_name, group_name): greedy, first group in order of pos whose first name is alike.

    ``names`` holds distinct names.  Thresholds under 0.7 would make segments empty and are an error; null names are left out.
    Where most names of the first turn are alike others, names meet firsts only; else all links between names alike are listed, which are few then.
    """
    if not 0.7 <= threshold <= 1:
        raise ValueError("the threshold must be from 0.7 to 1")
    given = names.where("norm_name is not null").select("entity_type", F.coalesce("entity_type", F.lit("")).alias("kind"), "norm_name", "pos")
    # numbers rise in order of pos and name; links hold numbers only
    given = stage(given.orderBy("kind", "pos", "norm_name").withColumn("no", F.monotonically_increasing_id()), "names")
    # without gaps, by the number of names in each part that Spark has numbered
    parts, total, begin = given.groupBy(F.shiftright("no", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect(), 0, []
    for part, n in parts:
        begin += [F.lit(part), F.lit(total)]
        total += n
    if parts:
        given = stage(given.withColumn("no", F.element_at(F.create_map(*begin), F.shiftright("no", 33)) + F.col("no").bitwiseAND(F.lit((1 << 33) - 1))), "names")
    placed = given.where("pos is not null").select(F.col("kind").alias("entity_type"), "norm_name", F.col("no").alias("pos"))
    best = _groups_by_turns(placed, total, threshold, turn)
    if best is None:
        near = stage(alike_pairs(placed, threshold).select(F.col("pos").alias("no"), "before"), "alike")
        firsts = first_names(near, most).withColumnRenamed("no", "before")
        best = near.join(firsts.hint("merge"), "before", "left_semi").groupBy("no").agg(F.min("before").alias("before"))
    best = best.where("before is not null")
    out = given.join(best.hint("merge"), "no", "left").join(given.select(F.col("no").alias("before"), F.col("norm_name").alias("earlier")).hint("merge"), "before", "left")
    return out.select("entity_type", "norm_name", F.coalesce("earlier", "norm_name").alias("group_name"))


def merge_entities(entities: DataFrame, strategy: str = "normalize", threshold: float = 0.9) -> DataFrame:
    """G3-G5 as one: names (any strategy), then aliases (normalize, alias, embedding), then ratio (normalize, fuzzy)."""
    exact = stage(merge_entities_exact(entities), "entities")
    group = exact.select("entity_type", "norm_name", F.col("norm_name").alias("group_name"))
    if strategy in ("normalize", "fuzzy"):
        group = fuzzy_groups(exact, threshold)
    if strategy in ("normalize", "alias", "embedding") and "aliases" in entities.columns:
        members = exact.join(group, ["entity_type", "norm_name"]).select(F.explode("merged_from").alias("entity_id"), "entity_type", "group_name")
        ids = alias_groups(entities)
        linked = members.join(ids, "entity_id")
        edges = linked.select(F.struct("entity_type", "group_name").alias("a"), F.col("group_id"))
        hubs = edges.groupBy("group_id").agg(F.min("a").alias("b"))
        comp = label_components(edges.join(hubs, "group_id").select(F.to_json("a").alias("a"), F.to_json("b").alias("b")), "a", "b")
        group = group.join(comp, F.to_json(F.struct("entity_type", "group_name")) == F.col("node"), "left").select(
            "entity_type", "norm_name", F.coalesce(F.get_json_object("component", "$.group_name"), "group_name").alias("group_name")
        )
    g = exact.join(group, ["entity_type", "norm_name"])
    return (
        g.groupBy("entity_type", "group_name")
        .agg(
            F.min_by("canonical_name", "pos").alias("canonical_name"),
            F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos"))).alias("description"),
            F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "source_names"))).getField("source_names"))).alias("source_names"),
            F.flatten(F.array_sort(F.collect_list(F.struct("pos", "merged_from"))).getField("merged_from")).alias("merged_from"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids")))).alias("source_chunk_ids"),
            F.min("pos").alias("pos"),
        )
        .withColumn("canonical_id", short_sha1(F.concat_ws("|", "canonical_name", "entity_type"), 24, "canon_ent_"))
        .drop("group_name")
    )


def entity_merge_map(canonical: DataFrame) -> DataFrame:
    return canonical.select(F.explode("merged_from").alias("raw_id"), "canonical_id")  # G6


def resolve_endpoints(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Ends through (raw, canonical_id): as written, else normalised, else unchanged; blank ends go."""
    raw = names.groupBy("raw").agg(F.min("canonical_id").alias("by_raw"))
    norm = names.groupBy(normalize_name(F.col("raw")).alias("norm")).agg(F.min("canonical_id").alias("by_norm"))
    out = relations
    for end in ("source_entity", "target_entity"):
        out = (
            out.join(raw, F.col(end) == F.col("raw"), "left").join(norm, normalize_name(F.col(end)) == F.col("norm"), "left")
            .withColumn(end, F.coalesce("by_raw", "by_norm", end)).drop("raw", "by_raw", "norm", "by_norm")
        )
    return out.where(blank_to_null(F.col("source_entity")).isNotNull() & blank_to_null(F.col("target_entity")).isNotNull())


def merge_relations(relations: DataFrame, arrays: bool = True) -> DataFrame:
    """One row per source, target and canonical type: greatest weight, longest description, mentions, ids.

    ``arrays=False`` leaves out the lists of ids and chunks, which hold a whole group.
    """
    r = relations.withColumn("relation_type", canonical_relation_type(F.col("relation_type")))
    lists = [F.array_sort(F.collect_list("relation_id")).alias("merged_from"), F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids")] if arrays else []
    out = r.groupBy("source_entity", "target_entity", "relation_type").agg(
        F.max("weight").alias("weight"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos"))).alias("description"),
        F.count("*").alias("mentions"),
        F.min("pos").alias("pos"),
        *lists,
    )
    return out.withColumn("canonical_id", short_sha1(F.concat_ws("|", "source_entity", "target_entity", "relation_type"), 24, "canon_rel_"))


def fuzzy_relation_types(relations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Relation types of a pair that are alike take the first one's name.

    Only pairs of several spellings go through Python.  These come to a task in order, many pairs in a batch, so that memory holds a
    batch and the groups of one pair.
    """
    ends = ["source_entity", "target_entity"]

    def run(batches):
        alike = lru_cache(100_000)(lambda new, known: similar(new, known, threshold))
        at, known = None, []
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in (*ends, "kind")]
            firsts = []
            for s, t, kind in zip(*rows, strict=True):
                if at != (s, t):
                    at, known = (s, t), []
                found = next((k for k in known if alike(kind, k)), None)
                if found is None:
                    known.append(kind)
                firsts.append(kind if found is None else found)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*ends, "spelling")], pa.array(firsts, pa.string())], names)

    names = ["_s", "_t", "_spelling", "group_type"]
    spellings = relations.groupBy(*ends, F.col("relation_type").alias("spelling")).agg(F.min("pos").alias("pos")).withColumn("kind", canonical_relation_type(F.col("spelling")))
    several = spellings.where("kind is not null").withColumn("_n", F.count("*").over(W.partitionBy(*ends))).where("_n > 1")
    groups = several.sortWithinPartitions(*ends, "pos", "kind").select(*ends, "spelling", "kind").mapInArrow(run, ", ".join(f"{n} string" for n in names))
    same = [relations[c].eqNullSafe(groups[n]) for c, n in zip((*ends, "relation_type"), names, strict=False)]
    # no broadcast: a pair's rows may be as many as the relations
    out = relations.join(groups.hint("merge"), same, "left")
    return out.withColumn("relation_type", F.coalesce("group_type", canonical_relation_type(F.col("relation_type")))).select(*relations.columns)


def build_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): ends looked up by normalised id or name, missing ones created.

    entities: entity_id, entity_name, description, source_chunk_ids, pos; the last of equal keys wins.
    """
    e = entities.groupBy("entity_id").agg(
        F.max_by("entity_name", "pos").alias("entity_name"), F.max_by("description", F.length(F.coalesce("description", F.lit("")))).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids")))).alias("source_chunk_ids"), F.max("pos").alias("pos"),
    )
    keys = e.select("entity_id", "pos", F.explode(F.array(normalize_name(F.col("entity_id")), normalize_name(F.col("entity_name")))).alias("k"))
    lookup = keys.where("k != ''").groupBy("k").agg(F.max_by("entity_id", F.struct("pos", "entity_id")).alias("found"))
    r = relations
    for end in ("source_entity", "target_entity"):
        r = r.join(lookup, normalize_name(F.col(end)) == F.col("k"), "left").withColumn(end, F.coalesce("found", end)).drop("k", "found")
    ends = r.select(F.explode(F.array("source_entity", "target_entity")).alias("entity_id"), "source_chunk_ids")
    refs = ends.groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids"))).alias("_refs"))
    out = e.join(refs, "entity_id", "full").select(
        "entity_id", F.coalesce("entity_name", "entity_id").alias("entity_name"), "description",
        F.array_sort(F.array_distinct(F.concat(F.coalesce("source_chunk_ids", F.array().cast("array<string>")), F.coalesce("_refs", F.array().cast("array<string>"))))).alias("source_chunk_ids"),
        F.col("pos").isNull().alias("auto_created"),
    )
    return out, r


def drop_isolated(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G13."""
    used = relations.select(F.explode(F.array("source_entity", "target_entity")).alias("entity_id")).distinct()
    kept = entities.join(used, "entity_id", "left_semi")
    ids = kept.select("entity_id")
    for end in ("source_entity", "target_entity"):
        relations = relations.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    return kept, relations


def graph_components(entities: DataFrame, relations: DataFrame, preserve_all: bool = False) -> DataFrame:
    """(component_id, entity_id, least) for every entity, and the sizes by ``component_summary``.

    The id hashes the component's sorted ids, as ``component_ids`` makes it for components that fit an
    array; rows here carry the least id, whatever the size.
    """
    if preserve_all:
        return entities.select("entity_id", F.col("entity_id").alias("least"))
    comp = label_components(relations, "source_entity", "target_entity")
    return entities.select("entity_id").distinct().join(comp, F.col("entity_id") == F.col("node"), "left").select("entity_id", F.coalesce("component", "entity_id").alias("least"))


def component_sizes(membership: DataFrame, relations: DataFrame) -> DataFrame:
    """(least, entity_count, relation_count) of each component, whatever its size; members are ``membership``'s rows."""
    of = membership.select(F.col("entity_id").alias("source_entity"), "least")
    rel = relations.join(of, "source_entity").groupBy("least").agg(F.count_distinct("relation_id").alias("relation_count"))
    return membership.groupBy("least").agg(F.count_distinct("entity_id").alias("entity_count")).join(rel, "least", "left").fillna(0, "relation_count")


def component_summary(membership: DataFrame, relations: DataFrame) -> DataFrame:
    """component_id = comp_ + sha1 of the sorted ids, entity ids, relation ids and counts.

    The id is a hash of all ids, so a component is one array here; for components of unbounded size take
    ``component_sizes``.
    """
    of = membership.select(F.col("entity_id").alias("source_entity"), "least")
    rel = relations.join(of, "source_entity").groupBy("least").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    ent = membership.groupBy("least").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    out = ent.join(rel, "least", "left").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))
    return out.select(short_sha1(F.array_join("entity_ids", "|"), 12, "comp_").alias("component_id"), "entity_ids", "relation_ids", F.size("entity_ids").alias("entity_count"), F.size("relation_ids").alias("relation_count"))


def component_ids(membership: DataFrame) -> DataFrame:
    """(least, component_id, entity_count) of each component, by a digest that runs over its sorted ids.

    Ids are ``component_summary``'s.  Rows of a component come to a task in order and go through the digest one after the other, so
    memory holds a batch, however large a component is.
    """

    def run(batches):
        least, state, n = None, None, 0
        for batch in batches:
            done = []
            for key, name in zip(batch.column("least").to_pylist(), batch.column("entity_id").to_pylist(), strict=True):
                if state is None or key != least:
                    if state is not None:
                        done.append((least, f"comp_{state.hexdigest()[:12]}", n))
                    least, state, n = key, hashlib.sha1(), 0
                state.update(f"{'|' if n else ''}{name}".encode())
                n += 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], shape)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (least, f"comp_{state.hexdigest()[:12]}", n), strict=True))], shape)

    names = ["least", "component_id", "entity_count"]
    shape = pa.schema([("least", pa.string()), ("component_id", pa.string()), ("entity_count", pa.int64())])
    rows = membership.select(F.col("least").cast("string"), F.col("entity_id").cast("string")).where("least is not null and entity_id is not null").distinct()
    return rows.repartition("least").sortWithinPartitions("least", "entity_id").mapInArrow(run, "least string, component_id string, entity_count long")


def graph_summary(entities: DataFrame, relations: DataFrame, membership: DataFrame) -> DataFrame:
    """G15."""
    used = relations.select(F.explode(F.array("source_entity", "target_entity")).alias("entity_id")).distinct()
    parts = [("entities", entities.agg(F.count("*").alias("n"))), ("relations", relations.agg(F.count("*").alias("n"))), ("components", membership.agg(F.count_distinct("least").alias("n"))), ("isolated", entities.join(used, "entity_id", "left_anti").agg(F.count("*").alias("n")))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def build_process_graph(sections: DataFrame, steps: DataFrame, parts: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents, sections, steps and what blocks mention.

    ``parts``: label (Constraint, Tool, Material, Inspection, Table) to a frame with doc_id, seq and its name column.
    """
    ident = lambda label, *cols: F.concat_ws(":", F.lit(label), *[c.cast("string") for c in cols])
    doc, c = ident("Document", F.col("doc_id")), F.col
    named = [("Section", sections, ident("Section", c("doc_id"), c("section_id")), c("title"), "CONTAINS"), ("ProcessStep", steps, ident("ProcessStep", c("doc_id"), c("step_id")), c("name"), "CONTAINS")]
    kinds = {"Constraint": "CONSTRAINT_OF"}
    named += [(k, df, ident(k, c("doc_id"), c("seq"), c(n)), c(n), kinds.get(k, "REFERENCES")) for k, (df, n) in parts.items()]
    nodes = edges = None
    # edges are made distinct by their document and what names the other end in it, which is narrower than their texts; labels and types keep sources apart
    tail = lambda *cols: F.concat_ws(":", *[x.cast("string") for x in cols])
    within = lambda label: F.when(F.col("_tail").isNull(), ident(label, c("doc_id"))).otherwise(ident(label, c("doc_id"), c("_tail")))
    tails = {"Section": c("section_id").cast("string"), "ProcessStep": c("step_id").cast("string")} | {k: F.when(c("seq").isNotNull() | c(n).isNotNull(), tail(c("seq"), c(n))) for k, (_, n) in parts.items()}
    for label, df, node, name, kind in named:
        n = df.select(node.alias("id"), F.lit(label).alias("label"), name.cast("string").alias("name")).unionAll(df.select(doc, F.lit("Document"), c("doc_id").cast("string")))
        e = df.select("doc_id", tails[label].alias("_tail")).distinct().select(doc.alias("src"), within(label).alias("dst"), F.lit(kind).alias("type"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionAll(n), edges.unionAll(e))
    step = lambda col: F.when(c("doc_id").isNotNull() | c(col).isNotNull(), tail(c("doc_id"), c(col)))
    for a, b, kind in (("before", "step_id", "BEFORE"), ("step_id", "next_step", "NEXT_STEP")):
        pairs = steps.where(c(a if kind == "BEFORE" else b) != "").select(step(a).alias("_a"), step(b).alias("_b")).distinct()
        edges = edges.unionAll(pairs.select(ident("ProcessStep", c("_a")).alias("src"), ident("ProcessStep", c("_b")).alias("dst"), F.lit(kind).alias("type")))
    return nodes.distinct(), edges


def attach_chunk_refs(nodes: DataFrame, chunks: DataFrame, cap: int = 200, document_cap: int = 120) -> DataFrame:
    """Chunk ids by any shared link key, distinct in order, capped; a document without any gets its first ones.

    nodes: id, label, doc_id, keys ARRAY; chunks: chunk_id, doc_id, pos, keys ARRAY.
    """
    n = nodes.select("id", F.explode(F.array_distinct("keys")).alias("k"))
    k = chunks.select("chunk_id", "pos", F.explode(F.array_distinct("keys")).alias("k"))
    # a chunk that ``cap`` others of its key come before can't be among a node's first ones
    k = k.withColumn("_n", F.row_number().over(W.partitionBy("k").orderBy("pos", "chunk_id"))).where(F.col("_n") <= cap).drop("_n")
    pairs = n.join(k, "k").groupBy("id", "chunk_id").agg(F.min("pos").alias("pos"))
    first = lambda df, by, most: (
        df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("pos", "chunk_id"))).where(F.col("_n") <= most)
        .groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).getField("chunk_id").alias("chunk_ids"))
    )
    out = nodes.join(first(pairs, "id", cap), "id", "left")
    whole = first(chunks.select("doc_id", "chunk_id", "pos"), "doc_id", document_cap).withColumnRenamed("chunk_ids", "_doc")
    return out.join(whole, "doc_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.when(F.col("label") == "Document", F.col("_doc")))).drop("_doc")


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, new rows winning ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = old.columns
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_new", order)).alias("_r")).select("_r.*")


def normalize_edges(edges: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Upper-case types through an alias map; label from label or the first of labels."""
    t = F.upper(F.trim("type"))
    names = F.create_map(*[F.lit(x.upper()) for kv in aliases.items() for x in kv]) if aliases else None
    out = edges.withColumn("type", F.coalesce(F.try_element_at(names, t), t) if names is not None else t)
    return out.withColumn("label", F.coalesce(blank_to_null(F.col("label")), F.get("labels", F.lit(0)))) if "labels" in edges.columns else out
