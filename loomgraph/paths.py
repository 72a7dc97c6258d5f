"""Reachability in directed graphs: closures, paths from bound starts, circles.  Rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, stage


def transitive(pairs: DataFrame, a: str, b: str, name: str = "closure") -> DataFrame:
    """Distinct (a, b) for every path of one or more edges, by doubling with deltas.

    Each known pair holds its least distance.  A round joins the pairs of distance exactly 2^r with all known, which gives those of
    2^r + 1 to 2^(r + 1), and keeps what is new: rows are in proportion to the result, rounds to the logarithm of the longest
    distance.  Circles end, since distances don't grow for ever; null ends are left out.
    """
    first = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    known, reach = stage(first.withColumn("d", F.lit(1)), name), 1
    while True:
        far = known.where(F.col("d") == reach).select("a", F.col("b").alias("m"), F.col("d").alias("e"))
        on = known.select(F.col("a").alias("m"), "b", "d")
        both = far.join(on, "m").select("a", "b", (F.col("d") + F.col("e")).alias("d")).unionByName(known)
        new = stage(both.groupBy("a", "b").agg(F.min("d").alias("d")).where(F.col("d") > reach), name)
        known, reach = known.unionByName(new), 2 * reach
        if new.where(F.col("d") == reach).isEmpty():  # then no pair is farther
            return known.select(F.col("a").alias(a), F.col("b").alias(b))


def _pairs_through(edges: DataFrame) -> int:
    """Rows of ``edges`` joined with itself, end to start, without the join.

    Here and in what doubles walks, joins are by merge: tables that shrink by turns would each be sent to the driver to be broadcast.
    """
    out = edges.groupBy(F.col("a").alias("m")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("b").alias("m")).agg(F.count("*").alias("i"))
    return out.join(into.hint("merge"), "m").agg(F.sum(F.col("o") * F.col("i")).alias("n")).first().n or 0


def jumps_doubled(jumps: DataFrame, most: int, name: str) -> DataFrame | None:
    """(a, b) of two jumps after each other, or None if those would be over ``most`` rows before the distinct."""
    if _pairs_through(jumps) > most:
        return None
    return stage(_after_each_other(jumps).distinct(), name)


def _after_each_other(jumps: DataFrame) -> DataFrame:
    hop = jumps.select(F.col("a").alias("m"), F.col("b").alias("f"))
    return jumps.join(hop.hint("merge"), F.col("b") == F.col("m")).select("a", F.col("f").alias("b"))


def _one_sided(edges: DataFrame, name: str) -> DataFrame | None:
    """Distinct ``edges`` if each a has one b or each b has one a, as in chains and hierarchies, else None."""
    for key, end in (("a", "b"), ("b", "a")):
        ends = stage(edges.groupBy(key).agg(F.min(end).alias(end), F.max(end).alias("other")), name)
        if ends.where(F.col(end) != F.col("other")).isEmpty():
            return ends.select("a", "b")
        discard(ends)
    return None


def _reach_one_sided(edges: DataFrame, starts: DataFrame, name: str) -> DataFrame | None:
    """Distinct (s, n) over one or more ``edges`` of ``_one_sided``, or None if some of them close a circle.

    Of such edges, jumps of 2^r are never more than the edges and get fewer with each r until none is left; where they don't, the rest run
    in circles.  Without circles one walk at most leads from a node to another, so that nothing has to be made distinct: a distance is
    a sum of different jumps, and the longest go first, while there are few pairs.
    """
    by_length, n = [edges], edges.count()
    while n:
        longer = stage(_after_each_other(by_length[-1]), name)
        m = longer.count()
        if m == n:
            for made in by_length[1:] + [longer]:
                discard(made)
            return None
        by_length, n = by_length + [longer] * bool(m), m
    found = starts.select("s", F.col("s").alias("n"))
    for jumps in reversed(by_length):
        on = found.join(jumps.hint("merge"), F.col("n") == F.col("a")).select("s", F.col("b").alias("n"))
        last, found = found, found.unionByName(on)
        if jumps is not edges:
            found = stage(found, name)
            discard(last)
            discard(jumps)
    return found.where("s != n")


def reach(edges: DataFrame, starts: DataFrame, a: str, b: str, shallow: int = 8, name: str = "reach", many: int = 16) -> DataFrame:
    """Distinct (a, b): what each start reaches over one or more edges.  ``starts`` has a column ``a``.

    A frontier of (start, node) pairs goes on by one edge a round and meets the edges alone, so only reached nodes are
    touched.  A path longer than ``shallow`` edges takes longer and longer jumps: pairs of nodes 2^r edges apart, made from the
    former ones as long as they are at most four times the edges, which they are in chains and hierarchies; where they aren't, graphs
    spread fast, so that few rounds are left.  Starts that are many (one in ``many`` edges) reach most edges anyway; then chains and
    hierarchies are doubled from the first round on.
    """
    step = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    starts = starts.where(F.col(a).isNotNull()).select(F.col(a).alias("s")).distinct()
    if many * starts.count() >= step.count() and (chains := _one_sided(step, name)) is not None:
        found = _reach_one_sided(chains, starts, name)
        if found is not None:
            return found.select(F.col("s").alias(a), F.col("n").alias(b))
    reached = stage(starts.join(step, F.col("s") == F.col("a")).select("s", F.col("b").alias("n")).distinct().withColumn("d", F.lit(1)), name)
    jumps, stride, covered, most, rounds = step, 1, 1, None, 0
    while True:
        # what is farther than ``covered`` from a start is one jump after a node of the last ``stride`` layers
        last = reached.where(F.col("d") > covered - stride)
        if stride == covered:  # then the start itself is such a node
            last = last.unionByName(starts.select("s", F.col("s").alias("n"), F.lit(0).alias("d")))
        new = last.join(jumps, F.col("n") == F.col("a")).groupBy("s", F.col("b").alias("n")).agg(F.min("d").alias("d")).withColumn("d", F.col("d") + stride)
        new = stage(new.join(reached, ["s", "n"], "left_anti").select("s", "n", "d"), name)
        if new.isEmpty():
            return reached.select(F.col("s").alias(a), F.col("n").alias(b))
        reached, covered, rounds = reached.unionByName(new), covered + stride, rounds + 1
        if rounds == shallow:
            jumps = stage(step.distinct(), name)
            most = 4 * jumps.count()
        if rounds >= shallow and most:
            longer = jumps_doubled(jumps, most, name)
            if longer is None:
                most = None
            else:
                jumps, stride = longer, 2 * stride
        if rounds % 16 == 0:
            reached = stage(reached, name)


def roots_of(links: DataFrame, a: str, b: str, name: str = "roots") -> DataFrame:
    """(a, b) with b the end of a's chain, by pointer doubling.  Each a has one b, and no chain may close a circle."""
    now = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")), name)
    while True:
        on = now.select(F.col("a").alias("b"), F.col("b").alias("_far"))
        now = stage(now.join(on, "b", "left").select("a", F.coalesce("_far", "b").alias("b"), F.col("_far").isNotNull().alias("moved")), name)
        if now.where("moved").isEmpty():
            return now.select(F.col("a").alias(a), F.col("b").alias(b))
        now = now.select("a", "b")


def on_circles(links: DataFrame, a: str, b: str, name: str = "circles") -> DataFrame:
    """(a) of all that lie on a circle, where each a has one b: what jumps of as many links as there are end at."""
    now, far = stage(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")), name), 1
    n = now.count()
    while far <= n and not now.isEmpty():
        on = now.select(F.col("a").alias("b"), F.col("b").alias("_far"))
        now, far = stage(now.join(on, "b").select("a", F.col("_far").alias("b")), name), 2 * far
    return now.select(F.col("b").alias(a)).distinct()


def _split_at_pivots(edges: DataFrame, turn: int) -> DataFrame | None:
    """Edges (a, b, label) without those that no circle can hold, or None if a pivot reaches itself.

    A label is a set of nodes that holds every circle of its nodes whole.  One pivot each, drawn by a hash, parts it in what the
    pivot reaches, what reaches it, and the rest; a circle that avoids the pivot lies in one of the three.
    """
    drawn = F.struct(F.xxhash64("a", F.lit(turn)), F.col("a"))
    pivots = stage(edges.groupBy("label").agg(F.min(drawn).alias("x")).select(F.col("x.a").alias("pivot")), "pivots")
    start = pivots.select(F.col("pivot").alias("a"))
    ahead = reach(edges, start, "a", "b", name="ahead").select(F.col("a").alias("pivot"), F.col("b").alias("node"))
    if not ahead.where("pivot = node").isEmpty():
        return None
    behind = reach(edges, start.withColumnRenamed("a", "b"), "b", "a", name="behind").select(F.col("b").alias("pivot"), F.col("a").alias("node"))
    text = lambda side: F.concat(F.lit(side), F.col("pivot").cast("string"))
    own = lambda df, end: df.withColumnsRenamed({"node": end, "side": f"side_{end}"})
    sides = stage(
        ahead.select("node", text("f").alias("side")).unionAll(behind.select("node", text("b"))).unionAll(pivots.select(F.col("pivot").alias("node"), F.lit("pivot").alias("side"))), "sides"
    )
    out = edges.join(own(sides, "a"), "a", "left").join(own(sides, "b"), "b", "left")
    inside = F.col("side_a").eqNullSafe(F.col("side_b")) & ~F.coalesce(F.col("side_a") == "pivot", F.lit(False))
    return out.where(inside).select("a", "b", F.coalesce("side_a", F.concat(F.lit("r"), "label")).alias("label"))


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst", spread: int = 8) -> bool:
    """Whether directed edges close a circle (G18).  Null ends are left out; an empty table has none.

    Pairs of nodes 2^r edges apart come from those before: none left means no circle, one node at both ends means a circle, as does
    a walk of more edges than there are.  Where such pairs would outgrow the edges ``spread`` times, only edges between nodes
    that begin and end walks of the length reached stay, which trims that many layers at once, and pivots part what is left.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    now, turn = stage(given.withColumn("label", F.lit("")), "cycle"), 0
    while True:
        n = now.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("loops")).first()
        if n.loops or not n.n:
            return bool(n.loops)
        walks, length = now.select("a", "b"), 1
        while (longer := jumps_doubled(walks, spread * n.n, "walks")) is not None:
            m = longer.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("loops")).first()
            walks, length = longer, 2 * length
            if m.loops or not m.n or length > n.n:
                return bool(m.n)
        on = stage(walks.select("a").distinct().join(walks.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi"), "cycle")
        kept = stage(now.join(on.hint("merge"), "a", "left_semi").join(on.withColumnRenamed("a", "b").hint("merge"), "b", "left_semi").select("a", "b", "label"), "cycle")
        if 2 * kept.count() > n.n:
            kept, turn = _split_at_pivots(kept, turn), turn + 1
            if kept is None:
                return True
            kept = stage(kept, "cycle")
        now = kept
