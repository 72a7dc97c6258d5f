"""Mixing to target weights: iterative proportional fitting over source, language and topic.

Everything is DataFrame work.  Documents are summed to cells, one for each combination of the three; fitting
scales the cells to one marginal after the other, and no cell beyond what it holds; each document is then
kept with its cell's probability, by a hash of its id and text.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import stage, table

DIMENSIONS = ("source", "lang", "topic")

#: Subjects and the terms that tell of them, in lower case: words, or signs without a letter that may stand anywhere.
TOPICS = {
    "law": ["license", "licensed", "copyright", "rights", "warranty", "liability", "law", "gesetz", "urheberrecht", "loi", "droits", "ley", "derechos"],
    "computing": ["software", "computer", "function", "import", "return", "server", "api", "rechner", "logiciel", "ordinateur", "código", "servidor"],
    "contact": ["@", "://", "phone", "e-mail", "email", "address", "call", "telefon", "anschrift", "téléphone", "adresse", "teléfono", "dirección"],
    "security": ["password", "token", "secret", "key", "login", "passwort", "schlüssel", "clé", "contraseña", "clave"],
    "science": ["experiment", "theory", "physics", "chemistry", "biology", "energy", "energie", "énergie", "energía", "theorie", "théorie", "teoría"],
    "economy": ["market", "price", "company", "trade", "bank", "markt", "preis", "marché", "prix", "mercado", "precio", "empresa"],
    "tables": ["|"],
}


def words_of(text: Column) -> Column:
    """Lower-case pieces between single ASCII white space, empty ones among them."""
    spaced = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), "\t\n\x0b\x0c\r", F.lower(F.coalesce(text, F.lit(""))))
    return F.split(spaced, " ")


def _once(value: Column, use) -> Column:
    """``use`` of a costly value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def tokens_and_topic(text: Column, topics: dict[str, list[str]]) -> Column:
    """(tokens, topic): words between ASCII white space, none in null; and the topic most of whose terms occur, the
    first of equals, ``general`` without any.  A word may end in a comma, stop, colon or semicolon."""
    signs = {x: F.contains(text, F.lit(x)) for terms in topics.values() for x in terms if not any(c.isalnum() for c in x)}
    ends = ("", ",", ".", ":", ";")
    known = F.array(*[F.lit(x + e) for x in sorted({x for terms in topics.values() for x in terms} - set(signs)) for e in ends])

    def hits(found, terms):
        words = [x + e for x in terms if x not in signs for e in ends]
        parts = [F.coalesce(signs[x].cast("int"), F.lit(0)) for x in terms if x in signs] + [F.size(F.array_intersect(found, F.array(*map(F.lit, words))))] * bool(words)
        return reduce(lambda a, b: a + b, parts)

    names = F.array(*map(F.lit, topics))
    pick = lambda n: F.when(F.array_max(n) == 0, F.lit("general")).otherwise(F.element_at(names, F.array_position(n, F.array_max(n)).cast("int")))
    of = lambda found: _once(F.array(*[hits(found, terms) for terms in topics.values()]), pick)
    return _once(words_of(text), lambda w: F.struct(F.size(F.array_remove(w, "")).cast("long").alias("tokens"), _once(F.array_intersect(w, known), of).alias("topic")))


def fill(rows: DataFrame, budget: float = 1.0) -> DataFrame:
    """``share``: proportional to ``target`` but at most ``most``, with sum ``budget`` (or all there is).

    The factor rises until nothing more is full; what is full stays so, so the loop ends.
    """
    factor, full = 0.0, -1.0
    while True:
        at_most = F.col("target") * factor >= F.col("most")
        r = rows.agg(F.sum(F.when(at_most, F.col("most")).otherwise(0.0)).alias("whole"), F.sum(F.when(at_most, 0.0).otherwise(F.col("target"))).alias("open")).first()
        if r["whole"] is None or not r["open"] or (factor and r["whole"] <= full):
            break
        full = r["whole"]
        factor = max(factor, (budget - r["whole"]) / r["open"])
    if r["whole"] is not None and not r["open"]:  # nothing is open: every row is full
        factor = float("inf")
    share = F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.col("most"), F.col("target") * F.lit(factor)))
    return rows.withColumn("share", share)


def feasible_targets(cells: DataFrame, dim: str, targets: DataFrame) -> DataFrame:
    """(value, target, share): ``target`` as given, scaled to sum 1 over values that have tokens; ``share`` no more
    than the value's cells hold together (column ``most``), the rest going to the other values in proportion."""
    held = cells.where("tokens > 0").groupBy(F.col(dim).alias("value")).agg(F.sum("most").alias("most"))
    there = targets.join(held, "value").where("target > 0")
    total = there.agg(F.sum("target").alias("_total"))
    scaled = stage(there.join(F.broadcast(total)).withColumn("target", F.col("target") / F.col("_total")).drop("_total"), "targets")
    return fill(scaled).select("value", "target", "share")


def _fit(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None, tolerance: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells with ``weight``, and each dimension's (value, target, share, expected).

    ``open_weight`` is what raking alone would give a cell; its weight is that or ``most``, whichever is less.
    A dimension's step scales each value's cells so that they sum to its share if those that are full stay so; as a
    full cell may open and an open one fill up, rounds go on until every sum is within ``tolerance`` of its share,
    relative to it, before its own step; or until five rounds bring no sum closer, where no weights meet all shares.  There is
    no other cap, unless ``rounds`` gives one.
    """
    wanted = {d: stage(feasible_targets(cells, d, t), "shares") for d, t in targets.items()}
    open_, most, share, now = (F.col(c) for c in ("open_weight", "most", "_share", "_now"))
    at = cells.withColumn("open_weight", F.col("base"))
    best, stale = float("inf"), 0
    for turn in count(1):
        for d in targets:
            sums = at.groupBy(d).agg(
                F.sum(F.least(open_, most)).alias("_now"),
                F.sum(F.when(open_ >= most, most).otherwise(0.0)).alias("_whole"),
                F.sum(F.when(open_ < most, open_).otherwise(0.0)).alias("_open"),
            )
            step = F.when(now <= 0, 1.0).when((share > F.col("_whole")) & (F.col("_open") > 0), (share - F.col("_whole")) / F.col("_open")).otherwise(share / now)
            known = sums.join(wanted[d].select(F.col("value").alias(d), F.col("share").alias("_share")), d, "left").select(
                d, F.coalesce(F.least(step, F.lit(1e6)), F.lit(0.0)).alias("_step"), F.coalesce(F.when(share > 0, F.abs(now / share - 1)), F.lit(0.0)).alias(f"_off_{d}")
            )
            # each step reads ``at`` twice: unwritten, a round's plan would hold it eight times
            at = stage(at.drop(f"_off_{d}").join(known, d).withColumn("open_weight", open_ * F.col("_step")).drop("_step"), "rake")
        worst = at.agg(F.max(F.greatest(*[F.col(f"_off_{d}") for d in targets], F.lit(0.0)))).first()[0] or 0.0
        if worst <= tolerance or turn == rounds:
            break
        best, stale = (worst, 0) if worst < best * 0.99 else (best, stale + 1)
        if stale >= 5:
            break
    fitted = at.withColumn("weight", F.least(open_, most)).drop("open_weight", *[f"_off_{d}" for d in targets])
    sums = {d: fitted.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("expected")) for d in targets}
    return fitted, {d: stage(wanted[d].join(sums[d], "value", "left"), "marginals") for d in targets}


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Scale ``tokens`` to ``weight`` so that each dimension's sums follow its targets; weights sum to 1.

    ``cells`` has a row for each combination, with tokens of 0 or more; ``targets`` holds (value,
    target) for each dimension.  Targets of values that no cell has are left out and the rest
    rescaled; values without a target get weight 0.  An empty table gives no row.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    given = stage(cells.withColumns({"base": F.col("tokens") / F.lit(float(total)), "most": F.lit(float("inf"))}), "rake")
    return _fit(given, targets, rounds, tolerance)[0].drop("base", "most")


def tempered_targets(cells: DataFrame, dim: str, power: float, budget: float = 1.0, room: float = 0.9) -> DataFrame:
    """(value, target): shares proportional to a value's tokens to the power ``power``, as nearly as its tokens can give them.

    A sample of ``budget`` of all tokens can take a value's share times 1 / ``budget`` at most.  Where tempered shares ask for more,
    targets lie between the shares as they are and the tempered ones, as far out as every value can go with ``room`` of what it has
    above its own share, so that all targets can be met.  Values without tokens have a target of 0.
    """
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.pow("n", F.lit(power)))).alias("t")).first()
    if not total.n:
        return sums.select("value", F.lit(0.0).alias("target"))
    own, wanted = F.col("n") / F.lit(total.n), F.when(F.col("n") > 0, F.pow("n", F.lit(power)) / F.lit(total.t)).otherwise(0.0)
    far = sums.agg(F.min(F.when((wanted > own) & (own > 0), own * F.lit(room * (1 / budget - 1)) / (wanted - own)))).first()[0]
    step = min(1.0, far) if far is not None else 1.0
    return sums.select("value", (own + (wanted - own) * F.lit(step)).alias("target"))


def fit_mixture(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int | None = None, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(cells with ``probability`` and ``residual``, marginals) of a sample of ``budget`` of all tokens.

    No cell is expected to give more tokens than it has.  A value whose target is beyond its tokens is taken whole and
    the others of its dimension share the rest; marginals are (dimension, value, target, share, expected, residual):
    the share it was given after that, the sample's expected share, and expected / target - 1.  A cell's ``residual``
    is the greatest, in size, of its three values'.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    tokens = F.col("tokens").cast("double")
    given = stage(cells.withColumns({"base": tokens / F.lit(float(total)), "most": tokens / F.lit(float(total) * budget)}), "rake")
    fitted, sums = _fit(given, targets, rounds, tolerance)
    off = F.when(F.col("target") > 0, F.coalesce("expected", F.lit(0.0)) / F.col("target") - 1).otherwise(0.0)
    marginals = reduce(DataFrame.unionAll, [t.select(F.lit(d).alias("dimension"), "value", "target", "share", "expected", off.alias("residual")) for d, t in sums.items()])
    out = fitted
    for d in targets:
        out = out.join(sums[d].select(F.col("value").alias(d), F.abs(off).alias(f"_r_{d}")), d, "left")
    residual = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(f"_r_{d}", F.lit(0.0)) for d in targets])
    probability = F.when(tokens > 0, F.least(F.lit(1.0), F.col("weight") / F.col("most"))).otherwise(0.0)
    return out.select(*cells.columns, "weight", probability.alias("probability"), residual.alias("residual")), marginals


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    power: float = 0.7,
    budget: float = 0.5,
    rounds: int | None = None,
    seed: int = 17,
    topics: dict[str, list[str]] | None = None,
    prefix: str = "mix_",
    carry_text: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its cell's probability and whether it is sampled; and the marginals.

    Added columns, after ``prefix``: tokens, topic, probability, residual, sampled; a clash is an error.  Targets are the
    tempered token shares of each source, language and topic, as far as the tokens allow (``tempered_targets``); the expected sample is ``budget`` of all tokens, and its
    expected shares are the targets' where those can be met (``fit_mixture``).  ``topics``: terms by topic.
    A null source or language is the category ''.  Texts without a word, null included, weigh nothing and aren't
    sampled; long ones are read whole.  Rows with the same id and text are drawn alike.  An empty table gives no row.
    ``carry_text=False`` leaves the text out.  Each text is read once: the rest works on a written table.
    """
    name = lambda n: f"{prefix}{n}"
    clash = {name(n) for n in ("seen", "tokens", "topic", "draw", "cell", "probability", "residual", "sampled")} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    text = F.col(text_col)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1) / F.lit(float(1 << 63))
    seen = F.struct(tokens_and_topic(text, topics or TOPICS).alias("of"), draw.alias("draw"))
    read = stage(docs.withColumn(name("seen"), seen).drop(*([] if carry_text else [text_col])), "mix-documents")
    fields = {"tokens": "of.tokens", "topic": "of.topic", "draw": "draw"}  # taken from the table: named in one plan, each would be worked out anew
    read = read.withColumns({name(n): F.col(f"{name('seen')}.{f}") for n, f in fields.items()}).drop(name("seen"))
    category = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = {"source": category(source_col), "lang": category(lang_col), "topic": F.col(name("topic"))}
    cells = stage(read.groupBy(*[c.alias(k) for k, c in key.items()]).agg(F.sum(name("tokens")).alias("tokens"), F.count("*").alias("texts")), "cells")
    fitted, marginals = fit_mixture(cells, {d: tempered_targets(cells, d, power, budget) for d in DIMENSIONS}, budget, rounds)
    rates = stage(fitted.select(F.struct(*DIMENSIONS).alias(name("cell")), F.col("probability").alias(name("probability")), F.col("residual").alias(name("residual"))), "rates")
    out = read.join(rates, F.struct(*[c.alias(k) for k, c in key.items()]) == F.col(name("cell")), "left").drop(name("cell"))
    sampled = (F.col(name("tokens")) > 0) & (F.col(name("draw")) < F.coalesce(name("probability"), F.lit(0.0)))
    return out.withColumn(name("sampled"), sampled).drop(name("draw")), marginals


def op4_raked_mixture(spark, sf_dir: str) -> DataFrame:
    """Topic, tokens, probability and sampling of every document; ``residual``: how far its marginals are off target."""
    out, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), carry_text=False)
    return out.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"),
        F.col("mix_residual").alias("residual"), F.col("mix_sampled").alias("sampled"),
    )
