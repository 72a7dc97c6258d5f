"""Graph patterns over a triples table, compiled to joins (Q1-Q22).

Triples: graph, s, p, o, o_kind ('uri' or 'literal'), o_type.  A pattern is a small tree of
``Node``, ``Prop`` and ``Link``; ``match`` turns it into one DataFrame with a column per variable.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.paths import reach, transitive
from loomgraph.runtime import stage

TYPE = "rdf:type"


def closure(edges: DataFrame, sub: str = "sub", sup: str = "super") -> DataFrame:
    """(sub, super) for every descendant, each class its own too; cycles end, hierarchies of any depth settle (Q1)."""
    base = edges.select(F.col(sub).alias("sub"), F.col(sup).alias("super"))
    names = base.select(F.col("sub").alias("n")).union(base.select("super")).distinct()
    return transitive(base, "sub", "super").union(names.where("n is not null").select(F.col("n").alias("sub"), F.col("n").alias("super"))).distinct()


def sub_properties(prop_closure: DataFrame, domains: DataFrame, class_closure: DataFrame, prop: str, cls: str) -> DataFrame:
    """(p): ``prop`` and its sub-properties whose domain is ``cls`` or a super- or subclass of it (Q1).

    ``domains``: (p, domain); a sub-property without one is left out.
    """
    near = (
        class_closure.where(F.col("super") == cls).select(F.col("sub").alias("domain"))
        .union(class_closure.where(F.col("sub") == cls).select(F.col("super").alias("domain")))
        .union(class_closure.sparkSession.createDataFrame([(cls,)], "domain string")).distinct()
    )
    subs = prop_closure.where((F.col("super") == prop) & (F.col("sub") != prop)).select(F.col("sub").alias("p"))
    return subs.join(domains, "p").join(near, "domain", "left_semi").select("p").union(subs.sparkSession.createDataFrame([(prop,)], "p string")).distinct()


@dataclass
class Where:
    """A test of a value: ops are in, not in, regex, =, !=, >, >=, <, <= (Q7); ``other`` names a variable (Q8)."""

    op: str
    value: object = None
    kind: str = "string"
    other: str | None = None

    def column(self, c: Column) -> Column:
        cast = lambda x: x.try_cast(self.kind) if self.kind != "string" else x
        if self.op in ("in", "not in"):
            found = cast(c).isin(*self.value)
            return found if self.op == "in" else ~found
        if self.op == "regex":
            if self.kind != "string":
                raise ValueError("regex is for strings only")
            return c.rlike(self.value)
        right = cast(F.col(self.other)) if self.other else F.lit(self.value).cast(self.kind)
        left = cast(c)
        return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[self.op]


def between(low, high, kind: str = "double", low_open: bool = False, high_open: bool = False) -> list[Where]:
    return [Where(">" if low_open else ">=", low, kind), Where("<" if high_open else "<=", high, kind)]


@dataclass
class Prop:
    predicate: str
    var: str
    mode: str = "required"  # required, optional, minus
    where: list[Where] = field(default_factory=list)


@dataclass
class Link:
    predicate: str
    node: Node
    mode: str = "required"
    reverse: bool = False
    qualifier: str = ""  # * + ? ^


@dataclass
class Node:
    var: str
    cls: str | None = None
    props: list[Prop] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    where: list[Where] = field(default_factory=list)
    type_var: str | None = None
    unions: list[list[Node]] = field(default_factory=list)  # each: alternatives of this node (Q5)

    def once(self) -> bool:
        """Whether each instance is bound in one row by the node alone."""
        return not (self.props or self.links or self.unions or self.type_var)


class Graph:
    def __init__(self, triples: DataFrame, classes: DataFrame | None = None, properties: DataFrame | None = None, graphs: list[str] | None = None, domains: DataFrame | None = None):
        """``classes`` and ``properties``: (sub, super) edges; ``domains``: (p, domain), which limit sub-properties by class."""
        self.triples = triples if graphs is None else triples.where(F.col("graph").isin(*graphs))  # Q17
        self.classes = closure(classes) if classes is not None else None
        self.properties = closure(properties) if properties is not None else None
        self.domains = domains

    def edges(self, predicate: str, subject: str, value: str, cls: str | None = None) -> DataFrame:
        """(subject, value) of a predicate or any sub-property of it that may be on ``cls``."""
        wanted = F.col("p") == predicate
        if self.properties is None:
            found = self.triples.where(wanted)
        else:
            if self.domains is not None and self.classes is not None and cls is not None:
                names = sub_properties(self.properties, self.domains, self.classes, predicate, cls)
            else:
                names = self.properties.where(F.col("super") == predicate).select(F.col("sub").alias("p"))
            found = self.triples.join(names.union(names.sparkSession.createDataFrame([(predicate,)], "p string")).distinct(), "p", "left_semi")
        return found.select(F.col("s").alias(subject), F.col("o").alias(value))

    def instances(self, node: Node) -> DataFrame:
        """Instances of the node's class or a subclass (Q2)."""
        if node.cls is None:
            return self.triples.select(F.col("s").alias(node.var)).distinct()
        types = self.triples.where(F.col("p") == TYPE).select(F.col("s").alias(node.var), F.col("o").alias("_cls"))
        if self.classes is None:
            types = types.where(F.col("_cls") == node.cls)
        else:
            subs = self.classes.where(F.col("super") == node.cls).select(F.col("sub").alias("_cls"))
            types = types.join(subs.union(subs.sparkSession.createDataFrame([(node.cls,)], "_cls string")).distinct(), "_cls", "left_semi")
        return types.withColumnRenamed("_cls", node.type_var).distinct() if node.type_var else types.select(node.var).distinct()

    def path(self, link: Link, near: str, far: str, cls: str | None = None, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
        """(near, far) of a link (Q6).  ``cls``: the class of near.

        ``starts`` (a column near) or ``ends`` (far) bound the paths of ``*`` and ``+`` and the identities of ``*`` and ``?``: only what
        can be reached from them is touched.  Without both, every node's paths are listed, and identities of all nodes.
        """
        flip = link.reverse != (link.qualifier == "^")
        step = self.edges(link.predicate, far if flip else near, near if flip else far, link.node.cls if flip else cls).select(near, far)
        if link.qualifier in ("", "^"):
            return step.distinct()
        if link.qualifier in ("*", "+"):
            if starts is not None:
                step = reach(step, starts, near, far)
            elif ends is not None:
                step = reach(step, ends, far, near)
            else:
                step = transitive(step, near, far, "path")
        if link.qualifier in ("*", "?"):
            if starts is not None:
                nodes = starts.select(near)
            elif ends is not None:
                nodes = ends.select(F.col(far).alias(near))
            else:
                nodes = self.triples.select(F.col("s").alias(near)).union(self.triples.where("o_kind = 'uri'").select("o"))
            step = step.union(nodes.where(F.col(near).isNotNull()).select(near, F.col(near).alias(far)))
        step = step.select(near, far)
        return step if link.qualifier == "+" else step.distinct()  # pairs that + reaches are distinct

    def _linked(self, out: DataFrame, link: Link, near: str, cls: str | None) -> tuple[DataFrame, DataFrame]:
        """``out`` and the link's bindings.  Paths start at the side with fewer nodes, both being written once."""
        far = self.match(link.node)
        if link.qualifier not in ("*", "+", "?"):
            return out, self.path(link, near, link.node.var, cls).join(far, link.node.var)
        out, far = stage(out, "bound"), stage(far, "bound")
        starts, ends = out.select(near).distinct(), far.select(link.node.var)
        if not link.node.once():
            ends = ends.distinct()
        bound = {"starts": starts} if starts.count() <= ends.count() else {"ends": ends}
        return out, self.path(link, near, link.node.var, cls, **bound).join(far, link.node.var)

    def match(self, node: Node) -> DataFrame:
        """All bindings; required parts first, then minus, then optional parts, whole sub-patterns each (Q3, Q4)."""
        out = self.instances(node)
        for w in node.where:
            if not w.other:
                out = out.where(w.column(F.col(node.var)))
        parts = [(p.mode, p) for p in node.props] + [(x.mode, x) for x in node.links]
        how = {"required": "inner", "minus": "left_anti", "optional": "left"}
        for mode in ("required", "minus", "optional"):
            for _, part in (x for x in parts if x[0] == mode):
                if isinstance(part, Prop):
                    found = self.edges(part.predicate, node.var, part.var, node.cls)
                    for w in part.where:
                        if not w.other:
                            found = found.where(w.column(F.col(part.var)))
                else:
                    out, found = self._linked(out, part, node.var, node.cls)
                out = out.join(found, node.var, how[mode])
            if mode == "required":
                for branches in node.unions:
                    either = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.match(replace(b, var=node.var)) for b in branches])
                    out = out.join(either, node.var)
        for p in node.props:
            for w in p.where:
                if w.other:
                    out = out.where(w.column(F.col(p.var)))
        return out

    def match_all(self, heads: list[Node], allow_product: bool = False) -> DataFrame:
        """Disconnected heads multiply, which must be asked for (Q16)."""
        if len(heads) > 1 and not allow_product:
            raise ValueError("disconnected heads make a product: pass allow_product=True")
        return reduce(lambda a, b: a.crossJoin(b), [self.match(h) for h in heads])

    def distinct_values(self, node: Node, var: str) -> DataFrame:
        """Values of one variable under all constraints but its own (Q13)."""

        def bare(n: Node) -> Node:
            return replace(
                n, where=[] if n.var == var else n.where,
                props=[replace(p, where=[] if p.var == var else p.where) for p in n.props],
                links=[replace(x, node=bare(x.node)) for x in n.links],
            )

        return self.match(bare(node)).select(var).where(F.col(var).isNotNull()).distinct()

    def construct(self, node: Node) -> DataFrame:
        """Distinct (s, p, o) of the matched pattern, types included (Q14)."""
        found, rows = self.match(node), []

        def walk(n: Node):
            if n.cls:
                rows.append((n.var, TYPE, F.lit(n.cls)))
            for p in n.props:
                if p.mode != "minus":
                    rows.append((n.var, p.predicate, F.col(p.var)))
            for x in n.links:
                if x.mode != "minus":
                    rows.append((x.node.var if x.reverse else n.var, x.predicate, F.col(n.var if x.reverse else x.node.var)))
                    walk(x.node)

        walk(node)
        triples = F.array(*[F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")) for s, p, o in rows])
        return found.select(F.inline(triples)).where("s is not null and o is not null").distinct()

    def delete(self, node: Node, mode: str, var: str | None = None) -> DataFrame:
        """The triples that stay after a delete (Q15): type_only, all, inside (the pattern's triples)."""
        if mode == "inside":
            return self.triples.join(self.construct(node), ["s", "p", "o"], "left_anti")
        gone = self.match(node).select(F.col(var or node.var).alias("_x")).distinct()
        if mode == "type_only":
            typed = self.triples.where(F.col("p") == TYPE).join(gone, F.col("s") == F.col("_x"), "left_anti")
            return self.triples.where(F.col("p") != TYPE).unionByName(typed)
        if mode != "all":
            raise ValueError(mode)
        return self.triples.join(gone, F.col("s") == F.col("_x"), "left_anti").join(gone, F.col("o") == F.col("_x"), "left_anti")

    # Q18-Q22
    def types(self, key: str = "s", out: str = "cls") -> DataFrame:
        return self.triples.where(F.col("p") == TYPE).select(F.col("s").alias(key), F.col("o").alias(out)).distinct()

    def connected_triples(self, instance: str, allow: list[str] | None = None, deny: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Triples in and out of an instance with the neighbour's class; untyped neighbours stay."""
        near = self.triples.where(((F.col("s") == instance) | (F.col("o") == instance)) & (F.col("p") != TYPE))
        near = near.withColumn("neighbour", F.when(F.col("s") == instance, F.col("o")).otherwise(F.col("s")))
        out = near.join(self.types("neighbour", "neighbour_class"), "neighbour", "left")
        c = F.col("neighbour_class")
        if allow is not None:
            out = out.where(c.isNull() | c.isin(*allow))
        if deny is not None:
            out = out.where(c.isNull() | ~c.isin(*deny))
        out = out.select("s", "p", "o", "neighbour_class").distinct()
        return out.orderBy("s", "p", "o", "neighbour_class").limit(limit) if limit else out

    def instance_table(self, pairs: list[tuple[str, str]]) -> DataFrame:
        wanted = self.triples.sparkSession.createDataFrame(pairs, "cls string, p string")
        own = self.triples.where(F.col("p").isin(sorted({p for _, p in pairs})))
        out = own.join(self.types().where(F.col("cls").isin(sorted({c for c, _ in pairs}))), "s").join(wanted, ["cls", "p"])
        return out.join(self.types("o", "o_cls"), "o", "left").select("s", "cls", "p", "o", "o_cls").distinct()

    def subjects_of_classes(self, classes: list[str]) -> DataFrame:
        return self.types().where(F.col("cls").isin(*classes))

    def shared_predicates(self, a: str, b: str) -> DataFrame:
        return self.triples.where(F.col("s").isin(a, b)).groupBy("p").agg(F.count_distinct("s").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("p")

    def find_instance(self, values: dict[str, str]) -> DataFrame:
        """(s, cls) of the subjects that have every given value."""
        test = reduce(lambda x, y: x | y, [(F.col("p") == p) & (F.col("o") == v) for p, v in values.items()])
        hits = self.triples.where(test).groupBy("s").agg(F.count_distinct("p").alias("n")).where(F.col("n") == len(values))
        return hits.select("s").join(self.types(), "s", "left")


AGGREGATES = {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "AVG": F.avg, "SAMPLE": F.any_value}


def select(found: DataFrame, columns: list[str], aggregates: list[tuple[str, str, str]] | None = None, group_by: list[str] | None = None, order: list[Column | str] | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Distinct projection (Q9), aggregates (Q10), order and paging (Q11).

    ``aggregates`` are (function, variable, name); two or more COUNTs each count distinct values.
    """
    if aggregates:
        missing = [c for c in columns if c not in (group_by or [])]
        if missing:
            raise ValueError(f"not in GROUP BY: {missing}")
        many = sum(f == "COUNT" for f, _, _ in aggregates) > 1

        def agg(f, v):
            if f == "COUNT":
                return F.count_distinct(F.col(v)) if many else F.count(v)
            if f == "GROUP_CONCAT":
                return F.concat_ws(" ", F.array_sort(F.collect_list(v)))
            return AGGREGATES[f](F.col(v))

        out = found.groupBy(*(group_by or [])).agg(*[agg(f, v).alias(n) for f, v, n in aggregates]).select(*columns, *[n for _, _, n in aggregates])
    else:
        if group_by:
            raise ValueError("GROUP BY without a function")
        out = found.select(*columns).distinct()
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def count(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*columns).distinct().agg(F.count("*").alias("count"))


def ask(found: DataFrame) -> bool:
    return not found.isEmpty()
