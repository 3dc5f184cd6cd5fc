"""Tree queries and containment over stored node tables, as joins and sorted windows without Python.

A node table (trees.nodes) labels a node with its place in pre-order, the last place of its
subtree, its parent and its place among its siblings. Parsed once and written, it answers any
number of queries: an edge of a pattern is an equi-join of children with parents, and
containment is a running maximum over the nodes in order. Nothing is reparsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import trees
from ..sources.storage import materialise
from .tree_query import Query, QueryNode, compile_query

#: What queries need of a node.
TABLE_COLUMNS = ("uri", "node_id", "parent_id", "ord", "kind", "named", "start_byte", "end_byte", "subtree_last_id", "text")


def node_table(sources: DataFrame, language: str) -> DataFrame:
    """sources (uri, text) to a written table of their nodes; texts of leaves only. uri must be unique; null texts are empty."""
    return materialise(trees.nodes(sources, language, columns=TABLE_COLUMNS), "nodes")


# -- patterns --------------------------------------------------------------------------


def _own_test(q: QueryNode) -> Column:
    if q.literal is not None:
        return F.col("text") == q.literal  # only leaves have a text
    return F.col("named") if q.kind == "_" else F.col("named") & (F.col("kind") == q.kind)


def _predicate(name: str, left: Column, right: Column) -> Column:
    """Regexes are Java's, with Unicode classes and \\n as the only line end."""
    told = left == right if "eq" in name else F.rlike(left, F.concat(F.lit("(?Ud)"), right))
    return ~told if "not" in name else told


def _early(query: Query, names: list[str]) -> Column:
    """Predicates between one of a node's captures and a literal, where the node is a leaf: they can be told before any join."""
    keep = F.lit(True)
    for name, args in query.predicates:
        captured = [a[1:] for a in args if a.startswith("@")]
        if len(captured) == 1 and captured[0] in names and query.names.count(captured[0]) == 1:
            left, right = (F.col("text") if a.startswith("@") else F.lit(a) for a in args)
            keep = keep & (F.col("text").isNull() | _predicate(name, left, right))
    return keep


def _under() -> Column:
    return (F.col("uri") == F.col("__uri")) & (F.col("node_id") == F.col("__parent"))


class _Twig:
    """The joins of one pattern, from its leaves up."""

    def __init__(self, nodes: DataFrame, query: Query):
        self.nodes, self.query = nodes, query
        self.captures: list[tuple[str, str]] = []  # name and column, in the order of the pattern

    def rows(self, q: QueryNode) -> DataFrame:
        """(uri, node_id, parent_id, ord, start_byte, end_byte, captures): the pattern's matches at each node, distinct captures once."""
        mine = [f"__c{len(self.captures) + k}" for k in range(len(q.names))]
        self.captures += list(zip(q.names, mine))
        node = F.struct("kind", "start_byte", "end_byte")
        state = self.nodes.filter(_own_test(q) & _early(self.query, q.names))
        state = state.select("uri", "node_id", "parent_id", "ord", "start_byte", "end_byte", *(node.alias(c) for c in mine))
        if q.children:
            state = state.withColumn("__last", F.lit(-1))
        for k, child in enumerate(q.children):
            before = len(self.captures)
            found = self.rows(child)
            held = [c for _, c in self.captures[before:]]
            found = found.select(F.col("uri").alias("__uri"), F.col("parent_id").alias("__parent"), F.col("ord").alias("__ord"), *held)
            if held:
                state = self.each(state, found)
            elif k == 0:
                state = self.first(state, found)
            elif k == len(q.children) - 1:
                state = self.some(state, found)
            else:
                state = self.following(state, found)
        return state.drop("__last")

    def each(self, state: DataFrame, found: DataFrame) -> DataFrame:
        """A child with captures: every one after the last is a match of its own."""
        joined = state.join(found, _under() & (F.col("__ord") > F.col("__last")))
        return joined.withColumn("__last", F.col("__ord")).drop("__uri", "__parent", "__ord")

    def first(self, state: DataFrame, found: DataFrame) -> DataFrame:
        """The first child, without captures: the earliest leaves most room for the rest."""
        found = found.groupBy("__uri", "__parent").agg(F.min("__ord").alias("__ord"))
        return state.join(found, _under()).withColumn("__last", F.col("__ord")).drop("__uri", "__parent", "__ord")

    def some(self, state: DataFrame, found: DataFrame) -> DataFrame:
        """The last child, without captures: any one after the last will do."""
        found = found.groupBy("__uri", "__parent").agg(F.max("__ord").alias("__ord"))
        return state.join(found, _under() & (F.col("__ord") > F.col("__last"))).drop("__uri", "__parent", "__ord")

    def following(self, state: DataFrame, found: DataFrame) -> DataFrame:
        """A child without captures amid others: the next one after the last, from one sort of a parent's states and children."""
        columns = state.columns
        a = state.withColumns({"__own": F.lit(1), "__key": F.col("node_id"), "__at": F.col("__last")})
        b = found.select(F.col("__uri").alias("uri"), F.lit(0).alias("__own"), F.col("__parent").alias("__key"), F.col("__ord").alias("__at"))
        after = W.partitionBy("uri", "__key").orderBy(F.col("__at").desc(), F.col("__own").desc()).rowsBetween(W.unboundedPreceding, 0)
        following = F.min(F.when(F.col("__own") == 0, F.col("__at"))).over(after)
        rows = a.unionByName(b, allowMissingColumns=True).withColumn("__next", following)
        return rows.filter("__own = 1 and __next is not null").withColumn("__last", F.col("__next")).select(*columns)


def find(nodes: DataFrame, sources: DataFrame, query: str) -> DataFrame:
    """Matches of a tree query in a node table: uri, start_byte, end_byte, text, captures, as lowering.query_spans gives them.

    sources (uri, text) are those that the table was made of; only their texts are cut. Each distinct
    set of captures at a node comes once, however many other children would do. Predicates take
    Java's regexes; a name that stands twice is the later node.
    """
    compiled = compile_query(query)
    twig = _Twig(nodes, compiled)
    rows = twig.rows(compiled.root)
    raw = sources.select(F.col("uri").alias("__uri"), F.coalesce("text", F.lit("")).cast("binary").alias("__raw"))
    rows = rows.join(raw, F.col("uri") == F.col("__uri"))

    def cut(start, end) -> Column:
        return F.substring("__raw", (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    texts = {name: cut(F.col(c)["start_byte"], F.col(c)["end_byte"]) for name, c in twig.captures}
    for name, args in compiled.predicates:
        left, right = (texts.get(a[1:], F.lit("")) if a.startswith("@") else F.lit(a) for a in args)
        rows = rows.filter(_predicate(name, left, right))
    captures = [
        F.struct(F.lit(f"${n}").alias("name"), F.col(c)["kind"].alias("kind"), cut(F.col(c)["start_byte"], F.col(c)["end_byte"]).alias("text"), F.col(c)["start_byte"].alias("start_byte"), F.col(c)["end_byte"].alias("end_byte"))
        for n, c in sorted(twig.captures, key=lambda x: x[0])
    ]
    kind = "array<struct<name:string,kind:string,text:string,start_byte:bigint,end_byte:bigint>>"
    return rows.select("uri", "start_byte", "end_byte", cut(F.col("start_byte"), F.col("end_byte")).alias("text"), F.array(*captures).cast(kind).alias("captures"))


# -- containment by labels -------------------------------------------------------------


def _events(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """nodes, and the labels of others as rows of their own."""
    a = nodes.withColumns({"__own": F.lit(1), "__at": F.col("node_id"), "__to": F.col("subtree_last_id")})
    b = others.select("uri", F.lit(0).alias("__own"), F.col("node_id").alias("__at"), F.col("subtree_last_id").alias("__to"))
    return a.unionByName(b, allowMissingColumns=True)


def inside(nodes: DataFrame, outer: DataFrame, negate: bool = False) -> DataFrame:
    """Nodes (uri, node_id, subtree_last_id, ...) below some node of outer, not being it; negate: below none."""
    before = W.partitionBy("uri").orderBy("__at", F.col("__own").desc()).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("__own") == 0, F.col("__to"))).over(before)
    below = F.coalesce(reach >= F.col("__to"), F.lit(False))
    rows = _events(nodes, outer).withColumn("__hit", below)
    return rows.filter((F.col("__own") == 1) & (~F.col("__hit") if negate else F.col("__hit"))).select(*nodes.columns)


def having(nodes: DataFrame, inner: DataFrame, negate: bool = False) -> DataFrame:
    """Nodes above some node of inner, not being it; negate: above none."""
    after = W.partitionBy("uri").orderBy(F.col("__at").desc(), F.col("__own").desc()).rowsBetween(W.unboundedPreceding, 0)
    following = F.min(F.when(F.col("__own") == 0, F.col("__at"))).over(after)
    above = F.coalesce(following <= F.col("__to"), F.lit(False))
    rows = _events(nodes, inner).withColumn("__hit", above)
    return rows.filter((F.col("__own") == 1) & (~F.col("__hit") if negate else F.col("__hit"))).select(*nodes.columns)


def ancestors(nodes: DataFrame, outer: DataFrame, nearest: bool = False) -> DataFrame:
    """(uri, node_id, ancestor_id, depth): each node with the nodes of outer above it, or the innermost only; depth 1 is the outermost of them.

    The height of a stack of open outer nodes is a running count of those begun less those ended.
    Outer nodes of one height never overlap, so the one that a node lies in is the last begun at that height.
    """
    outer = outer.select("uri", "node_id", "subtree_last_id").distinct()
    nodes = nodes.select("uri", "node_id").distinct()
    # at one place: what ended before it, then the node asked for, then an outer node that begins there
    begun = outer.select("uri", F.col("node_id").alias("__at"), F.lit(2).alias("__turn"), F.lit(1).alias("__step"))
    ended = outer.select("uri", (F.col("subtree_last_id") + 1).alias("__at"), F.lit(0).alias("__turn"), F.lit(-1).alias("__step"))
    asked = nodes.select("uri", F.col("node_id").alias("__at"), F.lit(1).alias("__turn"), F.lit(0).alias("__step"))
    order = W.partitionBy("uri").orderBy("__at", "__turn").rowsBetween(W.unboundedPreceding, 0)
    rows = begun.union(ended).union(asked).withColumn("__height", F.sum("__step").over(order)).filter("__turn <> 0")
    # an asked node looks at the heights below it, an outer one is found at its own
    low = F.greatest(F.col("__height"), F.lit(1)) if nearest else F.lit(1)
    heights = F.when(F.col("__turn") == 2, F.array("__height")).otherwise(F.when(F.col("__height") > 0, F.sequence(low.cast("long"), "__height")))
    rows = rows.select("uri", "__at", "__turn", F.explode(heights).alias("depth"))
    last = W.partitionBy("uri", "depth").orderBy("__at", "__turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("ancestor_id", F.last(F.when(F.col("__turn") == 2, F.col("__at")), ignorenulls=True).over(last))
    return rows.filter("__turn = 1").select("uri", F.col("__at").alias("node_id"), "ancestor_id", "depth")
