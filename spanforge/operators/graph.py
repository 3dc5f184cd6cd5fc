"""Call graphs as node and edge frames, and depth-limited traversal by iterated equi-joins.

A hop reaches a node once however many paths lead there; edges are kept once for each depth
at which they are crossed. (Counting paths instead would grow exponentially in a dense graph.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialise

# Symbol kinds of the language server protocol with a name here.
SYMBOL_KINDS = {12: "function", 6: "method", 9: "constructor", 7: "property"}


def node_id(path: str | Column, line: str | Column, column: str | Column, name: str | Column) -> Column:
    return F.concat_ws(":", path, line, column, name)


def qualified_name(container: str | Column = "container", name: str | Column = "name") -> Column:
    return F.concat_ws(".", container, name)


def symbol_kind(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = F.lit("unknown")
    for k, v in SYMBOL_KINDS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def uri_to_path(uri: str | Column) -> Column:
    """file: uris percent-decoded; others as they are."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    plus = F.regexp_replace(F.regexp_replace(uri, "^file://(localhost)?", ""), r"\+", "%2B")
    return F.when(uri.startswith("file://"), F.coalesce(F.try_url_decode(plus), F.regexp_replace(uri, "^file://", ""))).otherwise(uri)


def path_to_uri(path: str | Column) -> Column:
    """Absolute paths percent-encoded under file://; null for relative ones."""
    path = F.col(path) if isinstance(path, str) else path
    encoded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), encoded))


def items_to_nodes(items: DataFrame) -> DataFrame:
    """Call-hierarchy items (name, kind, uri, line, character, detail) to nodes."""
    path = uri_to_path("uri")
    return items.select(node_id(path, "line", "character", "name").alias("id"), "name", symbol_kind("kind").alias("kind"), path.alias("path"), F.struct("line", F.col("character").alias("column")).alias("position"), F.col("detail").alias("container"))


def callers(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    """Nodes that call one node; edges to nodes that aren't there are dropped."""
    return edges.filter(F.col("callee") == of).select(F.col("caller").alias("id")).join(nodes, "id")


def callees(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("caller") == of).select(F.col("callee").alias("id")).join(nodes, "id")


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a plain or qualified name; the lowest id of several."""
    return nodes.filter((F.col("name") == name) | (qualified_name() == name)).orderBy("id").limit(1)


def prepare_roots(items: DataFrame, path: str, line: int, character: int) -> DataFrame:
    """Ids of the call-hierarchy items whose selection starts at a position (0-based)."""
    nodes = items_to_nodes(items)
    return nodes.filter((F.col("path") == path) & (F.col("position.line") == line) & (F.col("position.column") == character)).select("id").distinct()


def fan(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("callee").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))


def merge_graphs(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Later graphs overwrite nodes of the same id; edges are appended with their duplicates."""
    all_nodes = None
    for k, df in enumerate(nodes):
        df = df.withColumn("__turn", F.lit(k))
        all_nodes = df if all_nodes is None else all_nodes.unionByName(df)
    last = W.partitionBy("id").orderBy(F.col("__turn").desc())
    all_nodes = all_nodes.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn", "__turn")
    all_edges = edges[0]
    for df in edges[1:]:
        all_edges = all_edges.unionByName(df)
    return all_nodes, all_edges


def _walk(edges: DataFrame, roots: DataFrame, depth: int, down: bool) -> DataFrame:
    """Edges crossed within depth hops: caller, callee, depth (1 for the first hop)."""
    near, far = ("caller", "callee") if down else ("callee", "caller")
    front = roots.select(F.col("id").alias("__at")).distinct()
    reached, out = front, None
    for hop in range(1, depth + 1):
        crossed = edges.join(front, edges[near] == front["__at"], "left_semi").select("caller", "callee").distinct().withColumn("depth", F.lit(hop))
        if hop > 1 and hop < depth:  # else each hop would be planned again inside the next
            crossed = materialise(crossed, "hop")
        out = crossed if out is None else out.unionByName(crossed)
        seen = reached.withColumnRenamed("__at", "__seen")
        if hop == depth:
            break
        new = crossed.select(F.col(far).alias("__at")).distinct()
        front = new.join(seen, new["__at"] == seen["__seen"], "left_anti")
        reached = reached.unionByName(front)
    if out is None:
        out = edges.select("caller", "callee").limit(0).withColumn("depth", F.lit(0))
    return out


def path_edges(edges: DataFrame, roots: DataFrame, depth: int, down: bool) -> DataFrame:
    """caller, callee, depth, paths: in how many ways an edge is crossed at each hop, over all ways from the roots (id).

    Nothing is marked as seen: a diamond counts its lower edges twice, a cycle is gone round until depth ends. Equal edges are ways of their own. A hop carries
    one number for each symbol, summed before the shuffle, not the ways themselves.
    """
    near, far = ("caller", "callee") if down else ("callee", "caller")
    ways = edges.groupBy("caller", "callee").agg(F.count("*").alias("times"))
    front, out = roots.select(F.col("id").alias("__at")).distinct().withColumn("__n", F.lit(1).cast("decimal(38,0)")), None
    for hop in range(1, depth + 1):
        crossed = ways.join(front, ways[near] == front["__at"]).select("caller", "callee", F.lit(hop).alias("depth"), (F.col("times").cast("decimal(18,0)") * F.col("__n")).cast("decimal(38,0)").alias("paths"))
        crossed = materialise(crossed, "paths")
        out = crossed if out is None else out.unionByName(crossed)
        front = crossed.groupBy(F.col(far).alias("__at")).agg(F.sum("paths").cast("decimal(38,0)").alias("__n"))
    if out is None:
        out = edges.select("caller", "callee").limit(0).withColumns({"depth": F.lit(0), "paths": F.lit(0).cast("decimal(38,0)")})
    return out


def callers_graph(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Callers of callers of roots (id), up to depth hops."""
    return _walk(edges, roots, depth, False)


def callees_graph(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    return _walk(edges, roots, depth, True)


def build_graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Both directions from the roots, which never mix; depth 0 is the roots alone. Raises if there is no root."""
    if roots.limit(1).count() == 0:
        raise ValueError("no symbol at this position")
    if depth == 0:
        return nodes.join(roots.select("id").distinct(), "id", "left_semi"), edges.limit(0)
    found = callers_graph(edges, roots, depth).unionByName(callees_graph(edges, roots, depth))
    ids = roots.select("id").unionByName(found.select(F.explode(F.array("caller", "callee")).alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi"), found
