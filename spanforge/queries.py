"""Driver queries over the test tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import deltas, graph, lowering, matcher, patch, resolution, rewrite, slices, spans
from .plans.engine import Engine, EngineConfig
from .sources import trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sources."""
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), "text")


_LINES = """lines AS (
  SELECT doc_id, l.i - 1 AS line, l.t AS text,
         coalesce(sum(strlen(l.t) + 1) OVER (PARTITION BY doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'t': x, 'i': i})) AS l FROM documents))"""


@query("SELECT source, count(*) AS docs, sum(len(regexp_extract_all(text, 'th[a-z]+')))::BIGINT AS hits FROM documents GROUP BY source")
def regex_atom_counts(spark, sf_dir):
    """F4, A3: matches of a regex by source, counted without leaving the JVM."""
    docs = _t(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.regexp_count("text", F.lit("th[a-z]+"))).cast("long").alias("hits"))


@query("""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+ing') AS m FROM documents)
SELECT doc_id::VARCHAR AS uri, count(*) AS n, min(strlen(x)) AS shortest, max(strlen(x)) AS longest FROM (SELECT doc_id, unnest(m) AS x FROM d) GROUP BY doc_id""")
def regex_spans_by_file(spark, sf_dir):
    """exact byte spans of a regex atom through the engine's own atom."""
    found = lowering.regex_spans(_sources(spark, sf_dir), "[A-Z][a-z]+ing")
    size = F.col("end_byte") - F.col("start_byte")
    return found.groupBy("uri").agg(F.count("*").alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


RULE = r"""
rules:
  - id: th-outside-first-line
    message: a word of a line that does not begin with And
    languages: [prose]
    severity: WARNING
    patterns:
      - pattern-regex: 'the [a-z]+'
      - pattern-not-inside: {pattern-regex: '(?m)^And[^\n]*'}
      - pattern-inside: {pattern-regex: '(?m)^[^\n]{40,}'}
"""


@query(f"""WITH {_LINES},
hits AS (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, 'the [a-z]+')) AS m FROM lines WHERE NOT starts_with(text, 'And') AND length(text) >= 40) GROUP BY doc_id)
SELECT 'th-outside-first-line' AS rule_id, doc_id::VARCHAR AS uri, n FROM hits""")
def formula_and_not_inside(spark, sf_dir):
    """R1, R9, J6, J7: a YAML rule to sweeps over spans."""
    plans = Engine().compile_yaml(RULE)
    found = Engine(EngineConfig(max_matches_per_rule=None)).execute(plans, _sources(spark, sf_dir))
    return found.groupBy("rule_id", "uri").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}
SELECT doc_id::VARCHAR AS uri, count(*) AS n FROM (
  SELECT DISTINCT doc_id, line FROM lines WHERE starts_with(text, 'And') OR (length(text) > 0 AND ends_with(text, 'the.'))) GROUP BY doc_id""")
def formula_or_dedupe(spark, sf_dir):
    """U1, S8: a disjunction, one row for each span and captures."""
    plan = Engine().compile_dsl("r", "prose", r'regex("(?m)^And[^\n]*$") or regex("(?m)^[^\n]*the\\.$")')
    found = lowering.lower(plan.formula, _sources(spark, sf_dir), "prose")
    return found.groupBy("uri").agg(F.count("*").alias("n"))


@query("""SELECT doc_id::VARCHAR AS uri, count(*) AS n FROM documents WHERE contains(text, 'license') GROUP BY doc_id
UNION ALL SELECT doc_id::VARCHAR, 0 FROM documents WHERE false""")
def formula_anywhere(spark, sf_dir):
    """J9: anchors of files in which something else occurs."""
    plan = Engine().compile_dsl("r", "prose", r'regex("\\A") and anywhere(regex("license"))')
    return lowering.lower(plan.formula, _sources(spark, sf_dir), "prose").groupBy("uri").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES},
w AS (SELECT doc_id, line, s, text FROM lines WHERE length(text) > 0),
hit AS (SELECT doc_id, line FROM w WHERE regexp_matches(text, 'license'))
SELECT doc_id::VARCHAR AS uri, count(*) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = w.doc_id AND h.line = w.line) GROUP BY doc_id""")
def formula_not_overlap(spark, sf_dir):
    """J8: anchors that no negative match overlaps."""
    plan = Engine().compile_dsl("r", "prose", r'regex("(?m)^[^\n]+") and not regex("license")')
    return lowering.lower(plan.formula, _sources(spark, sf_dir), "prose").groupBy("uri").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^1[0-9]$') GROUP BY event_type")
def metavar_regex_filter(spark, sf_dir):
    """a regex constraint on a capture."""
    props = _t(spark, sf_dir, "events").withColumn("X", F.get_json_object("props", "$.k"))
    captures = F.array(F.struct(F.lit("$X").alias("name"), F.lit("json").alias("kind"), F.col("X").alias("text"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte")))
    from .plans.formula import MetavariableRegex

    return lowering.constrain(props.withColumn("captures", captures), MetavariableRegex("$X", "1[0-9]$"), props, "prose").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 'r1' AS rule_id, doc_id FROM documents WHERE contains(text, 'the') UNION ALL SELECT 'r2', doc_id FROM documents WHERE contains(text, 'von'))
SELECT rule_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id) AS rn FROM m) WHERE rn <= 25""")
def match_cap_per_rule(spark, sf_dir):
    """W6: the first matches of each rule."""
    docs = _t(spark, sf_dir, "documents")
    rules = [docs.filter(F.col("text").contains(w)).select(F.lit(r).alias("rule_id"), "doc_id") for r, w in (("r1", "the"), ("r2", "von"))]
    rows = rules[0].unionByName(rules[1]).select("rule_id", F.col("doc_id").alias("uri"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"))
    return lowering.cap(rows, 25).select("rule_id", F.col("uri").alias("doc_id"))


@query(f"""WITH {_LINES},
p AS (SELECT doc_id, strlen(text) // 2 AS at FROM documents)
SELECT p.doc_id, p.at, l.line::INTEGER AS line, l.s::BIGINT AS start_byte FROM p JOIN lines l ON l.doc_id = p.doc_id AND l.s <= p.at AND p.at < l.s + strlen(l.text) + 1""")
def point_in_interval_argmin(spark, sf_dir):
    """J4: the smallest interval that holds a byte."""
    docs = _t(spark, sf_dir, "documents")
    lines = tx.lines(docs, "doc_id").select("doc_id", "line", "start_byte", (F.col("start_byte") + F.octet_length("text") + 1).alias("end_byte"), F.col("line").alias("ord"))
    points = docs.select("doc_id", F.floor(F.octet_length("text") / 2).alias("at"))
    return spans.innermost(points, lines, key="doc_id").filter("line is not null").select("doc_id", "at", "line", "start_byte")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events),
g AS (SELECT *, CASE WHEN t <= lag(t) OVER (PARTITION BY user_id ORDER BY t) + 86400 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM g)
SELECT user_id, grp::BIGINT AS "group", min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM s GROUP BY ALL""")
def consecutive_groups(spark, sf_dir):
    """W11: rows that follow each other closely."""
    e = _t(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    g = deltas.consecutive_groups(e, ["user_id"], "t", "t", 86400)
    return g.groupBy("user_id", "group").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query("""SELECT doc_id, (l.i - 1)::INTEGER AS line, strlen(l.t)::INTEGER AS bytes, coalesce(sum(strlen(l.t) + 1) OVER (PARTITION BY doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte
FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'t': x, 'i': i})) AS l FROM documents)""")
def line_offsets(spark, sf_dir):
    """W12: start bytes of all lines."""
    return tx.lines(_t(spark, sf_dir, "documents"), "doc_id").select("doc_id", "line", F.octet_length("text").alias("bytes"), "start_byte")


def _edges(spark, sf_dir):
    """Part p calls part p' where both are in one order, next to each other by line."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return li.select(F.col("l_partkey").alias("caller"), nxt.alias("callee")).filter("callee is not null")


_EDGES = """edges AS (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee FROM lineitem QUALIFY callee IS NOT NULL)"""


def _recursive(near: str, far: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT caller, callee FROM edges),
h1 AS (SELECT DISTINCT caller, callee, 1 AS depth FROM e WHERE {near} BETWEEN 1 AND 3),
f1 AS (SELECT DISTINCT {far} AS id FROM h1 WHERE {far} NOT BETWEEN 1 AND 3),
h2 AS (SELECT DISTINCT caller, callee, 2 AS depth FROM e WHERE {near} IN (SELECT id FROM f1)),
f2 AS (SELECT DISTINCT {far} AS id FROM h2 WHERE {far} NOT BETWEEN 1 AND 3 AND {far} NOT IN (SELECT id FROM f1)),
h3 AS (SELECT DISTINCT caller, callee, 3 AS depth FROM e WHERE {near} IN (SELECT id FROM f2))
SELECT depth, count(*) AS edges, count(DISTINCT caller) AS callers, count(DISTINCT callee) AS callees FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY depth"""


def _hops(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("edges"), F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


def _roots(spark):
    return spark.range(1, 4).select("id")


@query(_recursive("callee", "caller"))
def callers_depth_3(spark, sf_dir):
    """G2: callers of callers."""
    return _hops(graph.callers_graph(_edges(spark, sf_dir), _roots(spark), 3))


@query(_recursive("caller", "callee"))
def callees_depth_3(spark, sf_dir):
    """G1, G2: callees of callees."""
    return _hops(graph.callees_graph(_edges(spark, sf_dir), _roots(spark), 3))


@query(f"WITH {_EDGES} SELECT p.p_partkey, p.p_name FROM part p WHERE p.p_partkey IN (SELECT caller FROM edges WHERE callee = 7)")
def callers_of_node(spark, sf_dir):
    """J1: edge to node; edges to unknown nodes drop out."""
    nodes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return graph.callers(_edges(spark, sf_dir).distinct(), nodes, 7).select(F.col("id").alias("p_partkey"), "p_name")


@query(f"WITH {_EDGES} SELECT p.p_partkey, p.p_name FROM part p WHERE p.p_partkey IN (SELECT callee FROM edges WHERE caller = 7)")
def callees_of_node(spark, sf_dir):
    """J2."""
    nodes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return graph.callees(_edges(spark, sf_dir).distinct(), nodes, 7).select(F.col("id").alias("p_partkey"), "p_name")


@query(f"WITH {_EDGES}, x AS (SELECT callee AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT caller, 0, 1 FROM edges) SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM x GROUP BY id")
def fan_in_out(spark, sf_dir):
    """A4."""
    return graph.fan(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM part) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_counts(spark, sf_dir):
    """A3."""
    return graph.counts(_t(spark, sf_dir, "part"), _edges(spark, sf_dir))


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS name, 0 AS turn FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)
SELECT id, arg_max(name, turn) AS name FROM u GROUP BY id""")
def graph_merge_nodes(spark, sf_dir):
    """U2, U3: the last writer of a node wins."""
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    empty = a.limit(0)
    return graph.merge_graphs([a, b], [empty, empty])[0]


def _customer_cards(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").cast("int")
    first = F.min("c_custkey").over(W.partitionBy("n_name"))
    return j.select(F.col("n_name").alias("slice_id"), F.col("c_name").alias("symbol_id"), (F.col("c_custkey") == first).alias("is_entry"), F.col("c_mktsegment").alias("container"), F.col("c_name").alias("name"), F.lit("function").alias("kind"), k.alias("start_line"), F.lit(0).alias("start_column"), k.alias("end_line"), F.lit(0).alias("end_column"))


@query("""WITH c AS (SELECT n_name AS slice_id, c_name, c_mktsegment, c_custkey = min(c_custkey) OVER (PARTITION BY n_name) AS e, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT slice_id, c_name AS symbol_id, (row_number() OVER (PARTITION BY slice_id ORDER BY e DESC, c_mktsegment, c_name, c_custkey))::INTEGER AS place,
  row_number() OVER (PARTITION BY slice_id ORDER BY e DESC, c_mktsegment, c_name, c_custkey) <= 30 AS kept FROM c""")
def slice_budget_spillover(spark, sf_dir):
    """U4, W3, W4: the card budget of every slice."""
    return slices.apply_budget(_customer_cards(spark, sf_dir), 30).select("slice_id", "symbol_id", "place", "kept")


@query("""WITH d AS (SELECT doc_id, l.i AS line, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY l.i) AS rn
FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'t': x, 'i': i})) AS l FROM documents) WHERE trim(l.t) <> '')
SELECT doc_id::VARCHAR AS uri, line::INTEGER AS line, n > 8 AS capped FROM d WHERE rn <= 8""")
def discovery_cap(spark, sf_dir):
    """W5: the first non-blank lines and whether there were more."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), "text")
    return slices.discovery_lines(docs, 8)


def _diagnostics(spark, sf_dir, day):
    e = _t(spark, sf_dir, "events").filter(F.col("event_id") % 2 == day)
    code = F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.select((F.col("user_id") % 50).alias("line"), F.get_json_object("props", "$.k").alias("character"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 3).otherwise(F.lit(None).cast("int")).alias("severity"), F.lit("m").alias("message"), code.alias("code"))


_DIAGNOSTICS = """d AS (SELECT event_id % 2 AS day, user_id % 50 AS line, json_extract_string(props, '$.k') AS "character", CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 3 END AS severity, 'm' AS message, CASE WHEN event_type <> 'view' THEN event_type END AS code FROM events)"""


@query(f"""WITH {_DIAGNOSTICS}, s AS (SELECT * FROM d WHERE severity IS NULL OR severity IN (1, 2))
SELECT line, "character", severity, message, code FROM s u WHERE day = 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.day = 0 AND b.line = u.line AND b."character" IS NOT DISTINCT FROM u."character" AND b.severity IS NOT DISTINCT FROM u.severity AND b.message = u.message AND b.code IS NOT DISTINCT FROM u.code)""")
def diagnostics_delta(spark, sf_dir):
    """J12, U7, F8: severe diagnostics that weren't there before, duplicates kept."""
    return deltas.new_diagnostics(_diagnostics(spark, sf_dir, 0), _diagnostics(spark, sf_dir, 1))


@query(f"""WITH {_DIAGNOSTICS}, b AS (SELECT DISTINCT line, code FROM d WHERE day = 0), a AS (SELECT DISTINCT line, code FROM d WHERE day = 1)
SELECT coalesce(a.line, b.line) AS line, coalesce(a.code, b.code) AS code, CASE WHEN b.line IS NULL THEN 'added' WHEN a.line IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM a FULL JOIN b ON a.line IS NOT DISTINCT FROM b.line AND a.code IS NOT DISTINCT FROM b.code""")
def delta_full_outer(spark, sf_dir):
    """J16: added, removed and kept keys."""
    return deltas.set_delta(_diagnostics(spark, sf_dir, 0), _diagnostics(spark, sf_dir, 1), ["line", "code"])


@query("""SELECT user_id, event_type, arg_max(props, {'t': ts, 'e': event_id}) AS props FROM events GROUP BY ALL""")
def latest_directive(spark, sf_dir):
    """U6: the latest value of each key."""
    return deltas.latest_by(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props")


def _manifests(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set(F.concat(F.lit("L"), (F.col("p_size") % 7).cast("string")))).alias("languages"), F.array_sort(F.collect_set("p_type")).alias("capabilities"))


@query("""WITH m AS (SELECT p_brand AS name, list_distinct(list('l' || (p_size % 7))) AS langs, list_distinct(list(p_type)) AS caps FROM part GROUP BY p_brand),
r AS (SELECT p_type AS request_id, p_type AS capability, 'l' || (count(*) % 9) AS language FROM part GROUP BY p_type)
SELECT r.request_id, CASE WHEN min(m.name) FILTER (list_contains(langs, r.language)) IS NULL THEN 'refused' ELSE 'selected' END AS outcome, min(m.name) FILTER (list_contains(langs, r.language)) AS selected_provider,
  CASE WHEN min(m.name) FILTER (list_contains(langs, r.language)) IS NULL THEN 'no_matching_provider' END AS refusal_reason, count(m.name) AS candidates
FROM r LEFT JOIN m ON list_contains(m.caps, r.capability) GROUP BY r.request_id""")
def provider_resolution(spark, sf_dir):
    """N1, W9: automatic choice among providers."""
    r = _t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("request_id")).agg(F.concat(F.lit("l"), (F.count("*") % 9).cast("string")).alias("language"))
    r = r.select("request_id", F.col("request_id").alias("capability"), "language", F.lit(None).cast("string").alias("provider"))
    out = resolution.resolve(_manifests(spark, sf_dir), r)
    return out.select("request_id", "outcome", "selected_provider", "refusal_reason", F.size("candidates").cast("long").alias("candidates"))


@query("""WITH f AS (SELECT p_partkey, [p_name, p_brand, p_type, p_size::VARCHAR] AS x FROM part)
SELECT p_partkey, 'sym_' || substr(sha256(list_aggregate(list_transform(x, lambda y: strlen(y) || ':' || y), 'string_agg', '')), 1, 16) AS symbol_id FROM f""")
def symbol_ids(spark, sf_dir):
    """A11: length-prefixed fingerprints."""
    return _t(spark, sf_dir, "part").select("p_partkey", tx.symbol_id("p_name", "p_brand", "p_type", "p_size").alias("symbol_id"))


@query("SELECT doc_id, sha256(text) AS content_hash, greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END) AS lines, (strlen(text) + 3) // 4 AS tokens FROM documents")
def content_measures(spark, sf_dir):
    """A2, A12, A14: hashes, line counts and token estimates."""
    return _t(spark, sf_dir, "documents").select("doc_id", tx.content_hash("text").alias("content_hash"), tx.line_count("text").cast("long").alias("lines"), tx.token_estimate("text").alias("tokens"))


@query("""WITH r AS (SELECT s_suppkey, 'file:///src/' || replace(s_name, '#', '%23') || '/m.' || (['py', 'RS', 'tsx', 'txt'])[(s_suppkey % 4 + 1)::INT] AS uri FROM supplier)
SELECT s_suppkey, replace(replace(uri, 'file://', ''), '%23', '#') AS path, CASE s_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' END AS language FROM r""")
def uri_paths_and_languages(spark, sf_dir):
    """G7, S2: file URIs to paths, extensions to languages."""
    s = _t(spark, sf_dir, "supplier")
    ext = F.element_at(F.array(*map(F.lit, ("py", "RS", "tsx", "txt"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    uri = F.concat(F.lit("file:///src/"), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit("/m."), ext)
    return s.withColumn("uri", uri).select("s_suppkey", graph.uri_to_path("uri").alias("path"), tx.language_of("uri").alias("language"))


@query("""SELECT language, capability, coalesce(d = 'force', false) OR (d IS DISTINCT FROM 'deny' AND enabled) AS enabled, CASE d WHEN 'force' THEN 'forced' WHEN 'deny' THEN 'denied' ELSE CASE WHEN enabled THEN 'server' ELSE 'missing' END END AS source
FROM (SELECT lower(n_name) AS language, lower(r_name) AS capability, n_nationkey % 2 = 0 AS enabled, CASE n_nationkey % 3 WHEN 0 THEN 'force' WHEN 1 THEN 'deny' END AS d FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def capability_merge(spark, sf_dir):
    """J13, N4: force over deny over what is advertised."""
    j = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    adv = j.select(F.col("n_name").alias("language"), F.col("r_name").alias("capability"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    over = j.filter("n_nationkey % 3 <> 2").select(F.concat(F.lit(" "), "n_name").alias("language"), F.col("r_name").alias("capability"), F.when(F.col("n_nationkey") % 3 == 0, "Force").otherwise("Deny").alias("directive"))
    return resolution.merge_capabilities(adv, over)


@query("""SELECT page_id::VARCHAR AS uri, len(regexp_extract_all(html, '<a href=')) AS n FROM pages WHERE contains(html, '<a href=')""")
def html_structural_match(spark, sf_dir):
    """S5, P12: elements by structure, counted by page."""
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("uri"), F.col("html").alias("text"))
    found = lowering.query_spans(pages, '(element (start_tag (tag_name) @t) (#eq? @t "a"))', "html")
    return found.groupBy("uri").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id::VARCHAR AS uri, len(regexp_extract_all(html, '<title>[^<]+</title>')) AS replacements, regexp_matches(html, '<title>[^<]+</title>') AS changed, sha256(regexp_replace(html, '<title>([^<]+)</title>', '<title>[\1]</title>', 'g')) AS content_hash FROM pages""")
def rewrite_apply(spark, sf_dir):
    """T1-T4: headings rewritten by a template."""
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("uri"), F.col("html").alias("text"))
    out = rewrite.apply_all(pages, [rewrite.RewriteRule("<title>$T</title>", "<title>[$T]</title>", "html")])
    return out.select("uri", "replacements", "changed", tx.content_hash("text").alias("content_hash"))


@query("""SELECT doc_id::VARCHAR AS uri, 'modify' AS op, sha256('patched' || substr(text, strpos(text, chr(10)))) AS content_hash, NULL::VARCHAR AS error FROM documents WHERE strpos(text, chr(10)) > 1""")
def patch_apply(spark, sf_dir):
    """T8: a search and replace block for the first line of every file that has several."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), "text")
    first = F.concat(F.substring_index("text", "\n", 1), F.lit("\n"))
    blocks = F.array(F.struct(first.alias("search"), F.lit("patched\n").alias("replace")))
    ops = docs.filter("instr(text, '\\n') > 1").select(F.col("uri").alias("path"), F.lit("modify").alias("op"), F.lit(None).cast("string").alias("content"), blocks.alias("blocks"))
    return patch.apply_operations(docs, ops).select("uri", "op", tx.content_hash("text").alias("content_hash"), "error")


@query("""SELECT doc_id::VARCHAR AS uri, 'line' AS kind, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) AS n FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) > 0""")
def prose_tree_lines(spark, sf_dir):
    """S5, W1: a tree as node rows."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), "text")
    return trees.nodes(docs, "prose", ("line",), ("uri", "kind")).groupBy("uri", "kind").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT conv_id || ':' || turn AS uri, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'t': x, 'i': i})) AS l FROM conversations),
s AS (SELECT uri, text, l.i AS start_line, unnest(list_transform(regexp_extract_all(l.t, '[^.!?]+[.!?]*'), lambda x, i: {'t': x, 'i': i})) AS s FROM l),
f AS (SELECT uri, min({'line': start_line, 'i': s.i, 'whole': text, 't': s.t}) AS m FROM s WHERE len(regexp_extract_all(s.t, '[^	

 ]+')) = 3 AND regexp_extract_all(s.t, '[^	

 ]+')[2] = 'of' GROUP BY uri)
SELECT uri, m.t AS text, strlen(substr(m.whole, 1, strpos(m.whole, m.t) - 1))::BIGINT AS start_byte, m.line AS start_line,
  (strlen(substr(m.whole, 1, strpos(m.whole, m.t) - 1)) - strlen(array_to_string(string_split(m.whole, chr(10))[1:m.line - 1], chr(10))) - (m.line > 1)::INT + 1)::BIGINT AS start_column FROM f""")
def prose_pattern_first(spark, sf_dir):
    """W2, P1-P10: the first match of a pattern with metavariables in each conversation."""
    c = _t(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("uri"), "text")
    return matcher.match_sources(c, "$A of $B", "prose", first_only=True).select("uri", "text", "start_byte", "start_line", "start_column")


@query("""SELECT word, CASE WHEN count(*) FILTER (d = best) = 1 THEN min(name) FILTER (d = best) END AS suggestion FROM (
  SELECT w.r_name AS word, n.n_name AS name, levenshtein(w.r_name, n.n_name) AS d, min(levenshtein(w.r_name, n.n_name)) OVER (PARTITION BY w.r_name) AS best FROM region w JOIN nation n ON levenshtein(w.r_name, n.n_name) <= 6) GROUP BY word
UNION ALL SELECT r_name, NULL FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE levenshtein(r_name, n_name) <= 6)""")
def bounded_suggestions(spark, sf_dir):
    """2.13: nearest names within a bound; ties give none."""
    words = _t(spark, sf_dir, "region").select(F.col("r_name").alias("word"))
    return tx.suggestions(words, _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), 6)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula_and_not_inside(spark, sf_dir)


from . import history_queries, rule_queries, source_queries  # noqa: E402, F401  (these register their queries)
