"""All registered queries of the graph and history operators, with SQL for DuckDB where SQL expresses them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import GRAPH_SQL, HISTORY_SQL, PROPERTY_SQL, code_graph, history, property_graph, table
from . import registry
from .functions import predicates, search
from .model import Graph
from .operators import cohesion, cycles, deadcode, dsm, edits, explore, layout, matrix, metrics, rules
from .operators import history as mining
from .plans.storage import materialize, shared_dir
from .sinks import graphs as sinks
from .sinks import projects
from .sources import graphs as sources
from .sources import histories

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _graph(name: str, build: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, d: build(code_graph(spark, d))
    if sql:
        _SQL[name] = GRAPH_SQL + (sql if sql.startswith(",") else " " + sql)


def _history(name: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, d: build(*history(spark, d))
    if sql:
        _SQL[name] = HISTORY_SQL + (sql if sql.startswith(",") else " " + sql)


def _properties(name: str, build: Callable[[Graph], DataFrame], sql: str) -> None:
    _QUERIES[name] = lambda spark, d: build(property_graph(spark, d))
    _SQL[name] = GRAPH_SQL + PROPERTY_SQL + (sql if sql.startswith(",") else " " + sql)


def _of(g: Graph, *kinds: str) -> DataFrame:
    """A selection of all elements of some kinds."""
    return g.elements.where(F.col("element_type").isin(*kinds)).select("id")


def _hidden(g: Graph) -> DataFrame:
    """A selection with an inside and an outside: all internal classes."""
    return g.elements.where("element_type = 'Class' and access_level = 'Internal'").select("id")


_HIDDEN = ", sub AS (SELECT DISTINCT c.id FROM closure c JOIN elements p ON p.id = c.root WHERE p.element_type = 'Class' AND p.access_level = 'Internal')"
_EDGE = "r.source_id, r.target_id, r.type, r.attributes"
_IN = lambda kind, column: f"{column} IN (SELECT id FROM elements WHERE element_type = '{kind}')"

# projections, filters, search
_graph("fan_in_out", metrics.fans, "SELECT t.id, t.full_name, (SELECT count(*) FROM type_edges WHERE dst = t.id) AS fan_in, (SELECT count(*) FROM type_edges WHERE src = t.id) AS fan_out FROM own_types t")
_graph("element_degree", metrics.degrees, "SELECT e.id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM elements e LEFT JOIN (SELECT target_id, count(*) AS n FROM relationships GROUP BY 1) i ON i.target_id = e.id LEFT JOIN (SELECT source_id, count(*) AS n FROM relationships GROUP BY 1) o ON o.source_id = e.id")
_graph("summarize_by_kind", metrics.summarize, "SELECT element_type, count(*) AS elements FROM elements GROUP BY 1")
_graph("search_negation", lambda g: g.elements.where(search.compile_search("-steel brand#1 type:class | copper type:namespace")).select("id", "full_name"), "SELECT id, full_name FROM elements WHERE (NOT contains(lower(full_name), 'steel') AND contains(lower(full_name), 'brand#1') AND element_type = 'Class') OR (contains(lower(full_name), 'copper') AND element_type = 'Namespace')")
_graph("search_camel_hump", lambda g: g.elements.withColumn("hump", F.concat("element_type", "name")).where(search.compile_search("ClP1 source:intern", "hump")).select("id"), "SELECT id FROM elements WHERE regexp_matches(element_type || name, 'Cl[a-z0-9]*P1') AND NOT is_external")
_graph("search_generated", lambda g: g.elements.where(search.compile_search("source:generated | source:extern type:class", "name")).select("id"), "SELECT id FROM elements WHERE is_generated OR (is_external AND element_type = 'Class')")
_graph("search_unknown_kind", lambda g: g.elements.where(search.compile_search("type:nonsense | type: | type:assembly")).select("id"), "SELECT id FROM elements WHERE element_type IN ('Other', 'Assembly')")
_graph("search_null_field", lambda g: g.elements.where(search.compile_search("-t:economy", "parent_id")).select("id"), "SELECT id FROM elements WHERE parent_id IS NOT NULL AND NOT contains(lower(parent_id), 't:economy')")
_graph("search_ranked", lambda g: search.ranked(g.elements.where(search.compile_search("p1")), 200).select("id", "full_name"), "SELECT id, full_name FROM elements WHERE contains(lower(full_name), 'p1') ORDER BY is_external, CASE element_type WHEN 'Assembly' THEN 0 WHEN 'Namespace' THEN 1 WHEN 'Class' THEN 2 ELSE 5 END, full_name, id LIMIT 200")
_graph("tree_search", lambda g: explore.tree_search(g, search.compile_search("s1 type:method", "name", negation=False)), "SELECT DISTINCT c.root AS id FROM closure c JOIN elements e ON e.id = c.id WHERE contains(lower(e.name), 's1') AND e.element_type = 'Method'")
_graph("hide_filter", lambda g: explore.hide(g, relationship_types=("Handles", "Inherits")).relationships.select("source_id", "target_id", "type"), "SELECT source_id, target_id, type FROM relationships WHERE type NOT IN ('Handles', 'Inherits')")
_graph("hide_elements", lambda g: explore.hide(g, ("Method",)).relationships.select("source_id", "target_id", "type"), "SELECT source_id, target_id, type FROM relationships WHERE type = 'Inherits'")
_graph("complexity_rating", lambda g: g.metrics.select("element_id", predicates.rating(F.col("cyclomatic_complexity"), 2, 5).alias("rating")), "SELECT element_id, CASE WHEN cyclomatic_complexity <= 2 THEN 'Good' WHEN cyclomatic_complexity <= 5 THEN 'Warning' ELSE 'Bad' END AS rating FROM metrics")
_graph("flag_rendering", lambda g: g.relationships.select("source_id", "target_id", "type", predicates.flag_names(F.col("attributes")).alias("flags")), "SELECT source_id, target_id, type, CASE WHEN attributes = 0 THEN '' ELSE '[' || concat_ws(', ', CASE WHEN attributes & 2 <> 0 THEN 'IsStaticCall' END, CASE WHEN attributes & 8 <> 0 THEN 'IsInstanceCall' END, CASE WHEN attributes & 64 <> 0 THEN 'EventRegistration' END, CASE WHEN attributes & 128 <> 0 THEN 'EventUnregistration' END) || ']' END AS flags FROM relationships")

# graph algebra
_graph("find_parents", lambda g: explore.find_parents(g, g.elements.select("id")), "SELECT DISTINCT parent_id AS id FROM elements WHERE parent_id IS NOT NULL")
_graph("outgoing_calls", lambda g: explore.outgoing(g, _of(g, "Method"), ("Calls",)), f"SELECT {_EDGE} FROM relationships r WHERE r.type = 'Calls' AND {_IN('Method', 'r.source_id')}")
_graph("incoming_relationships", lambda g: explore.incoming(g, _of(g, "Method")), f"SELECT {_EDGE} FROM relationships r WHERE {_IN('Method', 'r.target_id')}")
_graph("neighbours", lambda g: explore.neighbours(g, _hidden(g)), f"SELECT DISTINCT {_EDGE} FROM relationships r JOIN elements e ON e.id IN (r.source_id, r.target_id) WHERE e.element_type = 'Class' AND e.access_level = 'Internal'")
_graph("outgoing_deep", lambda g: explore.outgoing_deep(g, _hidden(g)), _HIDDEN + f" SELECT {_EDGE} FROM relationships r WHERE r.source_id IN (SELECT id FROM sub) AND r.target_id NOT IN (SELECT id FROM sub)")
_graph("incoming_deep", lambda g: explore.incoming_deep(g, _hidden(g)), _HIDDEN + f" SELECT {_EDGE} FROM relationships r WHERE r.target_id IN (SELECT id FROM sub) AND r.source_id NOT IN (SELECT id FROM sub)")
_graph("induced_edges", lambda g: explore.induced(g, g.elements.where("access_level = 'Public'").select("id")), f"SELECT {_EDGE} FROM relationships r WHERE r.source_id IN (SELECT id FROM elements WHERE access_level = 'Public') AND r.target_id IN (SELECT id FROM elements WHERE access_level = 'Public')")
_graph("relationships_between_roots", lambda g: explore.relationships_between_roots(g, g.elements.where("element_type = 'Assembly'").select("id")), f", sub AS (SELECT root, id FROM closure WHERE root LIKE 'T:%') SELECT DISTINCT {_EDGE} FROM relationships r JOIN sub s ON s.id = r.source_id JOIN sub t ON t.id = r.target_id WHERE s.root <> t.root")
_graph("specializations", lambda g: explore.specializations(g, _of(g, "Class")), f"SELECT {_EDGE} FROM relationships r WHERE r.type IN ('Inherits', 'Implements', 'Overrides') AND {_IN('Class', 'r.target_id')}")
_graph("abstractions", lambda g: explore.abstractions(g, _of(g, "Class")), f"SELECT {_EDGE} FROM relationships r WHERE r.type IN ('Inherits', 'Implements', 'Overrides') AND {_IN('Class', 'r.source_id')}")
_graph("missing_types", lambda g: explore.missing_types(g, _of(g, "Method")), "SELECT DISTINCT parent_id AS id FROM elements WHERE element_type = 'Method'")
_graph("hierarchy_gaps", lambda g: explore.hierarchy_gaps(g, _of(g, "Method", "Assembly")), f"SELECT DISTINCT c.root AS id FROM closure c WHERE {_IN('Method', 'c.id')} AND NOT {_IN('Method', 'c.root')} AND NOT {_IN('Assembly', 'c.root')}")
_graph("subgraph_elements", lambda g: explore.subgraph(g, _of(g, "Class", "Method")).elements.select("id", "parent_id"), "SELECT id, CASE WHEN element_type = 'Method' THEN parent_id END AS parent_id FROM elements WHERE element_type IN ('Class', 'Method')")
_graph("focus_crossing", lambda g: explore.focus_crossing(g, _hidden(g))[1], _HIDDEN + ", crossing AS (SELECT source_id, target_id FROM relationships WHERE source_id IN (SELECT id FROM sub) AND target_id NOT IN (SELECT id FROM sub)) SELECT DISTINCT c.root AS id FROM closure c WHERE c.id IN (SELECT source_id FROM crossing UNION SELECT target_id FROM crossing)")
_graph("subtree", lambda g: g.subtree(_of(g, "Class", "Namespace")), f"SELECT c.root, c.id FROM closure c WHERE {_IN('Class', 'c.root')} OR {_IN('Namespace', 'c.root')}")
_graph("type_edges", lambda g: g.type_edges, "SELECT src, dst FROM type_edges")
_graph("assembly_edges", lambda g: g.assembly_edges, ", top AS (SELECT root, id FROM closure WHERE root LIKE 'T:%') SELECT DISTINCT s.root AS src, t.root AS dst FROM deps d JOIN top s ON s.id = d.source_id JOIN top t ON t.id = d.target_id WHERE s.root <> t.root")
_graph("bundled_edges", lambda g: explore.bundled_edges(g, g.elements.where("element_type = 'Namespace'").select("id")), ", near AS (SELECT root, id FROM closure WHERE root LIKE 'N:%') SELECT s.root AS source_id, t.root AS target_id, count(*) AS edges, CASE WHEN count(DISTINCT r.type) = 1 THEN min(r.type) ELSE 'Bundled' END AS type FROM relationships r JOIN near s ON s.id = r.source_id JOIN near t ON t.id = r.target_id WHERE s.root <> t.root GROUP BY 1, 2")
_graph("dead_ends", lambda g: explore.dead_ends(Graph(g.elements.where("access_level <> 'Internal'"), g.relationships)), f"SELECT {_EDGE} FROM relationships r WHERE r.source_id IN (SELECT id FROM elements WHERE access_level = 'Internal') OR r.target_id IN (SELECT id FROM elements WHERE access_level = 'Internal')")

# aggregates
_graph("languages", metrics.languages, "SELECT CASE WHEN file LIKE '%.cs' THEN 'C#' ELSE 'Python' END AS language, count(DISTINCT lower(file)) AS files FROM elements WHERE file IS NOT NULL GROUP BY 1")
_graph("source_root", metrics.source_root, ", folder AS (SELECT DISTINCT split_part(file, '/', 1) AS a, split_part(file, '/', 2) AS b FROM elements WHERE file IS NOT NULL) SELECT CASE WHEN count(DISTINCT a) > 1 THEN '' WHEN count(DISTINCT b) > 1 THEN min(a) ELSE min(a || '/' || b) END AS root FROM folder")
_graph("event_imbalances", metrics.event_imbalances, "SELECT source_id, target_id, attributes FROM relationships WHERE type = 'Handles' AND attributes & 192 <> 192")
_graph("method_complexity", metrics.method_complexity, "SELECT element_id, full_name, cyclomatic_complexity, code_lines, comment_lines, CASE WHEN code_lines + comment_lines = 0 THEN 0.0::DOUBLE ELSE CAST(comment_lines AS DOUBLE) / (code_lines + comment_lines) END AS comment_ratio FROM metrics JOIN elements ON id = element_id")
_graph("tangledness", lambda g: metrics.tangledness(g.type_edges, g.types.select(F.col("id").alias("node"), F.col("parent_id").alias("module"))).select(F.round("tangledness", 9).alias("tangledness")), """, module AS (SELECT id AS node, parent_id AS module FROM elements WHERE element_type = 'Class' AND NOT is_external), size AS (SELECT module, CAST(count(*) AS DOUBLE) AS n FROM module GROUP BY 1),
block AS (SELECT a.module AS r, b.module AS s, count(*) AS filled FROM type_edges JOIN module a ON a.node = src JOIN module b ON b.node = dst GROUP BY 1, 2), slot AS (SELECT filled, CASE WHEN r = s THEN x.n * (x.n - 1) ELSE x.n * y.n END AS slots FROM block JOIN size x ON x.module = r JOIN size y ON y.module = s),
cost AS (SELECT sum(CASE WHEN filled >= slots THEN 0 ELSE slots * (-(filled / slots) * log2(filled / slots) - (1 - filled / slots) * log2(1 - filled / slots)) END) AS cost, sum(filled) AS e FROM slot), whole AS (SELECT sum(n) * (sum(n) - 1) AS m FROM size)
SELECT round(cost / (m * (-(e / m) * log2(e / m) - (1 - e / m) * log2(1 - e / m))), 9) AS tangledness FROM cost, whole""")

# fixpoints
_REACH = ", reach AS (SELECT src, dst FROM type_edges UNION SELECT r.src, e.dst FROM reach r JOIN type_edges e ON e.src = r.dst)"
_graph("callers", lambda g: explore.callers(g, g.elements.where("startswith(full_name, 'ECONOMY.Brand#1')").select("id")).select("id"), ", up AS (SELECT r.source_id AS id FROM relationships r JOIN elements e ON e.id = r.target_id WHERE r.type = 'Calls' AND starts_with(e.full_name, 'ECONOMY.Brand#1') UNION SELECT r.source_id FROM up JOIN relationships r ON r.target_id = up.id AND r.type = 'Calls') SELECT id FROM up")
_graph("inheritance_tree", lambda g: explore.inheritance_tree(g, _of(g, "Class")), ", types AS (SELECT id FROM elements WHERE element_type = 'Class'), up AS (SELECT id AS origin, id FROM types UNION SELECT up.origin, r.target_id FROM up JOIN relationships r ON r.source_id = up.id AND r.type IN ('Inherits', 'Implements')), down AS (SELECT id AS origin, id FROM types UNION SELECT d.origin, r.source_id FROM down d JOIN relationships r ON r.target_id = d.id AND r.type IN ('Inherits', 'Implements')) SELECT origin, id FROM up UNION SELECT origin, id FROM down")
_graph("walk_inheritance", lambda g: explore.walk_inheritance(g, _of(g, "Class", "Method"), False), ", down AS (SELECT r.target_id AS origin, r.source_id AS id, 1 AS depth FROM relationships r WHERE r.type IN ('Inherits', 'Implements', 'Overrides') UNION SELECT d.origin, r.source_id, d.depth + 1 FROM down d JOIN relationships r ON r.target_id = d.id AND r.type IN ('Inherits', 'Implements', 'Overrides')) SELECT origin, id, min(depth) AS depth FROM down WHERE origin <> id GROUP BY 1, 2")
_graph("forbidden_call_sources", lambda g: explore.forbidden_call_sources(g, g.shape.where("element_type = 'Class'").select("id")), ", up AS (SELECT source_id AS origin, target_id AS id FROM relationships WHERE type = 'Inherits' UNION SELECT u.origin, r.target_id FROM up u JOIN relationships r ON r.source_id = u.id AND r.type = 'Inherits'), tree AS (SELECT origin, id FROM up UNION SELECT a.origin, b.origin FROM up a JOIN up b ON b.id = a.id) SELECT origin AS container, id FROM tree WHERE origin <> id AND (origin, id) NOT IN (SELECT (origin, id) FROM up) AND (origin, id) NOT IN (SELECT (id, origin) FROM up)")
_graph("paths_between", lambda g: explore.paths_between(g, _of(g, "Assembly"), 5))
_graph("path_chains", lambda g: explore.chains(explore.paths_between(g, _of(g, "Assembly"), 5)))
_graph("follow_callers", lambda g: explore.follow_callers(g, _of(g, "Method")))
_graph("blast_radius", metrics.blast_radius, _REACH + " SELECT t.id, count(r.src) AS blast_radius FROM own_types t LEFT JOIN reach r ON r.dst = t.id AND r.src <> t.id GROUP BY t.id")
_graph("type_cycles", metrics.components, _REACH + " SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src")
_graph("page_rank", lambda g: metrics.type_ranks(g, most=20, tolerance=0.0).select("id", F.round("score", 6).alias("score")), """, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM own_types), outs AS (SELECT src, CAST(count(*) AS DOUBLE) AS k FROM type_edges GROUP BY 1),
""" + ",\n".join(f"r{k} AS (SELECT t.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (SELECT coalesce(sum(p.rank), 0) FROM {'r' + str(k - 1) if k > 1 else '(SELECT id, 1 / n AS rank FROM own_types, n)'} p LEFT JOIN outs o ON o.src = p.id WHERE o.k IS NULL) / n.n + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM own_types t CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(p.rank / o.k) AS given FROM type_edges e JOIN {'r' + str(k - 1) if k > 1 else '(SELECT id, 1 / n AS rank FROM own_types, n)'} p ON p.id = e.src JOIN outs o ON o.src = e.src GROUP BY 1) g ON g.dst = t.id)" for k in range(1, 21)) + " SELECT id, round(rank * n, 6) AS score FROM r20, n")
_graph("type_ranks", metrics.type_ranks)
_graph("feedback_edges", lambda g: metrics.feedback_edges(g.type_edges, metrics.components(g)))
_graph("system_metrics", metrics.system_metrics)
_graph("propagation_and_cyclicity", lambda g: metrics.propagation(g).select("types", "dependencies", F.round("propagation_cost", 9).alias("propagation_cost"), F.round("cyclicity", 9).alias("cyclicity")), _REACH + " SELECT (SELECT count(*) FROM own_types) AS types, (SELECT count(*) FROM type_edges) AS dependencies, round((SELECT count(*) FROM reach WHERE src <> dst) / (n * (n - 1)), 9) AS propagation_cost, round((SELECT count(*) FROM reach WHERE src = dst) / n, 9) AS cyclicity FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM own_types)")
_LIFT = """, own AS (SELECT * FROM elements WHERE NOT is_external), rel AS (SELECT DISTINCT source_id, target_id FROM relationships r JOIN elements a ON a.id = r.source_id JOIN elements b ON b.id = r.target_id WHERE NOT a.is_external AND NOT b.is_external AND r.type NOT IN ('Handles', 'Overrides')),
anc AS (SELECT e.id, e.element_type, CASE e.element_type WHEN 'Method' THEN c.id WHEN 'Class' THEN e.id END AS k, CASE e.element_type WHEN 'Method' THEN n.id ELSE c.id END AS ns, CASE e.element_type WHEN 'Method' THEN n.parent_id ELSE c.parent_id END AS top FROM own e LEFT JOIN elements c ON c.id = e.parent_id LEFT JOIN elements n ON n.id = c.parent_id WHERE e.element_type IN ('Class', 'Method')),
lifted AS (SELECT CASE WHEN s.top <> t.top THEN s.top WHEN s.ns <> t.ns THEN s.ns WHEN s.k <> t.k THEN s.k ELSE s.id END AS src, CASE WHEN s.top <> t.top THEN t.top WHEN s.ns <> t.ns THEN t.ns WHEN s.k <> t.k THEN t.k ELSE t.id END AS dst, r.source_id, r.target_id FROM rel r JOIN anc s ON s.id = r.source_id JOIN anc t ON t.id = r.target_id)"""
_graph("search_graph", cycles.search_edges, _LIFT + " SELECT src, dst, source_id, target_id FROM lifted WHERE src <> dst OR src LIKE 'M:%'")
_graph("cycle_groups", cycles.cycle_groups, _LIFT + ", step AS (SELECT DISTINCT src, dst FROM lifted WHERE src <> dst), reach AS (SELECT src, dst FROM step UNION SELECT r.src, e.dst FROM reach r JOIN step e ON e.src = r.dst) SELECT least(a.src, min(a.dst)) AS component, a.src AS id FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src")
_GROUPS = _LIFT + """, step AS (SELECT DISTINCT src, dst FROM lifted WHERE src <> dst), reach AS (SELECT src, dst FROM step UNION SELECT r.src, e.dst FROM reach r JOIN step e ON e.src = r.dst),
grp AS (SELECT least(a.src, min(a.dst)) AS component, a.src AS id FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src),
behind AS (SELECT DISTINCT s.component, l.source_id, l.target_id FROM lifted l JOIN grp s ON s.id = l.src JOIN grp t ON t.id = l.dst AND t.component = s.component WHERE l.src <> l.dst)"""
_graph("cycle_edges", cycles.cycle_edges, _GROUPS + " SELECT component, source_id, target_id FROM behind")
_graph("cycle_summary", cycles.cycle_summary, _GROUPS + """, detail AS (SELECT b.component, r.source_id, r.target_id FROM behind b JOIN relationships r ON r.source_id = b.source_id AND r.target_id = b.target_id WHERE r.type NOT IN ('Handles', 'Overrides')),
ends AS (SELECT component, id, 0 AS i, 0 AS o FROM grp UNION ALL SELECT component, target_id, 1, 0 FROM detail UNION ALL SELECT component, source_id, 0, 1 FROM detail),
named AS (SELECT x.component, e.name, row_number() OVER (PARTITION BY x.component ORDER BY x.i DESC, x.o DESC, e.name) AS k FROM (SELECT component, id, sum(i) AS i, sum(o) AS o FROM ends GROUP BY 1, 2) x JOIN elements e ON e.id = x.id)
SELECT g.component, n.name, CASE WHEN bool_or(e.element_type = 'Assembly') THEN 'Assembly' WHEN bool_or(e.element_type = 'Namespace') THEN 'Namespace' WHEN bool_or(e.element_type = 'Class') THEN 'Type' ELSE 'Other' END AS level, count(*) AS size FROM grp g JOIN elements e ON e.id = g.id JOIN named n ON n.component = g.component AND n.k = 1 GROUP BY 1, 2""")
_graph("member_partitions", lambda g: cohesion.partitions(g, _of(g, "Class")), """, tie AS (SELECT d.source_id AS a, d.target_id AS b FROM deps d JOIN elements x ON x.id = d.source_id JOIN elements y ON y.id = d.target_id WHERE x.parent_id = y.parent_id AND x.element_type = 'Method' AND y.element_type = 'Method'),
ties AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie), reach AS (SELECT id AS a, id AS b FROM elements WHERE element_type = 'Method' UNION SELECT r.a, t.b FROM reach r JOIN ties t ON t.a = r.b)
SELECT m.parent_id AS type_id, min(r.b) AS partition, m.id FROM elements m JOIN reach r ON r.a = m.id GROUP BY m.parent_id, m.id""")
_graph("type_cohesion", cohesion.type_cohesion, """, own AS (SELECT c.id AS type_id, m.id FROM own_types c JOIN elements m ON m.parent_id = c.id),
above AS (SELECT r.source_id AS type_id, r.target_id AS base FROM relationships r WHERE r.type = 'Inherits' AND r.source_id IN (SELECT id FROM own_types) UNION SELECT a.type_id, r.target_id FROM above a JOIN relationships r ON r.source_id = a.base AND r.type = 'Inherits'),
member AS (SELECT type_id, id, false AS base FROM own UNION ALL SELECT a.type_id, m.id, true FROM above a JOIN own_types t ON t.id = a.base JOIN elements m ON m.parent_id = a.base),
many AS (SELECT type_id, count(*) AS methods FROM own GROUP BY 1 HAVING count(*) >= 4),
tie AS (SELECT DISTINCT x.type_id, x.id AS a, y.id AS b FROM deps d JOIN member x ON x.id = d.source_id JOIN member y ON y.id = d.target_id AND y.type_id = x.type_id WHERE x.id <> y.id AND (NOT (x.base OR y.base) OR d.type IN ('Calls', 'Uses'))),
ties AS (SELECT type_id, a, b FROM tie UNION SELECT type_id, b, a FROM tie),
reach AS (SELECT type_id, a, b FROM ties UNION SELECT r.type_id, r.a, t.b FROM reach r JOIN ties t ON t.type_id = r.type_id AND t.a = r.b),
part AS (SELECT o.type_id, o.id, least(o.id, min(z.id)) AS p FROM own o LEFT JOIN reach r ON r.type_id = o.type_id AND r.a = o.id LEFT JOIN own z ON z.type_id = r.type_id AND z.id = r.b GROUP BY 1, 2),
size AS (SELECT type_id, p, count(*) AS n FROM part GROUP BY 1, 2)
SELECT c.id, c.full_name, m.methods, count(*) AS partitions, CAST(max(s.n) AS DOUBLE) / sum(s.n) AS share FROM size s JOIN many m ON m.type_id = s.type_id JOIN elements c ON c.id = s.type_id GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
_properties("dead_code", deadcode.dead_code, """, dep AS (SELECT DISTINCT r.source_id, r.target_id, r.type IN ('Implements', 'Overrides') AND s.element_type NOT IN ('Class', 'Namespace', 'Assembly') AS contract FROM all_relationships r JOIN all_elements s ON s.id = r.source_id JOIN all_elements t ON t.id = r.target_id WHERE r.type NOT IN ('Containment', 'Bundled', 'Handles')),
test_in AS (SELECT DISTINCT c.id FROM all_closure c JOIN marked m ON m.id = c.root AND m.attribute = 'Test'),
hit AS (SELECT a.root AS id, d.source_id, d.source_id IN (SELECT id FROM test_in) AS test FROM dep d JOIN all_closure a ON a.id = d.target_id LEFT JOIN all_closure b ON b.id = d.source_id AND b.root = a.root WHERE NOT d.contract AND b.id IS NULL),
direct AS (SELECT id, bool_or(NOT test) AS production, array_to_string(list_sort(list_distinct(coalesce(list(source_id) FILTER (WHERE test), []))), ',') AS by_tests FROM hit GROUP BY 1),
pass AS (SELECT d.target_id AS src, d.source_id AS dst, t.is_external AS outside, t.full_name FROM dep d JOIN all_elements t ON t.id = d.target_id WHERE d.contract),
flow AS (SELECT d.production, p.dst AS id FROM direct d JOIN pass p ON p.src = d.id AND NOT p.outside UNION SELECT f.production, p.dst FROM flow f JOIN pass p ON p.src = f.id AND NOT p.outside),
alive AS (SELECT id, bool_or(production) AS production FROM (SELECT id, production FROM direct UNION ALL SELECT c.root, f.production FROM flow f JOIN all_closure c ON c.id = f.id) GROUP BY 1),
reported AS (SELECT e.* FROM all_elements e LEFT JOIN alive a ON a.id = e.id WHERE NOT e.is_external AND e.element_type NOT IN ('Assembly', 'Namespace') AND NOT coalesce(a.production, false) AND e.id NOT IN (SELECT id FROM test_in)),
open_of AS (SELECT e.id, e.element_type, 'C:' || substr(e.id, 3) AS type_id FROM inner_parts e WHERE e.element_type IN ('Property', 'PropertyAccessor') AND e.access_level = 'Public'),
outermost AS (SELECT * FROM reported WHERE parent_id NOT IN (SELECT id FROM reported) AND id NOT IN (SELECT o.id FROM open_of o JOIN marked m ON m.id = o.type_id AND m.attribute = 'dataContractAttribute')),
of_subtree AS (SELECT c.root AS id, array_to_string(list_sort(list(DISTINCT m.attribute)), ',') AS attributes, bool_or(m.attribute <> 'ObsoleteAttribute') AS attributed FROM all_closure c JOIN marked m ON m.id = c.id GROUP BY 1),
outside AS (SELECT id, min(contract) AS contract FROM (SELECT dst AS id, full_name AS contract FROM pass WHERE outside AND dst NOT LIKE 'M:%0' UNION ALL SELECT id, 'System.IDisposable.Dispose' FROM elements WHERE element_type = 'Method' AND id LIKE '%0') GROUP BY 1),
kin AS (SELECT id, array_to_string(list_sort(list(DISTINCT other)), ',') AS related, bool_or(up) AS implements, bool_or(NOT up) AS implemented FROM (SELECT dst AS id, src AS other, true AS up FROM pass WHERE NOT outside UNION ALL SELECT src, dst, false FROM pass WHERE NOT outside) GROUP BY 1),
closed AS (SELECT DISTINCT c.id FROM all_closure c JOIN all_elements e ON e.id = c.root WHERE e.access_level IN ('Private', 'Internal', 'ProtectedAndInternal')),
bindable AS (SELECT o.id FROM open_of o JOIN part p ON 'C:' || p.p_partkey = o.type_id WHERE p.p_size % 5 = 0),
hinted AS (SELECT o.id, o.full_name, CAST(CASE WHEN t.attributed THEN 4 ELSE 0 END + CASE WHEN k.implemented THEN 8 ELSE 0 END + CASE WHEN k.implements THEN 16 ELSE 0 END + CASE WHEN x.id IS NOT NULL THEN 32 ELSE 0 END + CASE WHEN a.id IS NOT NULL THEN 64 ELSE 0 END + CASE WHEN o.is_generated THEN 128 ELSE 0 END AS INTEGER) AS hints,
  o.id IN (SELECT id FROM closed) AND o.id NOT IN (SELECT id FROM bindable) AS confined, coalesce(t.attributes, '') AS attributes, x.contract AS external_contract, coalesce(k.related, '') AS related, coalesce(d.by_tests, '') AS test_references
  FROM outermost o LEFT JOIN of_subtree t ON t.id = o.id LEFT JOIN kin k ON k.id = o.id LEFT JOIN outside x ON x.id = o.id LEFT JOIN alive a ON a.id = o.id LEFT JOIN direct d ON d.id = o.id)
SELECT id, full_name, hints, CASE WHEN hints & 37 <> 0 THEN 'Low' WHEN confined AND hints & 64 = 0 THEN 'High' ELSE 'Medium' END AS confidence, attributes, external_contract, related, test_references FROM hinted""")
_graph("dsm_weights", dsm.weights, ", up AS (SELECT e.id, e.id AS root FROM own_types e UNION ALL SELECT e.id, x.parent_id FROM own_types e JOIN elements x ON x.id = e.id UNION ALL SELECT e.id, n.parent_id FROM own_types e JOIN elements x ON x.id = e.id JOIN elements n ON n.id = x.parent_id) SELECT a.root AS consumer, b.root AS provider, count(*) AS weight FROM type_edges e JOIN up a ON a.id = e.src JOIN up b ON b.id = e.dst WHERE NOT EXISTS (SELECT 1 FROM up x WHERE x.id = e.dst AND x.root = a.root) AND NOT EXISTS (SELECT 1 FROM up x WHERE x.id = e.src AND x.root = b.root) GROUP BY 1, 2")
_graph("dsm_relations", lambda g: dsm.relations_of(g, g.elements.where("element_type = 'Namespace'").select("id")), ", ns AS (SELECT c.root, c.id FROM closure c WHERE c.root LIKE 'N:%' AND c.id LIKE 'C:%') SELECT e.id AS root, (SELECT count(*) FROM type_edges x JOIN ns b ON b.id = x.dst JOIN ns a ON a.id = x.src WHERE b.root = e.id AND a.root <> e.id) AS ingoing, (SELECT count(*) FROM type_edges x JOIN ns b ON b.id = x.dst JOIN ns a ON a.id = x.src WHERE a.root = e.id AND b.root <> e.id) AS outgoing, (SELECT count(*) FROM type_edges x JOIN ns b ON b.id = x.dst JOIN ns a ON a.id = x.src WHERE a.root = e.id AND b.root = e.id) AS internal FROM elements e WHERE e.element_type = 'Namespace'")
_graph("dsm_sibling_cycles", dsm.sibling_cycles, """, up AS (SELECT c.id, c.root FROM closure c JOIN own_types t ON t.id = c.id),
near AS (SELECT DISTINCT a.root AS a, b.root AS b FROM type_edges e JOIN up a ON a.id = e.src JOIN up b ON b.id = e.dst JOIN elements x ON x.id = a.root JOIN elements y ON y.id = b.root WHERE a.root <> b.root AND coalesce(x.parent_id, '') = coalesce(y.parent_id, ''))
SELECT n.a, n.b, CASE WHEN e.src IS NOT NULL AND f.src IS NOT NULL THEN 'System' ELSE 'Hierarchical' END AS kind FROM near n JOIN near m ON m.a = n.b AND m.b = n.a LEFT JOIN type_edges e ON e.src = n.a AND e.dst = n.b LEFT JOIN type_edges f ON f.src = n.b AND f.dst = n.a WHERE n.a < n.b""")
_graph("dsm_sibling_order", dsm.sibling_order)

_UP = ", up AS (SELECT c.id, c.root FROM closure c JOIN own_types t ON t.id = c.id)"
_graph("matrix_elements", matrix.matrix_elements, _UP + " SELECT id, name, element_type, parent_id AS parent FROM elements WHERE id IN (SELECT root FROM up)")
_graph("matrix_metrics", matrix.matrix_metrics, _UP + """, size AS (SELECT c.root, count(*) AS elements FROM closure c JOIN (SELECT DISTINCT root AS id FROM up) k ON k.id = c.id GROUP BY 1),
flow AS (SELECT root, count(*) FILTER (WHERE NOT s AND d) AS ingoing, count(*) FILTER (WHERE s AND NOT d) AS outgoing, count(*) FILTER (WHERE s AND d) AS internal FROM (SELECT u.root, e.src, e.dst, bool_or(u.id = e.src) AS s, bool_or(u.id = e.dst) AS d FROM type_edges e JOIN up u ON u.id IN (e.src, e.dst) GROUP BY 1, 2, 3) GROUP BY 1),
near AS (SELECT DISTINCT a.root AS a, b.root AS b, x.parent_id FROM type_edges e JOIN up a ON a.id = e.src JOIN up b ON b.id = e.dst JOIN elements x ON x.id = a.root JOIN elements y ON y.id = b.root WHERE a.root <> b.root AND coalesce(x.parent_id, '') = coalesce(y.parent_id, '')),
cycle AS (SELECT n.parent_id, EXISTS (SELECT 1 FROM type_edges e WHERE e.src = n.a AND e.dst = n.b) AND EXISTS (SELECT 1 FROM type_edges e WHERE e.src = n.b AND e.dst = n.a) AS direct FROM near n JOIN near m ON m.a = n.b AND m.b = n.a WHERE n.a < n.b),
ring AS (SELECT c.root, count(*) FILTER (WHERE NOT direct) AS h, count(*) FILTER (WHERE direct) AS s FROM cycle y JOIN closure c ON c.id = y.parent_id GROUP BY 1)
SELECT z.root AS id, elements, elements * 100.0::DOUBLE / (SELECT count(DISTINCT root) FROM up) AS percent, coalesce(ingoing, 0) AS ingoing, coalesce(outgoing, 0) AS outgoing, coalesce(internal, 0) AS internal, coalesce(ingoing, 0) + coalesce(outgoing, 0) AS external, coalesce(h, 0) AS hierarchical_cycles, coalesce(s, 0) AS system_cycles,
CASE WHEN internal > 0 THEN (coalesce(h, 0) + coalesce(s, 0)) * 100.0::DOUBLE / internal ELSE 0 END AS cyclicity FROM size z LEFT JOIN flow f ON f.root = z.root LEFT JOIN ring r ON r.root = z.root""")
_graph("relations_between", lambda g: matrix.relations_between(g, _hidden(g), g.elements.where("element_type = 'Namespace' and name = 'Brand#11'").select("id")), "SELECT src AS consumer, dst AS provider FROM type_edges JOIN elements a ON a.id = src AND a.access_level = 'Internal' JOIN elements b ON b.id = dst JOIN elements n ON n.id = b.parent_id AND n.name = 'Brand#11'")
_graph("providers", lambda g: matrix.partners(g, _hidden(g)), ", hidden AS (SELECT id FROM elements WHERE element_type = 'Class' AND access_level = 'Internal') SELECT dst AS id, t.full_name, count(*) AS weight FROM type_edges JOIN own_types t ON t.id = dst WHERE src IN (SELECT id FROM hidden) AND dst NOT IN (SELECT id FROM hidden) GROUP BY 1, 2")
_graph("consumers", lambda g: matrix.partners(g, _hidden(g), False), ", hidden AS (SELECT id FROM elements WHERE element_type = 'Class' AND access_level = 'Internal') SELECT src AS id, t.full_name, count(*) AS weight FROM type_edges JOIN own_types t ON t.id = src WHERE dst IN (SELECT id FROM hidden) AND src NOT IN (SELECT id FROM hidden) GROUP BY 1, 2")

# rules
_STEEL, _COPPER = "ECONOMY", "PROMO"


def _denied(g: Graph) -> DataFrame:
    return rules.evaluate(g, rules.parse(f"DENY {_STEEL}.** -> {_COPPER}.**\nALLOW {_STEEL}.Brand#11.** -> {_COPPER}.**")).violations


_TREE = ", tree AS (SELECT r.full_name AS root, c.id FROM closure c JOIN elements r ON r.id = c.root)"
_graph("rule_deny", _denied, _TREE + f" SELECT 'DENY {_STEEL}.** -> {_COPPER}.**' AS rule, d.source_id, d.target_id, d.type FROM deps d WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id IN (SELECT id FROM tree WHERE root = '{_COPPER}') AND d.source_id NOT IN (SELECT id FROM tree WHERE root = '{_STEEL}.Brand#11')")
_graph("rule_isolate", lambda g: rules.evaluate(g, rules.parse(f"ISOLATE {_STEEL}.**")).violations, _TREE + f" SELECT 'ISOLATE {_STEEL}.**' AS rule, d.source_id, d.target_id, d.type FROM deps d JOIN elements e ON e.id = d.target_id AND NOT e.is_external WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id NOT IN (SELECT id FROM tree WHERE root = '{_STEEL}')")
_graph("rule_restrict", lambda g: rules.evaluate(g, rules.parse(f"RESTRICT {_STEEL}.** -> {_COPPER}.**\nRESTRICT {_STEEL}.** -> SMALL.**")).violations, _TREE + f" SELECT 'RESTRICT {_STEEL}.** -> {_COPPER}.**; RESTRICT {_STEEL}.** -> SMALL.**' AS rule, d.source_id, d.target_id, d.type FROM deps d JOIN elements e ON e.id = d.target_id AND NOT e.is_external WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id NOT IN (SELECT id FROM tree WHERE root IN ('{_STEEL}', '{_COPPER}', 'SMALL'))")
_graph("rule_max_lines", lambda g: rules.evaluate(g, rules.parse("MAXLINES = 90")).elements, "SELECT 'MAXLINES = 90' AS rule, element_id AS id, code_lines AS value FROM metrics WHERE code_lines > 90")
_graph("rule_no_cycles", lambda g: rules.evaluate(g, rules.parse(f"NOCYCLES {_STEEL}")).cycles, _GROUPS + f", tree AS (SELECT c.id FROM closure c JOIN elements r ON r.id = c.root AND r.full_name = '{_STEEL}'), whole AS (SELECT g.component FROM grp g JOIN elements e ON e.id = g.id LEFT JOIN tree t ON t.id = g.id GROUP BY 1 HAVING count(t.id) = count(*) AND bool_or(e.element_type <> 'Method')) SELECT 'NOCYCLES {_STEEL}' AS rule, g.component, g.id FROM grp g JOIN whole w ON w.component = g.component")
_graph("rule_fingerprints", lambda g: rules.fingerprints(_denied(g), g).select("source_id", "target_id", "type", "fingerprint"), _TREE + f" SELECT d.source_id, d.target_id, d.type, substr(sha256(concat_ws('|', 'DENY {_STEEL}.** -> {_COPPER}.**', s.full_name, t.full_name, d.type)), 1, 32) AS fingerprint FROM deps d JOIN elements s ON s.id = d.source_id JOIN elements t ON t.id = d.target_id WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id IN (SELECT id FROM tree WHERE root = '{_COPPER}') AND d.source_id NOT IN (SELECT id FROM tree WHERE root = '{_STEEL}.Brand#11')")

def _lines(g: Graph, text: str) -> DataFrame:
    """The lines of a text made for people, which says a line a rule."""
    return g.elements.sparkSession.createDataFrame([(x,) for x in text.splitlines()], "line string")


_graph("rule_generate", lambda g: _lines(g, rules.generate(g)), ", top AS (SELECT root, id FROM closure WHERE root LIKE 'T:%'), pairs AS (SELECT DISTINCT s.root AS a, t.root AS b FROM deps d JOIN top s ON s.id = d.source_id JOIN top t ON t.id = d.target_id WHERE s.root <> t.root) SELECT 'RESTRICT ' || substr(a, 3) || '.** -> ' || substr(b, 3) || '.**' AS line FROM pairs UNION ALL SELECT 'ISOLATE ' || substr(id, 3) || '.**' FROM elements WHERE element_type = 'Assembly' AND id NOT IN (SELECT a FROM pairs)")
_graph("rule_baseline", lambda g: _lines(g, rules.baseline(g, rules.parse(f"DENY {_STEEL}.** -> {_COPPER}.**"))), _TREE + f" SELECT DISTINCT 'ALLOW ' || s.full_name || ' -> ' || t.full_name AS line FROM deps d JOIN elements s ON s.id = d.source_id JOIN elements t ON t.id = d.target_id WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id IN (SELECT id FROM tree WHERE root = '{_COPPER}') UNION ALL SELECT '// DENY {_STEEL}.** -> {_COPPER}.**'")
_graph("rule_unused", lambda g: _lines(g, rules.remove_unused(g, f"// kept\nDENY {_STEEL}.** -> {_COPPER}.**\nDENY {_STEEL}.** -> Nowhere.**\nRESTRICT {_STEEL}.** -> Nowhere.**\nISOLATE Nowhere\nno rule at all")), f"SELECT unnest(['// kept', 'DENY {_STEEL}.** -> {_COPPER}.**', 'RESTRICT {_STEEL}.** -> Nowhere.**', 'no rule at all']) AS line")
_graph("rule_warnings", lambda g: _lines(g, "\n".join(rules.evaluate(g, rules.parse(f"DENY {_STEEL}.** -> Nowhere.**\nISOLATE Elsewhere.*")).warnings)), "SELECT unnest(['nothing matches Nowhere.**', 'nothing matches Elsewhere.*']) AS line")

# properties and events
_properties("accessor_neighbours", lambda g: explore.neighbours(g, _of(g, "Property")), f"SELECT DISTINCT {_EDGE} FROM all_relationships r JOIN inner_parts i ON i.element_type IN ('Property', 'PropertyAccessor') AND i.id IN (r.source_id, r.target_id)")
_properties("members_missing_types", lambda g: explore.missing_types(g, _of(g, "PropertyAccessor")), "SELECT id FROM inner_parts WHERE element_type = 'Property' UNION ALL SELECT 'C:' || substr(id, 3) FROM inner_parts WHERE element_type = 'Property'")
_properties("accessor_type_edges", lambda g: g.type_edges, ", type_of AS MATERIALIZED (SELECT e.id, t.id AS type_id FROM (SELECT id, CASE element_type WHEN 'Class' THEN id WHEN 'Method' THEN parent_id ELSE 'C:' || substr(id, 3) END AS holder FROM all_elements WHERE element_type NOT IN ('Assembly', 'Namespace')) e JOIN own_types t ON t.id = e.holder), dep AS MATERIALIZED (SELECT source_id, target_id FROM all_relationships WHERE type NOT IN ('Containment', 'Bundled', 'Handles')), one AS MATERIALIZED (SELECT s.type_id AS src, r.target_id FROM dep r JOIN type_of s ON s.id = r.source_id) SELECT DISTINCT o.src, t.type_id AS dst FROM one o JOIN type_of t ON t.id = o.target_id WHERE o.src <> t.type_id")

# edits
_HIDE = "(SELECT id FROM elements WHERE element_type = 'Class' AND access_level = 'Internal')"
_graph("get_elements", lambda g: explore.get_elements(g, _hidden(g)).select("id", "full_name"), f"SELECT id, full_name FROM elements WHERE id IN {_HIDE}")
_graph("edit_remove", lambda g: edits.remove(g, _hidden(g)).elements.select("id", "parent_id"), f"SELECT id, CASE WHEN parent_id IN {_HIDE} THEN NULL ELSE parent_id END AS parent_id FROM elements WHERE id NOT IN {_HIDE}")
_graph("edit_delete", lambda g: edits.delete(g, _hidden(g))[0].relationships.select(*explore.EDGE), _HIDDEN + f" SELECT {_EDGE} FROM relationships r WHERE r.source_id NOT IN (SELECT id FROM sub) AND r.target_id NOT IN (SELECT id FROM sub)")
_graph("edit_delete_relationships", lambda g: edits.delete_relationships(g, g.relationships.where("type = 'Calls' and attributes = 2")).relationships.select(*explore.EDGE), f"SELECT {_EDGE} FROM relationships r WHERE NOT (r.type = 'Calls' AND r.attributes = 2)")
_graph("edit_insert", lambda g: edits.insert(edits.remove(g, _of(g, "Method", "Namespace")), g.elements.where("element_type = 'Method' or id = 'N:ECONOMY.Brand#11'")).elements.select("id", "parent_id"), "SELECT id, CASE WHEN element_type = 'Class' THEN NULL ELSE parent_id END AS parent_id FROM elements WHERE element_type <> 'Namespace' OR id = 'N:ECONOMY.Brand#11'")
_graph("edit_move", lambda g: edits.move(g, g.elements.where("element_type = 'Namespace' and startswith(full_name, 'ECONOMY.Brand#1')").select("id"), "T:PROMO").elements.select("id", "parent_id", "full_name"), "SELECT id, CASE WHEN element_type = 'Namespace' AND starts_with(full_name, 'ECONOMY.Brand#1') THEN 'T:PROMO' ELSE parent_id END AS parent_id, CASE WHEN starts_with(full_name, 'ECONOMY.Brand#1') THEN 'PROMO' || substr(full_name, 8) ELSE full_name END AS full_name FROM elements")
_graph("edit_create", lambda g: edits.create(edits.create(g, "T:PROMO", "Class", "new1"), "T:PROMO", "Class", "new2").elements.where("parent_id = 'T:PROMO'").select("id", "full_name"), "SELECT id, full_name FROM elements WHERE parent_id = 'T:PROMO' UNION ALL SELECT 'new1', 'PROMO.NewClass' UNION ALL SELECT 'new2', 'PROMO.NewClass2'")
_graph("edit_global_namespaces", lambda g: edits.with_global_namespaces(edits.create(g, "T:PROMO", "Class", "new1")).elements.select("id", "parent_id", "full_name"), "SELECT id, parent_id, full_name FROM elements UNION ALL SELECT 'new1', 'T:PROMO/global', 'PROMO.global.NewClass' UNION ALL SELECT id || '/global', id, full_name || '.global' FROM elements WHERE element_type = 'Assembly'")

# matrix, counts, and files
_graph("matrix_search", lambda g: matrix.search_matrix(matrix.matrix_elements(g), g, "P1", case=True, kind="Class"), ", up AS (SELECT DISTINCT c.root FROM closure c JOIN own_types t ON t.id = c.id), hit AS (SELECT id FROM elements WHERE element_type = 'Class' AND contains(full_name, 'P1') AND id IN (SELECT root FROM up)) SELECT c.root AS id, bool_or(c.root = c.id) AS matches FROM closure c JOIN hit h ON h.id = c.id JOIN up u ON u.root = c.root GROUP BY 1")
_graph("relation_counts", lambda g: matrix.relation_counts(g.relationships.select(F.col("source_id").alias("consumer"), F.col("target_id").alias("provider"), "type"), g.elements.where("not is_external").select("id")), ", inner_ AS (SELECT id FROM elements WHERE NOT is_external) SELECT type, count(*) AS imported, count(*) FILTER (WHERE source_id IN (SELECT id FROM inner_) AND target_id IN (SELECT id FROM inner_)) AS resolved, count(*) FILTER (WHERE source_id IN (SELECT id FROM inner_) AND target_id IN (SELECT id FROM inner_)) * 100.0::DOUBLE / count(*) AS percent FROM relationships GROUP BY 1")
_history("generated_files", lambda s, i, f, c: f.select("path", predicates.is_generated_file(F.concat("path", F.when(F.col("code") % 3 == 0, ".g.cs").when(F.col("code") % 3 == 1, ".Designer.CS").otherwise(".cs"))).alias("generated")), "SELECT path, code % 3 < 2 AS generated FROM files")
_history("excluded_files", lambda s, i, f, c: f.where(~sources.excluded(F.col("path"), "Brand#1; P[0-9]*7$\n")).select("path"), "SELECT path FROM files WHERE NOT regexp_matches(path, 'Brand#1') AND NOT regexp_matches(path, 'P[0-9]*7$')")
_history("stripped_names", lambda s, i, f, c: f.select("path", predicates.strip_type_parameters(F.concat("path", F.lit("<A, B>.C<"), F.col("code").cast("string"), F.lit(">"))).alias("name")), "SELECT path, path || '.C' AS name FROM files")
_history("shrunk_areas", lambda s, i, f, c: mining.shrink(mining.roll_up(f.select(F.concat(F.lit("top/only/"), "path").alias("path"), F.col("code").cast("double").alias("area")))), "SELECT 'top/only' AS node, CAST(sum(code) AS DOUBLE) AS area, count(*) AS leaves FROM files UNION ALL SELECT 'top/only/' || node, CAST(sum(code) AS DOUBLE), count(*) FROM (SELECT path AS node, code FROM files UNION ALL SELECT split_part(path, '/', 1), code FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), code FROM files) GROUP BY 1")
_history("colour_keys", lambda s, i, f, c: mining.colour_keys(mining.knowledge(f, c)), "SELECT DISTINCT developer AS colour FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lines DESC, developer) AS n FROM contributions) WHERE n = 1")
_history("area_values", lambda s, i, f, c: mining.distinct_values(f, "code"), "SELECT DISTINCT code FROM files")
_history("default_aliases", lambda s, i, f, c: mining.default_aliases(s, c, c.where("length(developer) = 1").select("developer", F.lit("few").alias("alias")).distinct()), "SELECT developer, CASE WHEN length(developer) = 1 AND developer IN (SELECT developer FROM contributions) THEN 'few' ELSE developer END AS alias FROM (SELECT committer AS developer FROM sets UNION SELECT developer FROM contributions)")
_history("highlighted_files", lambda s, i, f, c: f.select("path", mining.highlighted(F.col("path"), "BRAND#1", F.col("code").between(10, 30)).alias("marked")), "SELECT path, contains(lower(path), 'brand#1') AND code BETWEEN 10 AND 30 AS marked FROM files")
_history("one_project_per_assembly", lambda s, i, f, c: sources.one_project_per_assembly(f.select(F.split("path", "/")[1].alias("assembly"), F.col("path").alias("project"), F.col("code").alias("rank"))), "SELECT assembly, project, rank FROM (SELECT split_part(path, '/', 2) AS assembly, path AS project, code AS rank, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY code DESC, path) AS n FROM files) WHERE n = 1")
_history("octal_paths", lambda s, i, f, c: f.select("path", F.udf(histories.decode_path, "string", useArrow=True)(F.concat(F.lit('"caf\\303\\251/'), "path", F.lit('"'))).alias("decoded")), "SELECT path, 'café/' || path AS decoded FROM files")
_QUERIES["lines_of_code"] = lambda spark, d: histories.lines_of_code(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("md").alias("extension"), "text"))
_SQL["lines_of_code"] = r"SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\x{a0}\x{3000}]'))) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comments FROM documents"
_QUERIES["annotated_work"] = lambda spark, d: histories.developer_work(table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.concat(F.lit("0a1b2c (  dev "), "l_suppkey", F.lit(" 2024-01-02 10:11:12 +0100 7) code")).alias("line")))
_SQL["annotated_work"] = "SELECT CAST(l_partkey AS VARCHAR) AS path, 'dev ' || l_suppkey AS developer, count(*) AS lines FROM lineitem GROUP BY 1, 2"

# readers and writers
_QUALIFIED = "(SELECT s.full_name AS a, t.full_name AS b FROM type_edges e JOIN elements s ON s.id = e.src JOIN elements t ON t.id = e.dst)"


def _class_lines(g: Graph) -> DataFrame:
    name = lambda c: g.elements.select(F.col("id").alias(c), F.col("full_name").alias(f"{c}_name"))
    return g.type_edges.join(name("src"), "src").join(name("dst"), "dst").select(F.concat(F.lit("  "), "src_name", F.lit(" -> "), "dst_name", F.lit("  m")).alias("line"))


_graph("read_class_list", lambda g: sources.parse_class_dependencies(_class_lines(g)).elements.select("id", "element_type", "parent_id"), f", name AS (SELECT a AS n FROM {_QUALIFIED} UNION SELECT b FROM {_QUALIFIED}) SELECT n AS id, 'Class' AS element_type, regexp_replace(n, '[.][^.]*$', '') AS parent_id FROM name UNION SELECT regexp_replace(n, '[.][^.]*$', ''), 'Namespace', split_part(n, '.', 1) FROM name UNION SELECT split_part(n, '.', 1), 'Namespace', NULL FROM name")
_graph("read_class_list_edges", lambda g: sources.parse_class_dependencies(_class_lines(g)).relationships.select("source_id", "target_id", "type"), f"SELECT a AS source_id, b AS target_id, 'Uses' AS type FROM {_QUALIFIED}")


# questions about one element, filters and smaller tools
_ROOT = "(SELECT min(target_id) FROM relationships WHERE type = 'Inherits')"


def _first_base(g: Graph) -> str:
    """The least id that others inherit from."""
    return g.relationships.where("type = 'Inherits'").agg(F.min("target_id")).first()[0]


_graph("ask_graph_info", registry.graph_info, "SELECT 'element' AS what, element_type AS kind, count(*) AS count FROM elements GROUP BY 2 UNION ALL SELECT 'relationship', type, count(*) FROM relationships GROUP BY 2")
_graph("ask_outgoing", lambda g: registry.find_outgoing_relationships(g, "T:PROMO", True, 300), f", sub AS (SELECT id FROM closure WHERE root = 'T:PROMO'), found AS (SELECT {_EDGE}, s.full_name AS a, t.full_name AS b FROM relationships r JOIN elements s ON s.id = r.source_id JOIN elements t ON t.id = r.target_id WHERE r.source_id IN (SELECT id FROM sub) AND r.target_id NOT IN (SELECT id FROM sub)) SELECT source_id, target_id, type, attributes, (SELECT count(*) FROM found) AS total FROM found ORDER BY type, a, b LIMIT 300")
_graph("ask_incoming", lambda g: registry.find_incoming_relationships(g, _first_base(g), limit=300), f", found AS (SELECT {_EDGE} FROM relationships r WHERE r.target_id = {_ROOT}) SELECT *, (SELECT count(*) FROM found) AS total FROM found")
_graph("ask_incoming_calls", lambda g: registry.find_incoming_calls(g, g.relationships.where("type = 'Calls'").agg(F.max("target_id")).first()[0], False, 300), ", start AS (SELECT max(target_id) AS id FROM relationships WHERE type = 'Calls'), up AS (SELECT r.source_id AS id FROM relationships r JOIN start s ON s.id = r.target_id WHERE r.type = 'Calls' UNION SELECT r.source_id FROM up JOIN relationships r ON r.target_id = up.id AND r.type = 'Calls'), found AS (SELECT u.id, e.full_name FROM up u JOIN elements e ON e.id = u.id WHERE u.id <> (SELECT id FROM start)) SELECT *, (SELECT count(*) FROM found) AS total FROM found ORDER BY full_name, id LIMIT 300")
_graph("ask_inheritance", lambda g: registry.find_inheritance(g, _first_base(g), False), f", down AS (SELECT source_id AS id, 1 AS depth FROM relationships WHERE type IN ('Inherits', 'Implements', 'Overrides') AND target_id = {_ROOT} UNION SELECT r.source_id, d.depth + 1 FROM down d JOIN relationships r ON r.target_id = d.id AND r.type IN ('Inherits', 'Implements', 'Overrides')) SELECT d.id, e.full_name, min(depth) AS depth FROM down d JOIN elements e ON e.id = d.id GROUP BY 1, 2")
_graph("ask_element", lambda g: registry.describe_element(g, "T:PROMO"), "SELECT unnest(['element_type', 'full_name', 'parent_id', 'access_level', 'is_external', 'is_generated']) AS part, unnest(['Assembly', 'PROMO', NULL, 'Unknown', 'false', 'false']) AS value UNION ALL SELECT 'child', full_name FROM (SELECT full_name FROM elements WHERE parent_id = 'T:PROMO' ORDER BY full_name LIMIT 40) UNION ALL SELECT unnest(['incoming', 'outgoing']), '0'")
_graph("analyzer_rules", lambda g: registry.architectural_rules(g, f"DENY {_STEEL}.** -> SMALL.**"), _TREE + f" SELECT 'DENY {_STEEL}.** -> SMALL.**' AS rule, d.source_id, d.target_id, d.type FROM deps d WHERE d.source_id IN (SELECT id FROM tree WHERE root = '{_STEEL}') AND d.target_id IN (SELECT id FROM tree WHERE root = 'SMALL')")
_graph("element_colours", lambda g: g.elements.select("id", predicates.colour(F.col("element_type")).alias("colour")), "SELECT id, CASE element_type WHEN 'Assembly' THEN '#EEEEEE' WHEN 'Namespace' THEN '#4EC9B0' WHEN 'Class' THEN '#FFD700' ELSE '#569CD6' END AS colour FROM elements")
_graph("type_graph_of_lists", lambda g: sources.type_graph(g.types, g.type_edges.unionByName(g.type_edges.select(F.col("src"), F.col("src").alias("dst"))).groupBy("src").agg(F.collect_list("dst").alias("targets"))), "SELECT src, dst FROM type_edges")
_graph("external_elements", lambda g: sources.external_elements(g.elements.where("element_type = 'Class' and is_external").select(F.col("full_name").alias("name"))).select("id", "element_type", "parent_id", "is_external"), ", far AS (SELECT full_name AS n FROM elements WHERE element_type = 'Class' AND is_external) SELECT n AS id, 'Class' AS element_type, regexp_replace(n, '[.][^.]*$', '') AS parent_id, true AS is_external FROM far UNION SELECT regexp_replace(n, '[.][^.]*$', ''), 'Namespace', split_part(n, '.', 1), true FROM far UNION SELECT split_part(n, '.', 1), 'Namespace', NULL, true FROM far")
_graph("edge_counts", lambda g: sources.edge_counts(g.relationships.select(F.col("type").alias("kind"), F.substring("source_id", 1, 1).alias("evidence_source"), F.when(F.col("attributes") > 2, "open").otherwise("done").alias("status"))), "SELECT substr(source_id, 1, 1) AS evidence_source, type AS kind, CASE WHEN attributes > 2 THEN 'open' ELSE 'done' END AS status, count(*) AS edges FROM relationships GROUP BY 1, 2, 3")
_history("accepted_artifacts", lambda s, i, f, c: mining.artifacts(s, mining.only_files(i, f.where("code < 30").select(F.upper("path").alias("path")), predicates.has_extension(F.col("path"), "1", "7"))).select("id", "commits"), "SELECT id, commits FROM (SELECT i.id, i.kind, count(*) OVER (PARTITION BY i.id) AS commits, row_number() OVER (PARTITION BY i.id ORDER BY s.date DESC, i.change_set_id DESC) AS n FROM items i JOIN sets s ON s.id = i.change_set_id JOIN files f ON f.id = i.id WHERE f.code < 30 AND (i.path LIKE '%1' OR i.path LIKE '%7')) WHERE n = 1 AND kind & 32 = 0")
_QUERIES["lines_by_handler"] = lambda spark, d: histories.lines_of_code(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file"), F.lit(".Html").alias("extension"), F.col("html").alias("text")), {"html": lambda text: (text.count("\n") + 1, 0)})
_SQL["lines_by_handler"] = "SELECT CAST(page_id AS VARCHAR) AS file, CAST(length(coalesce(html, '')) - length(replace(coalesce(html, ''), chr(10), '')) + 1 AS BIGINT) AS code, CAST(0 AS BIGINT) AS comments FROM pages"


def _read_again(g: Graph) -> Graph:
    """The graph written as plain text and read from it."""
    from pyspark.sql import Window

    rows = sinks.plain_text(g).select("section", "ord", F.posexplode(F.split("line", "\n")).alias("k", "line"))
    number = F.row_number().over(Window.partitionBy("section", F.substring("ord", 1, 24)).orderBy("ord", "k"))
    # line numbers of sorted blocks: what stands before a block, and the place in it
    blocks = rows.groupBy("section", F.substring("ord", 1, 24).alias("head")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("section", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("number", number).withColumn("head", F.substring("ord", 1, 24)).join(blocks, ["section", "head"])
    return sources.parse_plain_text(materialize(placed.select((F.col("before") + F.col("number")).alias("line_no"), "line"), "plain-lines", codec="zstd", collect=True))


def _stored(g: Graph) -> Graph:
    """The graph written as a project file, in parts, and read from it."""
    spark = g.elements.sparkSession
    path = f"{shared_dir(spark)}/project-{uuid.uuid4().hex}"
    projects.write_project_json(g, path, parts=True)
    return sources.read_project_parts(spark, path)


_properties("project_elements", lambda g: _stored(g).elements.select("id", "element_type", "name", "full_name", "parent_id", "access_level", "is_external", "is_generated", F.array_join("attributes", ",").alias("attributes")), "SELECT e.id, element_type, name, full_name, parent_id, access_level, is_external, is_generated, coalesce(m.attribute, '') AS attributes FROM all_elements e LEFT JOIN marked m ON m.id = e.id")
_properties("project_relationships", lambda g: _stored(g).relationships.select(*explore.EDGE), f"SELECT {_EDGE} FROM all_relationships r")
_properties("project_records", lambda g: (lambda p: p.metrics.select(F.col("element_id").alias("id"), F.concat_ws("/", "code_lines", "comment_lines", "cyclomatic_complexity").alias("value")).unionByName(p.contracts.select(F.col("element_id").alias("id"), F.col("contract").alias("value"))).unionByName(p.notifying.select("id", F.lit("notifies").alias("value"))))(_stored(g)), "SELECT element_id AS id, concat_ws('/', code_lines, comment_lines, cyclomatic_complexity) AS value FROM metrics UNION ALL SELECT id, 'System.IDisposable.Dispose' FROM elements WHERE element_type = 'Method' AND id LIKE '%0' UNION ALL SELECT 'C:' || p_partkey, 'notifies' FROM part WHERE p_size % 5 = 0")
_graph("plain_text_elements", lambda g: _read_again(g).elements.select("id", "element_type", "name", "full_name", "parent_id", "access_level", "is_external", F.array_join("attributes", ",").alias("attributes"), F.get(F.transform("source_locations", lambda p: p.file), F.lit(0)).alias("file")), "SELECT e.id, element_type, name, full_name, parent_id, access_level, is_external, coalesce(m.attribute, '') AS attributes, file FROM elements e LEFT JOIN marked m ON m.id = e.id")
_graph("plain_text_relationships", lambda g: _read_again(g).relationships.select(*explore.EDGE), f"SELECT {_EDGE} FROM relationships r")
_FLAG_SQL = "CASE WHEN attributes = 0 THEN '' ELSE ' [' || concat_ws(', ', CASE WHEN attributes & 2 <> 0 THEN 'IsStaticCall' END, CASE WHEN attributes & 8 <> 0 THEN 'IsInstanceCall' END, CASE WHEN attributes & 64 <> 0 THEN 'EventRegistration' END, CASE WHEN attributes & 128 <> 0 THEN 'EventUnregistration' END) || ']' END"
_graph("debug_dump", sinks.debug_lines, f"SELECT element_type || ': ' || full_name AS line FROM elements UNION ALL SELECT s.full_name || ' -(' || r.type || ')-> ' || t.full_name || {_FLAG_SQL} FROM relationships r JOIN elements s ON s.id = r.source_id JOIN elements t ON t.id = r.target_id")
_graph("directed_graph_markup", sinks.directed_graph, """SELECT 1 AS section, '<Node Id="' || id || '" Label="' || name || '" Category="' || element_type || '"' || CASE WHEN id IN (SELECT parent_id FROM elements WHERE parent_id IS NOT NULL) THEN ' Group="Expanded"' ELSE '' END || ' />' AS line FROM elements
UNION ALL SELECT 2, '<Link Source="' || parent_id || '" Target="' || id || '" Category="Contains" />' FROM elements WHERE parent_id IS NOT NULL
UNION ALL SELECT 3, '<Link Source="' || source_id || '" Target="' || target_id || '"' || CASE WHEN type IN ('Calls', 'Uses', 'Creates', 'Inherits', 'Implements') THEN '' ELSE ' Label="' || type || '"' END || ' Category="' || type || '" />' FROM relationships""")
_graph("matrix_markup", sinks.matrix_lines, """, numbered AS (SELECT id, full_name, row_number() OVER (ORDER BY full_name, id) AS k FROM own_types) SELECT 1 AS section, '<element id="' || k || '" name="' || full_name || '" type="Class" />' AS line FROM numbered
UNION ALL SELECT 2, '<relation from="' || a.k || '" to="' || b.k || '" type="Uses" weight="1" />' FROM type_edges e JOIN numbered a ON a.id = e.src JOIN numbered b ON b.id = e.dst""")
_graph("class_diagram", sinks.class_diagram, """, plain AS (SELECT e.id, e.name, regexp_replace(e.full_name, '[^A-Za-z0-9]', '_', 'g') AS alias FROM elements e JOIN own_types t ON t.id = e.id),
arrow AS (SELECT s.type_id AS a, t.type_id AS b, max(CASE r.type WHEN 'Inherits' THEN 4 WHEN 'Implements' THEN 3 WHEN 'Uses' THEN 1 ELSE 2 END) AS k FROM relationships r JOIN owner s ON s.id = r.source_id JOIN owner t ON t.id = r.target_id WHERE r.type IN ('Inherits', 'Implements', 'Creates', 'Calls', 'Uses') AND s.type_id <> t.type_id GROUP BY 1, 2)
SELECT 1 AS section, 'class "' || name || '" as ' || alias AS line FROM plain UNION ALL SELECT 2, x.alias || ' ' || CASE k WHEN 4 THEN '--|>' WHEN 3 THEN '..|>' WHEN 2 THEN '-->' ELSE '..>' END || ' ' || y.alias FROM arrow JOIN plain x ON x.id = a JOIN plain y ON y.id = b""")
_graph("web_graph", lambda g: sinks.web_graph(g, _of(g, "Namespace")), """, near AS (SELECT root, id FROM closure WHERE root LIKE 'N:%') SELECT 'node' AS kind, '{"id":"' || id || '","name":"' || name || '","element_type":"Namespace","parent_id":"' || parent_id || '"}' AS json FROM elements WHERE element_type = 'Namespace'
UNION ALL SELECT 'edge', '{"source_id":"' || s.root || '","target_id":"' || t.root || '","edges":' || count(*) || ',"type":"' || CASE WHEN count(DISTINCT r.type) = 1 THEN min(r.type) ELSE 'Bundled' END || '"}' FROM relationships r JOIN near s ON s.id = r.source_id JOIN near t ON t.id = r.target_id WHERE s.root <> t.root GROUP BY s.root, t.root""")


# histories
_history("artifacts", lambda s, i, f, c: mining.artifacts(s, i), "SELECT id, max(path) AS path, max(commits) AS commits, max(committers) AS committers, max(date) AS date FROM (SELECT i.id, i.path, i.kind, s.date, count(*) OVER (PARTITION BY i.id) AS commits, x.committers, row_number() OVER (PARTITION BY i.id ORDER BY s.date DESC, i.change_set_id DESC) AS n FROM items i JOIN sets s ON s.id = i.change_set_id JOIN (SELECT i.id, count(DISTINCT s.committer) AS committers FROM items i JOIN sets s ON s.id = i.change_set_id GROUP BY 1) x ON x.id = i.id) WHERE n = 1 AND kind & 32 = 0 GROUP BY id")
_COUPLED = ", counts AS (SELECT k, count(*) AS n FROM rows GROUP BY 1), pairs AS (SELECT a.k AS item1, b.k AS item2, count(*) - 1 AS c FROM rows a JOIN rows b ON a.cs = b.cs AND a.k < b.k GROUP BY 1, 2) SELECT item1, item2, c AS couplings, round_even(100.0::DOUBLE * c / (x.n + y.n - c), 2) AS degree FROM pairs JOIN counts x ON x.k = item1 JOIN counts y ON y.k = item2"
_history("change_couplings", lambda s, i, f, c: mining.change_couplings(i, 2, 1.0), ", rows AS (SELECT change_set_id AS cs, id AS k FROM items)" + _COUPLED + " WHERE c >= 2 AND round_even(100.0::DOUBLE * c / (x.n + y.n - c), 2) >= 1.0")
_history("classified_couplings", lambda s, i, f, c: mining.classified_couplings(i, F.split("path", "/")[1]), ", rows AS (SELECT DISTINCT change_set_id AS cs, split_part(path, '/', 2) AS k FROM items)" + _COUPLED)
_history("fractal_values", lambda s, i, f, c: mining.fractal_values(c).select("path", F.round("fractal", 9).alias("fractal")), "SELECT path, round(1 - sum(pow(CAST(lines AS DOUBLE) / total, 2)), 9) AS fractal FROM (SELECT path, lines, sum(lines) OVER (PARTITION BY path) AS total FROM contributions) GROUP BY path")
_history("main_developers", lambda s, i, f, c: mining.main_developers(c), "SELECT path, developer, 100.0::DOUBLE * lines / total AS percent FROM (SELECT *, sum(lines) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY lines DESC, developer) AS n FROM contributions) WHERE n = 1")
_history("contributions_by_alias", lambda s, i, f, c: mining.by_alias(c, c.select("developer").distinct().withColumn("alias", F.concat(F.lit("team"), F.col("developer").cast("long") % 7))), "SELECT path, 'team' || CAST(developer AS BIGINT) % 7 AS developer, CAST(sum(lines) AS BIGINT) AS lines FROM contributions GROUP BY 1, 2")
_history("developers", lambda s, i, f, c: mining.developers(s, c), "SELECT committer AS developer FROM sets UNION SELECT developer FROM contributions")
_history("hotspots", lambda s, i, f, c: mining.hotspots(mining.artifacts(s, i), f).select("path", "commits", "code", F.round("hotspot", 9).alias("hotspot")), ", latest AS (SELECT i.id, i.path, i.kind, count(*) OVER (PARTITION BY i.id) AS commits, row_number() OVER (PARTITION BY i.id ORDER BY s.date DESC, i.change_set_id DESC) AS n FROM items i JOIN sets s ON s.id = i.change_set_id), sized AS (SELECT l.path, l.commits, f.code FROM latest l JOIN files f ON f.id = l.id WHERE n = 1 AND kind & 32 = 0), r AS (SELECT min(commits) AS lc, max(commits) AS hc, min(code) AS ls, max(code) AS hs FROM sized) SELECT path, commits, CAST(code AS BIGINT) AS code, round(CAST(commits - lc AS DOUBLE) / nullif(hc - lc, 0) * (CAST(code - ls AS DOUBLE) / nullif(hs - ls, 0)), 9) AS hotspot FROM sized, r WHERE code >= 2 AND commits >= 2")
_history("knowledge", lambda s, i, f, c: mining.knowledge(f, c), "SELECT f.path, CAST(code AS DOUBLE) AS area, coalesce(developer, '') AS colour FROM files f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lines DESC, developer) AS n FROM contributions) c ON c.path = f.path AND n = 1 WHERE code >= 1")
_history("area_roll_up", lambda s, i, f, c: mining.roll_up(f.select("path", F.col("code").cast("double").alias("area"))), "SELECT node, CAST(sum(code) AS DOUBLE) AS area, count(*) AS leaves FROM (SELECT path AS node, code FROM files UNION ALL SELECT split_part(path, '/', 1), code FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), code FROM files) GROUP BY node")
_history("normalized_weights", lambda s, i, f, c: mining.normalized_weights(f.select("path", F.col("code").alias("weight"))).select("path", F.round("percentile", 9).alias("percentile"), F.round("normalized", 9).alias("normalized")), "SELECT path, round((rank() OVER (ORDER BY code) - 1 + (count(*) OVER (PARTITION BY code) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1), 9) AS percentile, round(sqrt(CAST(code - min(code) OVER () AS DOUBLE) / (max(code) OVER () - min(code) OVER ())), 9) AS normalized FROM files")
_history("cleaned_history", lambda s, i, f, c: mining.clean(i, f.where("code >= 25")).select("change_set_id", "id"), "SELECT change_set_id, id FROM items WHERE id IN (SELECT id FROM files WHERE code >= 25) AND kind & 32 = 0")

_history("treemap", lambda s, i, f, c: layout.treemap(mining.roll_up(f.select("path", F.col("code").cast("double").alias("area")))))
_history("top_changed_range", lambda s, i, f, c: f.where(F.col("code").between(10, 20) & predicates.row_filter("Small 1", F.col("path"))).select("path", "code"), "SELECT path, code FROM files WHERE code BETWEEN 10 AND 20 AND contains(lower(path), 'small') AND contains(lower(path), '1')")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
