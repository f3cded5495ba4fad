"""Analyzers and readers by name, and the read-only questions that tools ask of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.predicates import ordinal
from .functions.search import compile_search, ranked
from .model import Graph
from .operators import cohesion, deadcode, explore, metrics, rules
from .sources import graphs, histories

#: name -> function of a graph that returns its table
ANALYZERS: dict[str, Callable[[Graph], DataFrame]] = {
    "EventRegistration": metrics.event_imbalances,
    "SystemMetrics": metrics.system_metrics,
    "TypeDependencies": metrics.type_ranks,
    "TypeCohesion": cohesion.type_cohesion,
    "MethodComplexity": metrics.method_complexity,
    "DeadCode": deadcode.dead_code,
}


def architectural_rules(g: Graph, text: str) -> DataFrame:
    """The seventh analyzer, which takes its rules: violating edges (rule, source_id, target_id, type)."""
    return rules.evaluate(g, rules.parse(text)).violations


READERS = {"plain": graphs.parse_plain_text, "classes": graphs.parse_class_dependencies, "extracted": graphs.read_extracted, "documentation": graphs.read_documentation, "matrix": graphs.read_matrix, "log": histories.read_log, "project": graphs.read_project, "project_json": graphs.read_project_json}


def graph_info(g: Graph) -> DataFrame:
    """One row a kind of element and of relationship: what, kind, count."""
    return g.elements.groupBy(F.lit("element").alias("what"), F.col("element_type").alias("kind")).count().unionByName(g.relationships.groupBy(F.lit("relationship").alias("what"), F.col("type").alias("kind")).count())


def search_elements(g: Graph, text: str, limit: int = 50) -> DataFrame:
    return ranked(g.elements.where(compile_search(text)), limit)


def describe_element(g: Graph, ident: str, children: int = 40, locations: int = 5) -> DataFrame:
    """(part, value) of one element: its fields, first children, locations, and the numbers of edges in and out."""
    e = g.elements.where(F.col("id") == ident)
    fields = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in ("element_type", "full_name", "parent_id", "access_level", "is_external", "is_generated")])).alias("x")).select("x.*")
    below = g.elements.where(F.col("parent_id") == ident).orderBy(ordinal(F.col("element_type")), "full_name").limit(children).select(F.lit("child").alias("part"), F.col("full_name").alias("value"))
    places = e.select(F.explode(F.slice("source_locations", 1, locations)).alias("l")).select(F.lit("location").alias("part"), F.concat_ws(":", "l.file", "l.line").alias("value"))
    edges = [g.relationships.where(F.col(side) == ident).agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("part"), "value") for side, name in (("target_id", "incoming"), ("source_id", "outgoing"))]
    return fields.unionByName(below).unionByName(places).unionByName(edges[0]).unionByName(edges[1])


def find_paths(g: Graph, ids: DataFrame, most: int = 5, chains: int = 15) -> DataFrame:
    return explore.chains(explore.paths_between(g, ids, most), chains)


def _listed(g: Graph, edges: DataFrame, limit: int) -> DataFrame:
    """The first relationships by type and names, at most 300, and how many there are in all."""
    name = lambda c: g.elements.select(F.col("id").alias(f"{c}_id"), F.col("full_name").alias(c))
    named = edges.join(name("source"), "source_id").join(name("target"), "target_id")
    total = edges.agg(F.count("*").alias("total"))
    return named.orderBy("type", "source", "target").limit(max(1, min(limit, 300))).join(F.broadcast(total), F.lit(True)).select("source_id", "target_id", "type", "attributes", "total")


def _one(g: Graph, ident: str) -> DataFrame:
    return g.elements.where(F.col("id") == ident).select("id")


def find_outgoing_relationships(g: Graph, ident: str, deep: bool = False, limit: int = 50) -> DataFrame:
    """What an element depends on; with `deep` also what leaves it from inside."""
    return _listed(g, explore.outgoing_deep(g, _one(g, ident)) if deep else explore.outgoing(g, _one(g, ident)), limit)


def find_incoming_relationships(g: Graph, ident: str, deep: bool = False, limit: int = 50) -> DataFrame:
    """What depends on an element; with `deep` also what reaches into it."""
    return _listed(g, explore.incoming_deep(g, _one(g, ident)) if deep else explore.incoming(g, _one(g, ident)), limit)


def find_incoming_calls(g: Graph, ident: str, abstractions: bool = True, limit: int = 50) -> DataFrame:
    """Who calls a method through others as well, with `abstractions` over contracts and events: id, full_name, total."""
    found = (explore.follow_callers(g, _one(g, ident)) if abstractions else explore.callers(g, _one(g, ident)).select("id")).where(F.col("id") != ident)
    total = found.agg(F.count("*").alias("total"))
    return found.join(g.elements.select("id", "full_name"), "id").orderBy("full_name", "id").limit(max(1, min(limit, 300))).join(F.broadcast(total), F.lit(True))


def find_inheritance(g: Graph, ident: str, upward: bool = True) -> DataFrame:
    """What an element specialises, or what specialises it, level by level: id, full_name, depth."""
    return explore.walk_inheritance(g, _one(g, ident), upward).join(g.elements.select("id", "full_name"), "id").select("id", "full_name", "depth")
