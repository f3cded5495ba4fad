"""Cycle groups: dependencies lifted to comparable containers, their strongly connected components, and what lies behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import container_level, relevant_for_cycles
from ..model import Graph
from ..plans.fixpoint import strong_components
from ..plans.storage import materialize


def relevant(g: Graph) -> DataFrame:
    kinds = g.ends.select("id", "element_type")
    both = g.relationships.join(kinds.select(F.col("id").alias("source_id"), F.col("element_type").alias("s")), "source_id").join(kinds.select(F.col("id").alias("target_id"), F.col("element_type").alias("t")), "target_id")
    return both.where(relevant_for_cycles(F.col("type"), F.col("s"), F.col("t"))).select("source_id", "target_id", "type", "attributes")


def search_edges(g: Graph, external: bool = False) -> DataFrame:
    """(src, dst, source_id, target_id): each relevant edge between the highest ancestors that differ, raised to equal container level.

    Ancestors shared by both ends are a prefix of both paths, so its length is the
    size of their intersection. Levels only fall on the way down, so two looks at
    the nearest ancestor of a level suffice; an end without one drops the edge.
    A self edge stays only for methods.
    """
    p = g.end_paths if external else g.end_paths.where("not is_external")
    side = lambda name, short: p.select(F.col("id").alias(name), F.col("path").alias(f"{short}_path"), F.col("types").alias(f"{short}_types"))
    e = relevant(g).select("source_id", "target_id").distinct().join(side("source_id", "s"), "source_id").join(side("target_id", "t"), "target_id")

    def raised(levels: Column, i: Column, least: Column) -> Column:
        """The last place up to i whose level is at least `least`, or null."""
        back = F.array_position(F.transform(F.reverse(F.slice(levels, 1, i)), lambda x: x >= least), True).cast("int")
        return F.when(back > 0, i + 1 - back)

    # as steps over an array of one, so that each row's intersection and levels are computed once and not anew wherever a later step names them
    step = lambda x, **new: F.transform(x, lambda v: F.struct(*[v[c].alias(c) for c in ("s", "t", "si", "ti", "least") if c not in new], *[f(v).alias(c) for c, f in new.items()]))
    level = lambda s: F.transform(f"{s}_types", container_level)
    x = F.array(F.struct(level("s").alias("s"), level("t").alias("t"), F.size(F.array_intersect("s_path", "t_path")).alias("si")))
    x = step(x, ti=lambda v: v["si"], least=lambda v: F.lit(None).cast("int"))
    x = step(x, si=lambda v: F.least(v["si"], F.size(v["s"]) - 1) + 1, ti=lambda v: F.least(v["ti"], F.size(v["t"]) - 1) + 1)
    for _ in range(2):
        x = step(x, least=lambda v: F.greatest(F.element_at(v["s"], v["si"]), F.element_at(v["t"], v["ti"])))
        x = step(x, si=lambda v: raised(v["s"], v["si"], v["least"]), ti=lambda v: raised(v["t"], v["ti"], v["least"]))
    e = e.select("source_id", "target_id", "s_path", "t_path", "s_types", F.inline(x)).where("si is not null and ti is not null")
    out = e.select(F.expr("element_at(s_path, si)").alias("src"), F.expr("element_at(t_path, ti)").alias("dst"), F.expr("element_at(s_types, si)").alias("kind"), "source_id", "target_id")
    return out.where("src <> dst or kind = 'Method'").drop("kind")


def _own_edges(g: Graph) -> DataFrame:
    """`search_edges` of the analyzed code, made once."""
    if "search" not in g._kept:
        g._kept["search"] = materialize(search_edges(g), "search-edges", collect=True)
    return g._kept["search"]


def cycle_groups(g: Graph) -> DataFrame:
    """(component, id): members of each group of two or more elements in a cycle."""
    if "cycles" not in g._kept:
        edges = _own_edges(g).select("src", "dst").distinct()
        g._kept["cycles"] = materialize(strong_components(edges).select("component", F.col("node").alias("id")), "cycle-groups")
    return g._kept["cycles"]


def cycle_edges(g: Graph) -> DataFrame:
    """(component, source_id, target_id): the original edges behind each group's lifted edges."""
    m = cycle_groups(g)
    s, t = m.select(F.col("id").alias("src"), "component"), m.select(F.col("id").alias("dst"), F.col("component").alias("c"))
    return _own_edges(g).join(s, "src").join(t, "dst").where("component = c and src <> dst").select("component", "source_id", "target_id").distinct()


def cycle_summary(g: Graph) -> DataFrame:
    """component, name, level and size of each group; named by the element of its detailed graph, which holds the members and the ends of all edges behind the group, with most edges in, then out, then the least name."""
    members = cycle_groups(g)
    edges = materialize(cycle_edges(g).join(relevant(g), ["source_id", "target_id"]), "cycle-details", collect=True)
    count = lambda side, name: edges.groupBy("component", F.col(side).alias("id")).agg(F.count("*").alias(name))
    into, out_of = count("target_id", "incoming"), count("source_id", "outgoing")
    every = members.unionByName(into.select("component", "id")).unionByName(out_of.select("component", "id")).distinct()
    ranked = every.join(into, ["component", "id"], "left").join(out_of, ["component", "id"], "left").fillna(0, ["incoming", "outgoing"]).join(g.elements.select("id", "name"), "id")
    first = ranked.groupBy("component").agg(F.min(F.struct((-F.col("incoming")).alias("a"), (-F.col("outgoing")).alias("b"), "name")).alias("first")).select("component", "first.name")
    m = members.join(g.elements.select("id", "element_type"), "id")
    kinds = m.groupBy("component").agg(F.count("*").alias("size"), *[F.bool_or(c).alias(n) for n, c in (("a", F.col("element_type") == "Assembly"), ("n", F.col("element_type") == "Namespace"), ("t", container_level(F.col("element_type")) == 20))])
    return kinds.join(first, "component").select("component", "name", F.when(F.col("a"), "Assembly").when(F.col("n"), "Namespace").when(F.col("t"), "Type").otherwise("Other").alias("level"), "size")
