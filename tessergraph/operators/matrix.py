"""The matrix as a model of its own: its elements, the metrics of each, and questions about relations between subtrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.storage import materialize
from .dsm import partition_order, relations_of, sibling_cycles

#: Orders of siblings by name: a list of ids in their original order and the set of edges among them give the new order.
SORTS: dict[str, Callable[[list[str], set[tuple[str, str]]], list[str]]] = {"Partition": partition_order, "Alphabetical": lambda nodes, edges: sorted(nodes)}


def matrix_elements(g: Graph) -> DataFrame:
    """id, name, element_type, parent of the types of the analyzed code and all they lie in.

    A namespace whose only child is a namespace is left out, and its name goes in
    front of the name of what follows it: `A`, `A.B`, `A.B.C` become one `A.B.C`.
    """
    kept = g.paths.join(g.types.select("id"), "id", "left_semi").select(F.explode("path").alias("id")).distinct()
    only = g.elements.where("parent_id is not null").groupBy(F.col("parent_id").alias("above")).agg(F.count("*").alias("n"), F.min("element_type").alias("child")).where("n = 1 and child = 'Namespace'")
    names = g.elements.select(F.col("id").alias("above"), F.col("name").alias("step_name"), (F.col("element_type") == "Namespace").alias("space"), "is_external")
    steps = names.join(only.select("above", F.lit(True).alias("single")), "above", "left").select("above", "step_name", (F.col("space") & ~F.col("is_external") & F.coalesce("single", F.lit(False))).alias("passed"))
    up = g.paths.join(kept, "id", "left_semi").select("id", F.posexplode("path").alias("pos", "above")).join(steps, "above")
    line = F.array_sort(F.collect_list(F.struct("pos", "above", "step_name", "passed")))
    e = up.groupBy("id").agg(line.alias("line")).where(~F.element_at("line", -1)["passed"])
    e = e.withColumn("before", F.coalesce(F.array_max(F.transform(F.filter("line", lambda x: ~x.passed & (x.above != F.col("id"))), lambda x: x.pos)), F.lit(-1)))
    name = F.array_join(F.transform(F.filter("line", lambda x: x.pos > F.col("before")), lambda x: x.step_name), ".")
    parent = F.when(F.col("before") >= 0, F.get("line", F.col("before"))["above"])
    return e.select("id", name.alias("name"), parent.alias("parent")).join(g.elements.select("id", "element_type"), "id").select("id", "name", "element_type", "parent")


def matrix_metrics(g: Graph) -> DataFrame:
    """Of each element: elements in its subtree, their percentage, relations ingoing, outgoing, internal and external, cycles of siblings below it by kind, and cyclicity (cycles in percent of internal relations, 0 without any)."""
    ids = materialize(matrix_elements(g).select("id"), "matrix-ids")
    total = ids.count()
    size = g.closure().join(ids, "id", "left_semi").groupBy("root").agg(F.count("*").alias("elements"))
    parents = g.elements.select(F.col("id").alias("a"), F.col("parent_id").alias("id"))
    below = sibling_cycles(g).join(parents, "a").join(g.paths.select("id", "path"), "id").select(F.explode("path").alias("root"), "kind")
    cycles = below.groupBy("root").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k.lower()}_cycles") for k in ("Hierarchical", "System")])
    rows = relations_of(g, ids).join(size, "root").join(cycles, "root", "left").fillna(0, ["hierarchical_cycles", "system_cycles"])
    both = F.col("hierarchical_cycles") + F.col("system_cycles")
    cyclicity = F.when(F.col("internal") > 0, both * 100.0 / F.col("internal")).otherwise(0.0)
    return rows.select(F.col("root").alias("id"), "elements", (F.col("elements") * 100.0 / max(total, 1)).alias("percent"), "ingoing", "outgoing", "internal", (F.col("ingoing") + F.col("outgoing")).alias("external"), "hierarchical_cycles", "system_cycles", cyclicity.alias("cyclicity"))


def relations_between(g: Graph, consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """(consumer, provider) relations of types from the subtrees of the first ids to those of the second."""
    inside = lambda ids, name: g.subtree(ids).select(F.col("id").alias(name)).distinct()
    return g.type_edges.join(inside(consumers, "src"), "src", "left_semi").join(inside(providers, "dst"), "dst", "left_semi").select(F.col("src").alias("consumer"), F.col("dst").alias("provider"))


def partners(g: Graph, ids: DataFrame, provide: bool = True) -> DataFrame:
    """id, full_name and weight of the types outside that the subtrees of the ids use (or, without `provide`, that use them)."""
    inside = g.subtree(ids).select("id").distinct()
    near, far = ("src", "dst") if provide else ("dst", "src")
    across = g.type_edges.join(inside.select(F.col("id").alias(near)), near, "left_semi").join(inside.select(F.col("id").alias(far)), far, "left_anti")
    return across.groupBy(F.col(far).alias("id")).agg(F.count("*").alias("weight")).join(g.elements.select("id", "full_name"), "id").select("id", "full_name", "weight")


def search_matrix(elements: DataFrame, g: Graph, text: str, case: bool = False, kind: str | None = None) -> DataFrame:
    """(id, matches): elements of a matrix whose full name holds the text, and with `matches` false those that only hold such elements."""
    name = F.col("full_name") if case else F.lower("full_name")
    named = g.elements.select("id", "full_name", "element_type").join(elements.select("id"), "id", "left_semi")
    hits = named.where(name.contains(text if case else text.lower()) & (F.lit(True) if kind is None else F.col("element_type") == kind)).select("id")
    marked = g.paths.join(hits, "id", "left_semi").select(F.explode("path").alias("id")).distinct().join(elements.select("id"), "id", "left_semi")
    return marked.join(hits.withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("matches"))


def relation_counts(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Of each relation type of (consumer, provider, type): how many, how many with both ends known, and these in percent."""
    end = lambda c: known.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = relations.join(end("consumer"), "consumer", "left").join(end("provider"), "provider", "left")
    resolved: Column = F.col("consumer_known") & F.col("provider_known")
    return rows.groupBy("type").agg(F.count("*").alias("imported"), F.count(F.when(resolved, 1)).alias("resolved")).withColumn("percent", F.col("resolved") * 100.0 / F.col("imported"))
