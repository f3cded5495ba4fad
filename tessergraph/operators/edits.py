"""Edits of a graph as new frames: removing, moving, creating and inserting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ELEMENTS, Graph

_MEMBERS = ("Method", "Property", "Field", "Event")
_TYPES = ("Class", "Interface", "Struct", "Record", "Enum", "Delegate")
#: What may be created or put below an element of a type.
CHILDREN = {"Assembly": ("Namespace", *_TYPES), "Namespace": ("Namespace", *_TYPES), "Class": (*_TYPES, *_MEMBERS), "Struct": (*_TYPES, *_MEMBERS), "Record": (*_TYPES, *_MEMBERS), "Interface": _MEMBERS, "Property": ("PropertyAccessor",)}


class EditError(ValueError):
    """An edit that the graph's rules forbid."""


def remove(g: Graph, ids: DataFrame) -> Graph:
    """Without the elements; their children become roots, and edges that touch them go."""
    gone = ids.select("id").distinct()
    lost = gone.select(F.col("id").alias("parent_id"), F.lit(True).alias("lost"))
    elements = g.elements.join(gone, "id", "left_anti").join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("lost").isNull(), F.col("parent_id"))).select(*g.elements.columns)
    edges = g.relationships.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*g.relationships.columns)
    return Graph(elements, edges, g.metrics, g.contracts, g.notifying)


def delete(g: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """Without the subtrees; and the ids that went."""
    gone = g.subtree(ids).select("id").distinct()
    return remove(g, gone), gone


def delete_relationships(g: Graph, edges: DataFrame) -> Graph:
    return Graph(g.elements, g.relationships.join(edges.select("source_id", "target_id", "type").distinct(), ["source_id", "target_id", "type"], "left_anti").select(*g.relationships.columns), g.metrics, g.contracts, g.notifying)


def insert(g: Graph, elements: DataFrame) -> Graph:
    """With the elements that aren't there yet, as roots where their parent isn't in the graph."""
    new = elements.dropDuplicates(["id"]).join(g.elements.select("id"), "id", "left_anti").select(*g.elements.columns)
    every = g.elements.unionByName(new)
    known = every.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    fixed = every.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).select(*g.elements.columns)
    return Graph(fixed, g.relationships, g.metrics, g.contracts, g.notifying)


def move(g: Graph, ids: DataFrame, to: str) -> Graph:
    """The elements below a new parent, with full names rewritten in their subtrees.

    Not moved may be an assembly, an element into itself or its own subtree, two
    of which one holds the other, and what the new parent can't hold.
    """
    chosen = g.elements.join(ids.select("id").distinct(), "id", "left_semi")
    target = g.elements.where(F.col("id") == to).select("element_type", "full_name").first()
    if target is None:
        raise EditError(f"no element {to}")
    allowed = CHILDREN.get(target["element_type"], ())
    wrong = chosen.where(~F.col("element_type").isin(*allowed) if allowed else F.lit(True)).select("id").first()
    if wrong:
        raise EditError(f"{wrong['id']} can't lie in {to}")
    below = g.subtree(ids)
    if not below.where(F.col("id") == to).isEmpty():
        raise EditError("an element can't be moved into itself")
    if not below.where("root <> id").join(ids.select("id").distinct(), "id", "left_semi").isEmpty():
        raise EditError("of the elements one holds another")
    old = below.join(chosen.select(F.col("id").alias("root"), F.col("full_name").alias("old"), F.concat_ws(".", F.lit(target["full_name"]), "name").alias("new")), "root")
    e = g.elements.join(old, "id", "left")
    name = F.when(F.col("root").isNull(), F.col("full_name")).when(F.expr("startswith(full_name, old)"), F.concat("new", F.expr("substring(full_name, length(old) + 1)"))).otherwise(F.col("full_name"))
    e = e.withColumn("full_name", name).withColumn("parent_id", F.when(F.col("root") == F.col("id"), F.lit(to)).otherwise(F.col("parent_id")))
    return Graph(e.select(*g.elements.columns), g.relationships, g.metrics, g.contracts, g.notifying)


def default_name(g: Graph, parent: str, element_type: str) -> str:
    """`NewClass`, or with the next number if siblings have such names."""
    base = f"New{element_type}"
    r = g.elements.where(F.col("parent_id") == parent).where(F.col("name").rlike(f"^{base}[0-9]*$")).agg(F.count("*").alias("n"), F.max(F.coalesce(F.expr("try_cast(nullif(regexp_extract(name, '([0-9]*)$', 1), '') as int)"), F.lit(1))).alias("m")).first()
    return base if not r["n"] else f"{base}{r['m'] + 1}"


def create(g: Graph, parent: str, element_type: str, ident: str, name: str | None = None) -> Graph:
    holder = g.elements.where(F.col("id") == parent).select("element_type", "full_name").first()
    if holder is None or element_type not in CHILDREN.get(holder["element_type"], ()):
        raise EditError(f"no {element_type} can lie in {parent}")
    name = name or default_name(g, parent, element_type)
    row = g.elements.sparkSession.createDataFrame([(ident, element_type, name, f"{holder['full_name']}.{name}", parent, "Unknown", False, False, [], [])], ELEMENTS)
    return Graph(g.elements.unionByName(row.select(*g.elements.columns)), g.relationships, g.metrics, g.contracts, g.notifying)


def with_global_namespaces(g: Graph) -> Graph:
    """If a type lies right below an assembly, every assembly gets a namespace `global` that takes its types in."""
    tops = g.elements.where("element_type = 'Assembly' and not is_external").select(F.col("id").alias("top"), F.col("full_name").alias("top_name"))
    bare = g.elements.join(tops, F.col("parent_id") == F.col("top"), "left_semi").where("element_type <> 'Namespace'").select("id")
    if bare.isEmpty():
        return g
    none = lambda c: F.array().cast(ELEMENTS[c].dataType).alias(c)
    spaces = tops.select(F.concat("top", F.lit("/global")).alias("id"), F.lit("Namespace").alias("element_type"), F.lit("global").alias("name"), F.concat("top_name", F.lit(".global")).alias("full_name"), F.col("top").alias("parent_id"), F.lit("Unknown").alias("access_level"), F.lit(False).alias("is_external"), F.lit(False).alias("is_generated"), none("attributes"), none("source_locations"))
    old = g.subtree(bare).join(g.elements.select(F.col("id").alias("root"), F.col("parent_id").alias("top")), "root").join(tops, "top")
    e = g.elements.join(old, "id", "left")
    name = F.when(F.col("root").isNotNull(), F.concat("top_name", F.lit(".global"), F.expr("substring(full_name, length(top_name) + 1)"))).otherwise(F.col("full_name"))
    e = e.withColumn("full_name", name).withColumn("parent_id", F.when(F.col("root") == F.col("id"), F.concat("top", F.lit("/global"))).otherwise(F.col("parent_id"))).select(*g.elements.columns)
    return Graph(e.unionByName(spaces.select(*g.elements.columns)), g.relationships, g.metrics, g.contracts, g.notifying)
