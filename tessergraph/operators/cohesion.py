"""Partitions of a type's members that have nothing to do with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_dependency
from ..model import Graph
from ..plans.fixpoint import connected_components, reach
from ..plans.storage import materialize

LIFECYCLE = (".ctor", ".cctor", "Finalize")


def partitions(g: Graph, types: DataFrame, lifecycle: bool = False, bases: bool = False) -> DataFrame:
    """(type_id, partition, id) of the descendants of each type.

    Members hang together by containment among them and by any dependency.
    With `bases`, members of the types it inherits from tie them as well (by calls
    and uses only) and are taken out at the end. Nodes are keyed by type, so a
    member that several types inherit doesn't tie those types.
    """
    names = g.elements.select("id", "name", "parent_id", "element_type")
    wanted = names if lifecycle else names.where(~((F.col("element_type") == "Method") & F.col("name").isin(*LIFECYCLE)))
    own = g.below(types, "name", "element_type").where("root <> id")
    own = own if lifecycle else own.where(~((F.col("element_type") == "Method") & F.col("name").isin(*LIFECYCLE)))
    own = own.select(F.col("root").alias("type_id"), "id", "parent_id", F.lit(False).alias("base"))
    if bases:
        up = g.relationships.where("type = 'Inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        above = reach(up, types.select(F.col("id").alias("origin"), F.col("id").alias("node"))).join(g.types.select(F.col("id").alias("node")), "node", "left_semi")
        # a base's member ties others only by a call or use, so only ends of those are looked at
        ends = g.relationships.where("type in ('Calls', 'Uses')").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        inherited = above.where("origin <> node").join(wanted.join(ends, "id", "left_semi"), F.col("parent_id") == F.col("node")).select(F.col("origin").alias("type_id"), "id", F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("base"))
        own = own.unionByName(inherited)
    # members that nothing ties are parts of their own; only ends of dependencies and what lies deeper are searched
    linked = g.relationships.where(is_dependency(F.col("type"))).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    tying = materialize(own.join(linked, "id", "left_semi").dropDuplicates(["type_id", "id"]), "members", collect=True)
    key = lambda c: F.concat_ws("\x1f", "type_id", c)
    side = lambda n: tying.select("type_id", F.col("id").alias(n), F.col("base").alias(f"{n}_base"))
    tied = g.relationships.where(is_dependency(F.col("type"))).join(side("source_id"), "source_id").join(side("target_id"), ["type_id", "target_id"])
    tied = tied.where("not (source_id_base or target_id_base) or type in ('Calls', 'Uses')").select(key("source_id").alias("a"), key("target_id").alias("b"))
    mine = own.where("not base")
    within = mine.where("parent_id <> type_id").join(mine.select("type_id", F.col("id").alias("parent_id")), ["type_id", "parent_id"], "left_semi").select(key("id").alias("a"), key("parent_id").alias("b"))
    found = connected_components(tied.unionByName(within), "a", "b", "partitions")
    named = found.select(F.split("node", "\x1f")[0].alias("type_id"), F.split("node", "\x1f")[1].alias("id"), "component")
    named = materialize(mine.select("type_id", "id").distinct().join(named, ["type_id", "id"], "left"), "partitions", codec="zstd", collect=True)
    least = named.where("component is not null").groupBy("component").agg(F.min("id").alias("partition"))
    return named.join(least, "component", "left").select("type_id", F.coalesce("partition", "id").alias("partition"), "id")


def type_cohesion(g: Graph, least: int = 4) -> DataFrame:
    """Classes of the analyzed code with `least` or more methods whose members fall apart, those of their bases tying them too: id, full_name, methods, partitions, share of the largest."""
    classes = g.elements.where("element_type = 'Class' and not is_external").select("id", "full_name")
    methods = g.elements.where((F.col("element_type") == "Method") & ~F.col("name").isin(*LIFECYCLE)).select("id", F.col("parent_id").alias("type_id")).join(classes.select(F.col("id").alias("type_id")), "type_id", "left_semi")
    many = methods.groupBy("type_id").agg(F.count("*").alias("methods")).where(F.col("methods") >= least)
    parts = partitions(g, many.select(F.col("type_id").alias("id")), bases=True)
    sizes = parts.join(methods, ["type_id", "id"], "left_semi").groupBy("type_id", "partition").agg(F.count("*").alias("n"))
    split = sizes.groupBy("type_id").agg(F.count("*").alias("partitions"), (F.max("n") / F.sum("n")).alias("share")).where("partitions >= 2")
    return split.join(many, "type_id").join(classes.withColumnRenamed("id", "type_id"), "type_id").select(F.col("type_id").alias("id"), "full_name", "methods", "partitions", "share")
