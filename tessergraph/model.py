"""The graph model: a containment forest of elements with typed, flagged relationships, as frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import container_level, is_dependency, is_type
from .plans.storage import materialize

LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
ELEMENTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "element_type", "name", "full_name", "parent_id", "access_level")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_external", "is_generated")]
    + [T.StructField("attributes", T.ArrayType(T.StringType())), T.StructField("source_locations", T.ArrayType(LOCATION))]
)
RELATIONSHIPS = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "type")] + [T.StructField("attributes", T.IntegerType()), T.StructField("source_locations", T.ArrayType(LOCATION))])
#: `is_type` of t, as text.
KINDS = "t in ('Class','Interface','Struct','Record','Enum','Delegate')"


def canonical(relationships: DataFrame) -> DataFrame:
    """One row a (source, target, type): flags or-ed, locations merged."""
    return relationships.groupBy("source_id", "target_id", "type").agg(F.bit_or("attributes").alias("attributes"), F.array_distinct(F.flatten(F.collect_list("source_locations"))).alias("source_locations"))


@dataclass
class Graph:
    """Elements and relationships; what is derived from them is made once and kept in the shared folder."""

    elements: DataFrame
    relationships: DataFrame
    metrics: DataFrame | None = None
    #: (element_id, contract): members that implement something from outside, recorded beside the graph; and ids of types whose public properties markup may bind.
    contracts: DataFrame | None = None
    notifying: DataFrame | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    @property
    def shape(self) -> DataFrame:
        """id, element_type, is_external and parent_id of all elements; a source may have a shorter way to them than its whole elements."""
        return self.elements.select("id", "element_type", "is_external", "parent_id")

    def ends_among(self, ids: DataFrame) -> DataFrame:
        """`shape` of the elements with these distinct ids, all of them ends of relationships."""
        return self.shape.join(ids.select("id").hint("shuffle_hash"), "id", "left_semi")

    @property
    def holders(self) -> DataFrame:
        """id, element_type and parent_id of the elements that hold others; a source that knows which kinds can may add some that hold nothing."""
        held = self.shape.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
        return self.shape.select("id", "element_type", "parent_id").join(held, "id", "left_semi")

    @property
    def inherits(self) -> DataFrame:
        """Distinct (src, dst) of what inherits and from what; a source may have a shorter way to them than all relationships."""
        return self.relationships.where("type = 'Inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()

    @cached_property
    def holder_paths(self) -> DataFrame:
        """id, path (root to itself) and types along it of each of the `holders`; path is null where a cycle of parents makes none.

        One self join a level of the forest, of these elements only: most are leaves and hold nothing.
        """
        e = materialize(self.holders, "holders")
        roots = e.join(e.select(F.col("id").alias("parent")), F.col("parent_id") == F.col("parent"), "left_anti")
        level = materialize(roots.select("id", F.array("id").alias("path"), F.array("element_type").alias("types")), "holder-levels")
        done = level
        while not level.isEmpty():
            up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"), F.col("types").alias("types_above"))
            level = materialize(e.join(up, "parent_id").select("id", F.concat("above", F.array("id")).alias("path"), F.concat("types_above", F.array("element_type")).alias("types")), "holder-levels")
            done = done.unionByName(level)
        return materialize(e.select("id").join(done, "id", "left"), "holder-paths", codec="zstd", collect=True)

    def _placed(self, elements: DataFrame) -> DataFrame:
        """What `paths` says, of some elements (id, element_type, is_external, parent_id): one join with the paths of what holds them."""
        up = self.holder_paths.select(F.col("id").alias("parent_id"), F.col("path").alias("above"), F.col("types").alias("types_above"), F.lit(True).alias("held"))
        done = elements.join(up, "parent_id", "left").where("held is null or above is not null")
        grown = lambda above, c: F.when(F.col(above).isNull(), F.array(c)).otherwise(F.concat(above, F.array(c)))
        done = done.select("id", "element_type", "is_external", grown("above", "id").alias("path"), grown("types_above", "element_type").alias("types"))
        last = lambda test: F.expr("element_at(path, cast(greatest(1, size(types) - array_position(reverse(transform(types, t -> %s)), true) + 1) as int))" % test)
        kinds = KINDS
        high = "t in ('Assembly','Namespace')"
        return done.withColumns(
            {
                "depth": F.size("path"),
                "containing_type": F.when(F.exists("types", is_type), last(kinds)),
                "assembly_id": F.when(F.col("types")[0] == "Assembly", F.col("path")[0]),
                "lift20": F.when(F.exists("types", lambda t: container_level(t) >= 20), last(f"({kinds} or {high})")),
                "lift30": F.when(F.exists("types", lambda t: container_level(t) >= 30), last(high)),
            }
        )

    @cached_property
    def paths(self) -> DataFrame:
        """id, element_type, is_external, path (root to itself), types along it, depth, nearest type, assembly and ancestors-or-self of level 20 and 30.

        A parent that is missing makes a root; one that is part of a cycle makes no path.
        """
        return materialize(self._placed(self.elements.select("id", "element_type", "is_external", "parent_id")), "paths", codec="zstd", collect=True)

    @cached_property
    def ends(self) -> DataFrame:
        """id, element_type, is_external and parent_id of the elements that have relationships."""
        ids = self.relationships.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        return materialize(self.ends_among(ids).select("id", "element_type", "is_external", "parent_id"), "ends", codec="zstd", collect=True)

    @cached_property
    def end_paths(self) -> DataFrame:
        """`paths` of the elements that have relationships; all that lifting edges needs."""
        return materialize(self._placed(self.ends), "end-paths", codec="zstd", collect=True)

    @cached_property
    def deps(self) -> DataFrame:
        return self.relationships.where(is_dependency(F.col("type")))

    @cached_property
    def types(self) -> DataFrame:
        """Types of the analyzed code."""
        return self.elements.where(is_type(F.col("element_type")) & ~F.col("is_external"))

    @property
    def type_ids(self) -> DataFrame:
        """id of the `types`."""
        return self.shape.where(is_type(F.col("element_type")) & ~F.col("is_external")).select("id")

    @cached_property
    def type_ends(self) -> DataFrame:
        """id and nearest type, itself included, of the elements that have dependencies and are inside of types of the analyzed code."""
        ids = self.deps.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        # the nearest type of what holds an element is its own, if it isn't a type
        near = F.expr("element_at(path, cast(size(types) - array_position(reverse(transform(types, t -> %s)), true) + 1 as int))" % KINDS)
        up = self.holder_paths.select(F.col("id").alias("parent_id"), F.when(F.exists("types", is_type), near).alias("above"), F.col("path").isNull().alias("lost"))
        e = self.ends_among(ids).select("id", "element_type", "parent_id").join(up.hint("shuffle_hash"), "parent_id", "left").where("lost is null or not lost")
        e = e.select("id", F.when(is_type(F.col("element_type")), F.col("id")).otherwise(F.col("above")).alias("type"))
        own = self.type_ids.select(F.col("id").alias("type"))
        return materialize(e.join(own.hint("shuffle_hash"), "type", "left_semi").select("id", "type"), "type-ends", codec="zstd", collect=True)

    @cached_property
    def type_edges(self) -> DataFrame:
        """Distinct (src, dst) between types of the analyzed code, from dependencies of anything inside them."""
        at = lambda side, name: self.type_ends.select(F.col("id").alias(side), F.col("type").alias(name)).hint("shuffle_hash")
        edges = self.deps.select("source_id", "target_id").join(at("source_id", "src"), "source_id").join(at("target_id", "dst"), "target_id")
        return materialize(edges.where("src <> dst").select("src", "dst").distinct(), "type-edges", codec="zstd", collect=True)

    @cached_property
    def assembly_edges(self) -> DataFrame:
        own = self.elements.where("element_type = 'Assembly' and not is_external").select("id")
        return self._lifted("assembly_id", own)

    def _lifted(self, to: str, vertices: DataFrame) -> DataFrame:
        at = lambda side, name: self.end_paths.select(F.col("id").alias(side), F.col(to).alias(name))
        edges = self.deps.select("source_id", "target_id").join(at("source_id", "src"), "source_id").join(at("target_id", "dst"), "target_id")
        edges = edges.where("src <> dst").select("src", "dst").distinct()
        for side in ("src", "dst"):
            edges = edges.join(vertices.select(F.col("id").alias(side)), side, "left_semi")
        return edges.select("src", "dst")

    def closure(self) -> DataFrame:
        """(root, id): each element and all elements of its path, itself included."""
        return self.paths.select(F.explode("path").alias("root"), "id")

    def subtree(self, ids: DataFrame) -> DataFrame:
        """(root, id) for the given root ids: descendants and the root."""
        own = self.elements.select("id", "element_type", "is_external", "parent_id").join(ids.select("id"), "id", "left_semi")
        return self._placed(own).select(F.col("id").alias("root"), "id").unionByName(self.below(ids).select("root", "id"))

    def below(self, ids: DataFrame, *columns: str) -> DataFrame:
        """(root, id) and further columns of the descendants of the given root ids. Only paths of elements that hold others are taken apart."""
        held = self.holder_paths.select(F.explode("path").alias("root"), F.col("id").alias("parent_id")).join(ids.select(F.col("id").alias("root")), "root", "left_semi")
        return self.elements.select("id", "parent_id", *columns).join(held, "parent_id").select("root", "id", "parent_id", *columns)


class DeferredGraph(Graph):
    """A graph whose frames are made when they are first asked for: makers by name of frame."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers, self._kept = makers, {}

    def _made(self, name: str) -> DataFrame | None:
        return self._makers[name]() if name in self._makers else None

    #: These have makers where the source has a shorter way to them than the stored frames, which are taken for `shape` and `inherits` once they are there.
    ends_among = lambda self, ids: self._makers["ends_among"](ids) if "ends_among" in self._makers else Graph.ends_among(self, ids)
    shape = property(lambda self: self._made("shape") if "shape" in self._makers and "elements" not in vars(self) else Graph.shape.fget(self))
    holders = property(lambda self: self._made("holders") if "holders" in self._makers else Graph.holders.fget(self))
    inherits = property(lambda self: self._made("inherits") if "inherits" in self._makers and "relationships" not in vars(self) else Graph.inherits.fget(self))
    elements = cached_property(lambda self: self._made("elements"))
    relationships = cached_property(lambda self: self._made("relationships"))
    metrics = cached_property(lambda self: self._made("metrics"))
    contracts = cached_property(lambda self: self._made("contracts"))
    notifying = cached_property(lambda self: self._made("notifying"))
