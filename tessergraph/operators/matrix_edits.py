"""Edits of a matrix with undo and redo.

A matrix is two frames: elements (id, name, element_type, parent, position, deleted) and relations (consumer, provider, type,
weight, deleted). An action makes a new matrix and leaves the old one as it is, so undoing is going back to it. Deleting
only marks rows. Weights between all levels are derived from what isn't deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import reach
from ..plans.storage import materialize
from .edits import EditError
from .matrix import SORTS


@dataclass(frozen=True)
class Matrix:
    elements: DataFrame
    relations: DataFrame

    @classmethod
    def of(cls, elements: DataFrame, relations: DataFrame) -> Matrix:
        """From (id, name, element_type, parent) and (consumer, provider, type, weight): siblings in the order of their names; relations to themselves go."""
        order = F.row_number().over(Window.partitionBy("parent").orderBy("name", "id")).cast("long")
        e = elements.select("id", "name", "element_type", "parent", order.alias("position"), F.lit(False).alias("deleted"))
        return cls(e, relations.where("consumer <> provider").select("consumer", "provider", "type", F.col("weight").cast("long").alias("weight"), F.lit(False).alias("deleted")))

    def living(self) -> DataFrame:
        return self.elements.where("not deleted").drop("deleted")

    def lines(self) -> DataFrame:
        """(id, above): each living element with itself and all it lies in."""
        e = self.living()
        up = reach(e.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst")), e.select(F.col("id").alias("origin"), F.col("id").alias("node")))
        return up.select(F.col("origin").alias("id"), F.col("node").alias("above")).unionByName(e.select("id", F.col("id").alias("above")))

    def subtree(self, ident: str) -> DataFrame:
        return self.lines().where(F.col("above") == ident).select("id")

    def weights(self) -> DataFrame:
        """(consumer, provider, weight) between all elements of different lines."""
        line = materialize(self.lines().groupBy("id").agg(F.collect_set("above").alias("line")), "matrix-lines")
        side = lambda c: line.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line"))
        r = self.relations.where("not deleted").join(side("consumer"), "consumer").join(side("provider"), "provider")
        r = r.select(F.explode(F.array_except("consumer_line", "provider_line")).alias("c"), F.array_except("provider_line", "consumer_line").alias("p"), "weight")
        return r.select(F.col("c").alias("consumer"), F.explode("p").alias("provider"), "weight").groupBy("consumer", "provider").agg(F.sum("weight").alias("weight"))


def _one(m: Matrix, ident: str) -> dict:
    found = m.living().where(F.col("id") == ident).first()
    if found is None:
        raise EditError(f"no element {ident}")
    return found.asDict()


def _set(m: Matrix, ident: str, column: str, value: Column) -> Matrix:
    return Matrix(m.elements.withColumn(column, F.when(F.col("id") == ident, value).otherwise(F.col(column))), m.relations)


def _siblings(m: Matrix, parent: str | None) -> DataFrame:
    return m.living().where(F.col("parent").eqNullSafe(F.lit(parent)))


def _free_name(m: Matrix, parent: str | None, name: str, ident: str | None = None) -> None:
    if not _siblings(m, parent).where((F.col("name") == name) & ~F.col("id").eqNullSafe(F.lit(ident))).isEmpty():
        raise EditError(f"a sibling is named {name}")


def rename(m: Matrix, ident: str, name: str) -> Matrix:
    _free_name(m, _one(m, ident)["parent"], name, ident)
    return _set(m, ident, "name", F.lit(name))


def retype(m: Matrix, ident: str, element_type: str) -> Matrix:
    _one(m, ident)
    return _set(m, ident, "element_type", F.lit(element_type))


def reparent(m: Matrix, ident: str, to: str | None) -> Matrix:
    """Below a new parent, as its last child; what cutting and pasting does."""
    name = _one(m, ident)["name"]
    if to is not None:
        _one(m, to)
        if not m.subtree(ident).where(F.col("id") == to).isEmpty():
            raise EditError("an element can't be moved into itself")
    _free_name(m, to, name, ident)
    last = _siblings(m, to).agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    return _set(_set(m, ident, "parent", F.lit(to).cast("string")), ident, "position", F.lit(last + 1))


def create(m: Matrix, ident: str, name: str, element_type: str, parent: str | None = None) -> Matrix:
    if parent is not None:
        _one(m, parent)
    if not m.elements.where(F.col("id") == ident).isEmpty():
        raise EditError(f"there is an element {ident}")
    _free_name(m, parent, name)
    last = _siblings(m, parent).agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    row = m.elements.sparkSession.createDataFrame([(ident, name, element_type, parent, last + 1, False)], m.elements.schema)
    return Matrix(m.elements.unionByName(row), m.relations)


def delete(m: Matrix, ident: str) -> Matrix:
    """The subtree and all relations that touch it are marked."""
    _one(m, ident)
    gone = materialize(m.subtree(ident).withColumn("gone", F.lit(True)), "matrix-gone")
    e = m.elements.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).select(*m.elements.columns)
    end = lambda c: gone.select(F.col("id").alias(c), F.col("gone").alias(f"{c}_gone"))
    r = m.relations.join(end("consumer"), "consumer", "left").join(end("provider"), "provider", "left")
    return Matrix(e, r.withColumn("deleted", F.col("deleted") | F.coalesce("consumer_gone", "provider_gone", F.lit(False))).select(*m.relations.columns))


def copy(m: Matrix, ident: str, to: str | None, suffix: str = "#copy") -> Matrix:
    """The subtree again below another element, ids with a suffix, without relations."""
    name = _one(m, ident)["name"]
    _free_name(m, to, name)
    last = _siblings(m, to).agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    top = F.col("id") == ident
    rows = m.elements.where("not deleted").join(m.subtree(ident), "id", "left_semi")
    rows = rows.select(F.concat("id", F.lit(suffix)).alias("id"), "name", "element_type", F.when(top, F.lit(to).cast("string")).otherwise(F.concat("parent", F.lit(suffix))).alias("parent"), F.when(top, F.lit(last + 1)).otherwise(F.col("position")).alias("position"), "deleted")
    if not m.elements.join(rows.select("id"), "id", "left_semi").isEmpty():
        raise EditError(f"there are elements with ids that end in {suffix}")
    return Matrix(m.elements.unionByName(rows), m.relations)


def _swap(m: Matrix, ident: str, step: int) -> Matrix:
    here = _one(m, ident)
    near = _siblings(m, here["parent"]).where(F.col("position") < here["position"] if step < 0 else F.col("position") > here["position"])
    other = near.orderBy(F.desc("position") if step < 0 else F.asc("position")).first()
    if other is None:
        raise EditError(f"{ident} stands at the end")
    return _set(_set(m, ident, "position", F.lit(other["position"])), other["id"], "position", F.lit(here["position"]))


def sort(m: Matrix, ident: str | None, order: str = "Partition", deep: bool = False) -> Matrix:
    """Children of an element (of none: the roots) in the order named; with `deep` of all elements below as well. The children of one element are one group."""
    if order not in SORTS:
        raise EditError(f"no order {order}")
    arrange = SORTS[order]
    e = m.living()
    if deep and ident is not None:
        e = e.join(m.subtree(ident).withColumnRenamed("id", "parent"), "parent", "left_semi")
    elif not deep:
        e = e.where(F.col("parent").eqNullSafe(F.lit(ident)))
    of = e.select("id", F.coalesce("parent", F.lit("")).alias("group"), "position", "name")
    near = m.weights().join(of.select(F.col("id").alias("consumer"), F.col("group")), "consumer").join(of.select(F.col("id").alias("provider"), F.col("group").alias("g")), "provider").where("group = g")
    rows = of.withColumn("to", F.lit(None).cast("string")).unionByName(near.select(F.col("consumer").alias("id"), "group", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("name"), F.col("provider").alias("to")))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["to"].isna()].sort_values(["name", "id"] if order == "Alphabetical" else ["position", "id"])
        edges = pdf[pdf["to"].notna()]
        named = list(nodes["id"])
        new = named if order == "Alphabetical" else arrange(named, set(zip(edges["id"], edges["to"], strict=True)))
        return pd.DataFrame({"id": new, "new": range(1, len(new) + 1)})

    placed = materialize(rows.groupBy("group").applyInPandas(kernel, "id string, new long"), "matrix-order")
    return Matrix(m.elements.join(placed, "id", "left").withColumn("position", F.coalesce("new", "position")).select(*m.elements.columns), m.relations)


def _is(consumer: str, provider: str, kind: str) -> Column:
    return (F.col("consumer") == consumer) & (F.col("provider") == provider) & (F.col("type") == kind) & ~F.col("deleted")


def create_relation(m: Matrix, consumer: str, provider: str, kind: str, weight: int = 1) -> Matrix:
    _one(m, consumer), _one(m, provider)
    if consumer == provider:
        raise EditError("no relation leads from an element to itself")
    if not m.relations.where(_is(consumer, provider, kind)).isEmpty():
        raise EditError("there is such a relation")
    row = m.relations.sparkSession.createDataFrame([(consumer, provider, kind, weight, False)], m.relations.schema)
    return Matrix(m.elements, m.relations.unionByName(row))


def _change(m: Matrix, consumer: str, provider: str, kind: str, column: str, value: Column) -> Matrix:
    if m.relations.where(_is(consumer, provider, kind)).isEmpty():
        raise EditError("no such relation")
    return Matrix(m.elements, m.relations.withColumn(column, F.when(_is(consumer, provider, kind), value).otherwise(F.col(column))))


ACTIONS: dict[str, Callable[..., Matrix]] = {
    "rename": rename, "retype": retype, "reparent": reparent, "create": create, "delete": delete, "copy": copy, "sort": sort, "create_relation": create_relation,
    "move_up": lambda m, ident: _swap(m, ident, -1), "move_down": lambda m, ident: _swap(m, ident, 1), "sort_deep": lambda m, ident, order="Partition": sort(m, ident, order, True),
    "delete_relation": lambda m, consumer, provider, kind: _change(m, consumer, provider, kind, "deleted", F.lit(True)),
    "retype_relation": lambda m, consumer, provider, kind, to: _change(m, consumer, provider, kind, "type", F.lit(to)),
    "reweight_relation": lambda m, consumer, provider, kind, weight: _change(m, consumer, provider, kind, "weight", F.lit(weight).cast("long")),
}


class Editor:
    """A matrix, what was done to it, and what was undone."""

    def __init__(self, matrix: Matrix):
        self.matrix, self._done, self._undone = matrix, [], []

    def apply(self, action: str, **arguments) -> Matrix:
        following = ACTIONS[action](self.matrix, **arguments)
        following = Matrix(materialize(following.elements, "matrix-elements"), materialize(following.relations, "matrix-relations"))
        self._done.append((action, arguments, self.matrix))
        self._undone.clear()
        self.matrix = following
        return following

    def undo(self) -> bool:
        if not self._done:
            return False
        action, arguments, before = self._done.pop()
        self._undone.append((action, arguments, self.matrix))
        self.matrix = before
        return True

    def redo(self) -> bool:
        if not self._undone:
            return False
        action, arguments, after = self._undone.pop()
        self._done.append((action, arguments, self.matrix))
        self.matrix = after
        return True

    def log(self) -> list[tuple[str, dict]]:
        return [(action, arguments) for action, arguments, _ in self._done]
