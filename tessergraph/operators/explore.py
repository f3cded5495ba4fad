"""Exploration: neighbourhoods, boundaries, gaps, inheritance, callers and shortest paths.

Ids come as a frame with a column `id`. Results are frames of relationships
(source_id, target_id, type, attributes) or of element ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import container_level
from ..model import Graph
from ..plans.fixpoint import TASK_EDGES, numbered, reach
from ..plans.storage import materialize

EDGE = ("source_id", "target_id", "type", "attributes")
CONTRACTS = ("Inherits", "Implements", "Overrides")
#: Kinds of elements that a view may leave out.
HIDEABLE = ("Method", "Property", "PropertyAccessor", "Field", "Event", "Enum", "Delegate")


def _ids(ids: DataFrame, name: str = "id") -> DataFrame:
    return ids.select(F.col("id").alias(name)).distinct()


def get_elements(g: Graph, ids: DataFrame) -> DataFrame:
    return g.elements.join(_ids(ids), "id", "left_semi")


def find_parents(g: Graph, ids: DataFrame) -> DataFrame:
    return get_elements(g, ids).where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()


def outgoing(g: Graph, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return _kinds(g, kinds).join(_ids(ids, "source_id"), "source_id", "left_semi").select(*EDGE)


def incoming(g: Graph, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return _kinds(g, kinds).join(_ids(ids, "target_id"), "target_id", "left_semi").select(*EDGE)


def neighbours(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges in and out of a selection and of its properties' accessors."""
    every = with_accessors(g, ids)
    return outgoing(g, every).unionByName(incoming(g, every)).distinct()


def _kinds(g: Graph, kinds: tuple[str, ...] | None) -> DataFrame:
    return g.relationships.where(F.col("type").isin(*kinds)) if kinds else g.relationships


def with_accessors(g: Graph, ids: DataFrame) -> DataFrame:
    properties = get_elements(g, ids).where("element_type = 'Property'").select(F.col("id").alias("parent_id"))
    return _ids(ids).unionByName(g.elements.where("element_type = 'PropertyAccessor'").join(properties, "parent_id", "left_semi").select("id")).distinct()


def outgoing_deep(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges from inside the subtrees of the ids to outside."""
    inside = g.subtree(ids).select("id").distinct()
    return outgoing(g, inside).join(_ids(inside, "target_id"), "target_id", "left_anti").select(*EDGE)


def incoming_deep(g: Graph, ids: DataFrame) -> DataFrame:
    inside = g.subtree(ids).select("id").distinct()
    return incoming(g, inside).join(_ids(inside, "source_id"), "source_id", "left_anti").select(*EDGE)


def induced(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return outgoing(g, ids).join(_ids(ids, "target_id"), "target_id", "left_semi").select(*EDGE)


def relationships_between_roots(g: Graph, roots: DataFrame) -> DataFrame:
    """Edges between the subtrees of two different roots; an element may lie below several."""
    sub = materialize(g.subtree(roots), "subtrees")
    s, t = sub.select(F.col("root").alias("s"), F.col("id").alias("source_id")), sub.select(F.col("root").alias("t"), F.col("id").alias("target_id"))
    return g.relationships.join(s, "source_id").join(t, "target_id").where("s <> t").select(*EDGE).distinct()


def specializations(g: Graph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, CONTRACTS)


def abstractions(g: Graph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, CONTRACTS)


def missing_types(g: Graph, ids: DataFrame) -> DataFrame:
    """Unknown elements between members among the ids and their containing type, that type included."""
    p = g.paths.join(_ids(ids), "id", "left_semi").where(container_level(F.col("element_type")) == 0)
    up = p.select("id", F.posexplode("path").alias("pos", "above"), "lift20", F.array_position("path", F.col("lift20")).alias("top"))
    return up.where("above <> id and pos + 1 >= top").select(F.col("above").alias("id")).distinct().join(_ids(ids), "id", "left_anti")


def hierarchy_gaps(g: Graph, ids: DataFrame) -> DataFrame:
    """For each id, the ancestors below its topmost known ancestor that aren't known."""
    known = _ids(ids)
    up = g.paths.join(known, "id", "left_semi").select("id", F.posexplode("path").alias("pos", "above")).where("above <> id")
    first = up.join(known.select(F.col("id").alias("above")), "above", "left_semi").groupBy("id").agg(F.min("pos").alias("top"))
    return up.join(first, "id").where("pos > top").select(F.col("above").alias("id")).distinct().join(known, "id", "left_anti")


def dead_ends(g: Graph) -> DataFrame:
    """Edges of which an end is no element."""
    known = g.elements.select("id")
    lost = lambda side: g.relationships.join(known.select(F.col("id").alias(side)), side, "left_anti").select(*EDGE)
    return lost("source_id").unionByName(lost("target_id")).distinct()


def hide(g: Graph, element_types: tuple[str, ...] = (), relationship_types: tuple[str, ...] = ()) -> Graph:
    """A view without elements and edges of some kinds. Members, enumerations and delegates can be hidden, containers can't; an edge goes with its ends."""
    wrong = set(element_types) - set(HIDEABLE)
    if wrong:
        raise ValueError(f"can't be hidden: {', '.join(sorted(wrong))}")
    elements = g.elements.where(~F.col("element_type").isin(*element_types)) if element_types else g.elements
    edges = g.relationships.where(~F.col("type").isin(*relationship_types)) if relationship_types else g.relationships
    if element_types:
        for side in ("source_id", "target_id"):
            edges = edges.join(elements.select(F.col("id").alias(side)), side, "left_semi")
    return Graph(elements, edges.select(*g.relationships.columns), g.metrics, g.contracts, g.notifying)


def subgraph(g: Graph, ids: DataFrame) -> Graph:
    """The ids' elements and the edges among them; a parent outside is lost."""
    kept = _ids(ids)
    parents = kept.select(F.col("id").alias("parent_id"), F.lit(True).alias("has"))
    elements = get_elements(g, ids).join(parents, "parent_id", "left").withColumn("parent_id", F.when(F.col("has"), F.col("parent_id"))).select(*g.elements.columns)
    return Graph(elements, induced(g, ids))


def focus_crossing(g: Graph, ids: DataFrame, outward: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges crossing the border of the subtrees, and the elements that stay: their ends and all ancestors of these."""
    edges = outgoing_deep(g, ids) if outward else incoming_deep(g, ids)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return edges, g.paths.join(ends, "id", "left_semi").select(F.explode("path").alias("id")).distinct()


def callers(g: Graph, ids: DataFrame) -> DataFrame:
    """All direct and indirect callers: id and least number of calls. A start is there only if a cycle of calls leads back to it."""
    back = g.relationships.where("type = 'Calls'").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return reach(back, _ids(ids).select(F.lit(0).alias("origin"), F.col("id").alias("node"))).select(F.col("node").alias("id"), "depth")


def inheritance_tree(g: Graph, ids: DataFrame) -> DataFrame:
    """Bases above and types derived below each id, and the id; siblings of a base don't belong to it: (origin, id)."""
    up = g.relationships.where("type in ('Inherits', 'Implements')").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    starts = _ids(ids).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(up, starts).select("origin", "node").unionByName(reach(down, starts).select("origin", "node")).unionByName(starts)
    return found.select("origin", F.col("node").alias("id")).distinct()


def _listed(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ends of each node begin, and the ends."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).astype("int32"), b[order].astype("int32")


def _next(front: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each node of a front has, and all of that in a row."""
    many = at[front + 1] - at[front]
    return many, to[np.repeat(at[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def _hierarchies_kernel(t: pa.Table, parts: int) -> pa.Table:
    """One row of all inheritance: names of its classes, who inherits from whom, which are asked for and which can be results.

    Those asked for are in the order of their hierarchies and cut into parts of about equal results, so that
    a task has few hierarchies: it finds the classes of each once, and the files it writes need few names.
    Not `grounded` is what has a circle above, which makes no order.
    """
    mark = t["mark"].to_numpy()
    names, src, dst = numbered(t["src"].filter(pa.array(mark == 0)), t["dst"].filter(pa.array(mark == 0)))
    asked, kinds = (np.sort(pc.index_in(t["src"].filter(pa.array(mark == k)), names).drop_null().to_numpy()) for k in (1, 2))
    n = len(names)
    at, to = _listed(dst, src, n)
    waits, top = np.bincount(src, minlength=n), np.full(n, n)
    front = np.flatnonzero(waits == 0)
    top[front] = front
    while len(front):
        many, near = _next(front, at, to)
        np.minimum.at(top, near, np.repeat(top[front], many))
        np.subtract.at(waits, near, 1)
        near = np.unique(near)
        front = near[waits[near] == 0]
    top[waits > 0] = n
    asked = asked[np.argsort(top[asked], kind="stable")]
    load = np.cumsum(np.bincount(top, minlength=n + 1)[top[asked]])
    cuts = np.r_[0, np.searchsorted(load, np.arange(1, parts) * (load[-1] / parts if len(load) else 0)), len(asked)]
    packed = [pa.array([a.astype(kind).tobytes()], pa.binary()) for a, kind in ((src, "int32"), (dst, "int32"), (asked, "int32"), (cuts, "int32"), (kinds, "int32"), (waits == 0, "bool"))]
    return pa.table([pa.array([names.to_pylist()], pa.list_(pa.string())), *packed], names=["names", "src", "dst", "asked", "cuts", "kinds", "grounded"])


#: Rows of a batch of pairs that a task hands on.
PAIR_ROWS = 1 << 16


def _forbidden_kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each task's share of the containers: what descends from a container's bases, without its bases, what descends from it and itself.

    Whatever descends from the bases descends from the topmost of them, so it is found once for all containers that have the same.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            part = batch["part"][row].as_py()
            names = batch["names"][row].values
            src, dst, asked, cuts, kinds = (np.frombuffer(batch[c][row].as_py(), "int32") for c in ("src", "dst", "asked", "cuts", "kinds"))
            grounded = np.frombuffer(batch["grounded"][row].as_py(), "bool")
            seen, can = np.zeros(len(names), bool), np.zeros(len(names), bool)
            can[kinds] = True
            up, down = _listed(src, dst, len(names)), _listed(dst, src, len(names))
            up_at, up_to, down_at, down_to = (memoryview(a) for a in (*up, *down))

            def reached(c: int, at: memoryview, to: memoryview) -> set[int]:
                found, way = set(), [c]
                while way:
                    v = way.pop()
                    for x in to[at[v] : at[v + 1]]:
                        if x not in found:
                            found.add(x)
                            way.append(x)
                return found

            def hierarchy(tops: list[int], seen: np.ndarray = seen, can: np.ndarray = can, down: tuple[np.ndarray, np.ndarray] = down) -> np.ndarray:
                """What can be a result of some classes and all that descends from them."""
                found = [front := np.array(tops, "int32")]
                seen[front] = True
                while len(front):
                    near = _next(front, *down)[1]
                    front = np.unique(near[~seen[near]])
                    seen[front] = True
                    found.append(front)
                every = np.sort(np.concatenate(found))
                seen[every] = False
                return every[can[every]]

            pairs, n, last, every = [], 0, None, None

            def out(pairs: list[tuple[int, np.ndarray]], names: pa.Array = names) -> pa.RecordBatch:
                own = np.repeat([c for c, _ in pairs], [len(x) for _, x in pairs])
                return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(np.concatenate([x for _, x in pairs])))], names=["container", "id"])

            for c in asked[cuts[part] : cuts[part + 1]].tolist():
                bases = reached(c, up_at, up_to)
                tops = sorted(x for x in bases if up_at[x] == up_at[x + 1]) if grounded[c] else sorted(bases)
                if tops != last:
                    last, every = tops, hierarchy(tops)
                own = bases | reached(c, down_at, down_to) | {c}
                own = np.fromiter(own, "int32", len(own))
                seen[own] = True
                found = every[~seen[every]]
                seen[own] = False
                for k in range(0, len(found), PAIR_ROWS):
                    pairs.append((c, found[k : k + PAIR_ROWS]))
                    n += len(pairs[-1][1])
                    if n >= PAIR_ROWS:
                        yield out(pairs)
                        pairs, n = [], 0
            if n:
                yield out(pairs)


def forbidden_call_sources(g: Graph, ids: DataFrame) -> DataFrame:
    """(container, id): classes of the whole hierarchy of a container's bases that are neither its bases, nor derived from it, nor itself.

    A call on the current instance can't come from them. Of a graph whose inheritance a
    task can hold (`TASK_EDGES`) each task gets all of it and its share of the
    containers, and pairs go to the result without being stored or dealt out before.
    An end that is null is none.
    """
    kinds = g.shape.where("element_type in ('Class', 'Struct', 'Record')").select(F.col("id").alias("node"))
    step = materialize(g.inherits.where("src is not null and dst is not null"), "inherits", collect=True)
    if step.count() <= TASK_EDGES:
        spark, of = step.sparkSession, lambda df, mark: df.select(F.col(df.columns[0]).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(mark).alias("mark"))
        ends = step.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        # a class without bases has no such sources
        rows = step.withColumn("mark", F.lit(0)).unionByName(of(_ids(ids).join(step.select(F.col("src").alias("id")), "id", "left_semi"), 1)).unionByName(of(kinds.join(ends, "node", "left_semi").distinct(), 2))
        parts = 8 * max(1, spark.sparkContext.defaultParallelism)
        packed = materialize(rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _hierarchies_kernel(t.drop_columns("all"), parts), "names array<string>, src binary, dst binary, asked binary, cuts binary, kinds binary, grounded binary"), "hierarchies")
        each = spark.range(0, parts, 1, parts).select(F.col("id").alias("part")).join(F.broadcast(packed), F.lit(True))  # one row
        return each.mapInArrow(lambda b: _forbidden_kernel(b), "container string, id string")
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = _ids(ids).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    above = materialize(reach(step, starts).select("origin", "node"), "bases")
    below = reach(back, starts).select("origin", "node")
    tree = above.unionByName(reach(back, above).select("origin", "node")).unionByName(reach(step, above).select("origin", "node")).distinct()
    own = above.unionByName(below).unionByName(starts).distinct()
    return tree.join(own, ["origin", "node"], "left_anti").join(kinds, "node", "left_semi").select(F.col("origin").alias("container"), F.col("node").alias("id"))


def walk_inheritance(g: Graph, ids: DataFrame, upward: bool = True) -> DataFrame:
    """Level by level over contracts: (origin, id, depth) at first visit."""
    edges = g.relationships.where(F.col("type").isin(*CONTRACTS)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    edges = edges if upward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, _ids(ids).select(F.col("id").alias("origin"), F.col("id").alias("node"))).where("origin <> node").select("origin", F.col("node").alias("id"), "depth")


def paths_between(g: Graph, ids: DataFrame, most: int = 8) -> DataFrame:
    """All shortest chains of dependencies between each ordered pair of selected roots with disjoint subtrees: (a, b, source_id, target_id, depth).

    The selection is a user's list, so its pairs are the question and few.
    All pairs advance in one loop, a level a round; a pair stops at the first
    level that meets its target. Going back along levels leaves the edges of
    shortest paths only.
    """
    sub = materialize(g.subtree(ids), "subtrees")
    roots = _ids(ids)
    nested = sub.join(roots, "id", "left_semi").where("root <> id")
    pairs = roots.select(F.col("id").alias("a")).join(roots.select(F.col("id").alias("b")), F.col("a") != F.col("b"))
    apart = pairs.join(nested.select(F.col("root").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_anti").join(nested.select(F.col("root").alias("b"), F.col("id").alias("a")), ["a", "b"], "left_anti")
    step = materialize(g.deps.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct(), "hops")
    target = sub.select(F.col("root").alias("b"), F.col("id").alias("dst"), F.lit(True).alias("hit"))
    frontier = materialize(apart.join(sub.select(F.col("root").alias("a"), F.col("id").alias("src")), "a"), "frontier")
    seen, levels, ends = frontier, [], []
    for depth in range(1, most + 1):
        edges = materialize(frontier.join(step, "src").join(seen.select("a", "b", F.col("src").alias("dst")), ["a", "b", "dst"], "left_anti").join(target, ["b", "dst"], "left").select("a", "b", "src", "dst", "hit"), "level")
        if edges.isEmpty():
            break
        levels.append(edges)
        met = materialize(edges.where("hit").select("a", "b", "dst").distinct(), "met")
        ends.append(met)
        frontier = materialize(edges.join(met.select("a", "b").distinct(), ["a", "b"], "left_anti").select("a", "b", F.col("dst").alias("src")).distinct(), "frontier")
        seen = seen.unionByName(frontier)
    out, wanted = None, None
    for depth in range(len(levels), 0, -1):
        goal = ends[depth - 1] if wanted is None else ends[depth - 1].unionByName(wanted).distinct()
        used = materialize(levels[depth - 1].join(goal, ["a", "b", "dst"], "left_semi").select("a", "b", "src", "dst", F.lit(depth).alias("depth")), "used")
        out = used if out is None else out.unionByName(used)
        wanted = used.select("a", "b", F.col("src").alias("dst")).distinct()
    empty = apart.select("a", "b", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("depth")).where("false")
    return (empty if out is None else out).select("a", "b", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "depth")


def bundled_edges(g: Graph, visible: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Edges between the nearest visible ancestors of both ends: (source_id, target_id, edges, type), `Bundled` for several types.

    An edge within one visible element is dropped unless it was an end of it itself.
    """
    shown = _ids(visible, "above")
    near = g.paths.select("id", F.posexplode("path").alias("pos", "above")).join(shown, "above", "left_semi").groupBy("id").agg(F.max_by("above", "pos").alias("shown"))
    edges = _kinds(g, kinds).join(near.select(F.col("id").alias("source_id"), F.col("shown").alias("s")), "source_id").join(near.select(F.col("id").alias("target_id"), F.col("shown").alias("t")), "target_id")
    edges = edges.where("s <> t or source_id = s or target_id = t")
    return edges.groupBy(F.col("s").alias("source_id"), F.col("t").alias("target_id")).agg(F.count("*").alias("edges"), F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("Bundled").alias("type"))


def tree_search(g: Graph, predicate) -> DataFrame:
    """Elements that match or hold a match."""
    hits = g.elements.where(predicate).select("id")
    return g.paths.join(hits, "id", "left_semi").select(F.explode("path").alias("id")).distinct()


def follow_callers(g: Graph, ids: DataFrame) -> DataFrame:
    """Callers by context: elements reached backward from the ids over calls, contracts and events (id).

    A work item is an element with the containers whose forbidden call sources
    apply. A call on the current instance is not followed if its caller's class
    is forbidden; a base call keeps the context and adds its caller's container;
    another call on an instance or a type starts afresh with the caller's
    container; contracts implemented keep the context; of an event, those who
    specialise it keep it and those who raise it start afresh. The walk ends
    when a round finds no new pair of element and context.
    """
    own = materialize(g.end_paths.select("id", F.coalesce("containing_type", "id").alias("container"), "element_type"), "call-ends")
    rel = g.relationships.join(own.select(F.col("id").alias("source_id"), F.col("container").alias("source_container")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("element_type").alias("target_type")), "target_id")
    masked = F.col("attributes").bitwiseAND(31)
    current = (masked == 0) | (masked.bitwiseAND(5) != 0)
    rel = materialize(rel.where("type in ('Calls', 'Implements', 'Overrides', 'Handles', 'Invokes')").withColumn("current", current & (F.col("type") == "Calls")), "call-edges", collect=True)
    # what has no such edge is a result as a start and nothing else
    linked = rel.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    work = materialize(own.join(_ids(ids), "id", "left_semi").join(linked, "id", "left_semi").select("id", F.array("container").alias("context")), "work")
    bases = None if rel.where("current").isEmpty() else _bases(g, rel.where("current").select("source_container"))
    seen, rounds = work, 0
    while True:
        back = work.join(rel, F.col("id") == F.col("target_id"))
        masked, current = F.col("attributes").bitwiseAND(31), F.col("current")
        allowed = F.lit(True)
        if bases is not None:
            back, allowed = _with_forbidden(g, back, bases), ~F.col("forbidden")
        event = F.col("target_type") == "Event"
        fresh = F.array("source_container")
        following = (
            F.when(event & F.col("type").isin("Implements", "Overrides"), F.col("context"))
            .when(event & (F.col("type") == "Invokes"), fresh)
            .when((F.col("type") == "Calls") & allowed & (masked.bitwiseAND(1) != 0), F.array_sort(F.array_union("context", fresh)))
            .when((F.col("type") == "Calls") & allowed & ~current, fresh)
            .when((F.col("type") == "Calls") & allowed, F.col("context"))
        )
        stepped = back.select(F.col("source_id").alias("id"), following.alias("context")).where("context is not null")
        forth = work.join(rel, F.col("id") == F.col("source_id")).where("type in ('Implements', 'Overrides', 'Handles')").select(F.col("target_id").alias("id"), "context")
        new = materialize(stepped.unionByName(forth).distinct().join(seen, ["id", "context"], "left_anti"), "work")
        if new.isEmpty():
            break
        work, seen, rounds = new, seen.unionByName(new), rounds + 1
        if rounds % 16 == 0:
            seen = materialize(seen, "seen")  # one table again, so that plans stay short
    placed = g._placed(g.elements.select("id", "element_type", "is_external", "parent_id").join(_ids(ids), "id", "left_semi"))
    return seen.select("id").unionByName(placed.select("id")).distinct()


def _bases(g: Graph, containers: DataFrame) -> DataFrame:
    """(c, x): the bases x of each of the containers that can be a forbidden call source."""
    kinds = g.elements.where("element_type in ('Class', 'Struct', 'Record')").select(F.col("id").alias("source_container"))
    starts = containers.join(kinds, "source_container", "left_semi").select(F.col("source_container").alias("id")).distinct()
    step = g.relationships.where("type = 'Inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return materialize(reach(step, starts.select(F.col("id").alias("origin"), F.col("id").alias("node"))).select(F.col("origin").alias("c"), F.col("node").alias("x")), "caller-bases", collect=True)


def _with_forbidden(g: Graph, back: DataFrame, bases: DataFrame) -> DataFrame:
    """Steps back with `forbidden`, whether a call on the current instance comes from a class forbidden to a container of its context.

    Two classes of which neither is the other's base are forbidden to each other if
    they share one; so pairs of a container and a caller are tested, and the
    hierarchy of a container is never listed.
    """
    pairs = materialize(back.where("current").select(F.explode("context").alias("c"), F.col("source_container").alias("s")).distinct().where("c <> s"), "call-pairs")
    step = g.relationships.where("type = 'Inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    above = materialize(reach(step, pairs.select(F.col("c").alias("origin"), F.col("c").alias("node"))).select(F.col("origin").alias("c"), F.col("node").alias("x")), "context-bases")
    shared = pairs.join(above, "c").join(bases.select(F.col("c").alias("s"), "x"), ["s", "x"], "left_semi").select("c", "s").distinct()
    near = above.select("c", F.col("x").alias("s")).unionByName(bases.select(F.col("x").alias("c"), F.col("c").alias("s")))
    out = shared.join(near, ["c", "s"], "left_anti").groupBy("s").agg(F.collect_set("c").alias("out"))
    return back.join(out.withColumnRenamed("s", "source_container"), "source_container", "left").withColumn("forbidden", F.coalesce(F.col("current") & F.arrays_overlap("context", "out"), F.lit(False))).drop("out")


def chains(paths: DataFrame, most: int = 15) -> DataFrame:
    """(a, b, chain) of the edges of shortest paths as whole chains of ids, of each pair the first `most` in order.

    A level a round; a pair keeps no more than `most` open chains, each of which can be finished.
    """
    from pyspark.sql import Window

    edges = materialize(paths.select("a", "b", "source_id", "target_id", "depth").distinct(), "chain-edges")
    first = Window.partitionBy("a", "b").orderBy("chain")
    keep = lambda df: df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    longest = edges.groupBy("a", "b").agg(F.max("depth").alias("length"))
    row = longest.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    open_ = keep(edges.where("depth = 1").select("a", "b", F.array("source_id", "target_id").alias("chain")))
    out = None
    for depth in range(1, row + 1):
        open_ = materialize(open_, "chains")
        done = open_.join(longest.where(F.col("length") == depth), ["a", "b"], "left_semi")
        out = done if out is None else out.unionByName(done)
        step = edges.where(F.col("depth") == depth + 1).select("a", "b", F.col("source_id").alias("end"), "target_id")
        open_ = keep(open_.withColumn("end", F.element_at("chain", -1)).join(step, ["a", "b", "end"]).select("a", "b", F.concat("chain", F.array("target_id")).alias("chain")))
    return open_ if out is None else out
