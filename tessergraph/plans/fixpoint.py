"""Loops over edge tables. Every round is an aggregation and joins, cut by a shared table; the driver sees counts only."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, node, depth) of all nodes at one step or more from each origin over (src, dst) edges, by least depth.

    `starts` holds (origin, node). A start is itself a result only if a cycle leads back to it.
    """
    step = edges.select("src", "dst").distinct()
    frontier = materialize(starts.select("origin", "node").distinct(), "frontier", collect=True)
    seen, depth = None, 0
    while most is None or depth < most:
        depth += 1
        found = frontier.join(step, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        new = materialize(found.withColumn("depth", F.lit(depth)), "frontier", collect=True)
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select("origin", "node")
    return seen if seen is not None else starts.select("origin", "node").where("false").withColumn("depth", F.lit(0))


#: Rows of a key above which a join deals it out anew, the share of all rows that makes a key one of at most as many, and into how many parts.
HUB_ROWS, HUB_SHARE, HUB_PARTS = 1000, 4096, 64


def _join_hubs(left: DataFrame, right: DataFrame, key: str, other: str, rows: int) -> DataFrame:
    """`left` joined to the one row of each key in `right`; keys with very many of the left rows are dealt out by `other` as well.

    Hubs hold more than one in `HUB_SHARE` of the rows, so there are fewer than that, whatever the table.
    """
    most = max(HUB_ROWS, rows // HUB_SHARE)
    hubs = left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key).collect() if rows > most else []
    if not hubs:
        return left.join(right, key)
    hub = F.broadcast(left.sparkSession.createDataFrame(hubs, left.select(key).schema).withColumn("hub", F.lit(True)))
    part = F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(HUB_PARTS)).cast("int")).otherwise(0)
    parts = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).otherwise(F.array(F.lit(0))))
    return left.join(hub, key, "left").withColumn("part", part).drop("hub").join(right.join(hub, key, "left").withColumn("part", parts).drop("hub"), [key, "part"]).drop("part")


def connected_components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, component) for every node of an undirected edge list; a component is named by its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes. Self edges name a component of one node; null ends are
    dropped; an empty edge list gives no rows.
    """
    u, v = F.col("u"), F.col("v")
    pairs = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"), f"{label}-pairs")
    n = pairs.count()
    nodes = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{label}-nodes", 2 * n)
    state = materialize(pairs.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), f"{label}-edges", n)
    discard(pairs)

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())

    seen = fingerprint(state)
    while seen[0]:
        both = state.unionByName(state.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _join_hubs(both, least, "u", "v", 2 * seen[0]).where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(v.alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = materialize(small, f"{label}-edges", 2 * seen[0])
        now = fingerprint(following)
        discard(state)
        state = following
        if now == seen:
            break
        seen = now
    return nodes.join(state.groupBy(u.alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Steps of a round that is one job.
STEPS = 3


def _trim(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges between nodes that have edges in and out, for some rounds; what goes can be in no cycle, and what stays is sorted out by colours."""
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        kept = materialize(edges.join(both, edges["src"] == both["node"], "left_semi").join(both.withColumnRenamed("node", "other"), F.col("dst") == F.col("other"), "left_semi"), "scc-trim", n)
        discard(edges)
        m = kept.count()
        edges, n = kept, (0 if m == n else m)
        if not n:
            break
    return edges


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node, itself included."""
    most = 2 * edges.count()
    table = materialize(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "scc-colour", most)
    colours, changed = table, table
    while True:
        before, step, sent = colours, colours, changed
        for _ in range(STEPS):
            told = sent.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
            step = step.join(told, "node", "left").select("node", F.least("colour", "told").alias("colour"))
            sent = step
        following = materialize(step.join(before.withColumnRenamed("colour", "before"), "node").select("node", "colour", (F.col("colour") < F.col("before")).alias("new")), "scc-colour", most)
        discard(table)
        table, colours, changed = following, following.select("node", "colour"), following.where("new").select("node", "colour")
        if changed.isEmpty():
            return colours


#: Edges that one task searches at once, some 100 MB of names; a graph of more is cut down by rounds over all tasks first.
TASK_EDGES = 4_000_000


def numbered(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names by bytes, which is by code point, and both ends of edges as places among them."""
    names = pc.unique(pa.chunked_array([*src.chunks, *dst.chunks], pa.string()))
    names = names.take(pc.sort_indices(names))
    return names, pc.index_in(src, names).to_numpy(), pc.index_in(dst, names).to_numpy()


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's strong component (Tarjan, 1972, without recursion)."""
    order = np.argsort(src, kind="stable")
    at, to = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    place, low, group = [0] * n, [0] * n, [-1] * n
    following, open_, seen = at[:n], [], 0
    for root in range(n):
        if place[root]:
            continue
        way = [root]
        while way:
            v = way[-1]
            if not place[v]:
                seen += 1
                place[v] = low[v] = seen
                open_.append(v)
            k, end = following[v], at[v + 1]
            while k < end:
                x = to[k]
                if not place[x]:
                    break
                if group[x] < 0 and low[x] < low[v]:
                    low[v] = low[x]
                k += 1
            following[v] = k
            if k < end:
                way.append(to[k])
                continue
            way.pop()
            if low[v] == place[v]:
                first = len(open_) - 1
                while open_[first] != v:
                    first -= 1
                least = min(open_[first:])
                for x in open_[first:]:
                    group[x] = least
                del open_[first:]
    return np.array(group, "int64")


def _strong_kernel(t: pa.Table) -> pa.Table:
    names, src, dst = numbered(t["src"], t["dst"])
    group = _strong(len(names), src, dst)
    kept = np.flatnonzero(np.bincount(group, minlength=len(names))[group] > 1)
    return pa.table({"node": names.take(pa.array(kept)), "component": names.take(pa.array(group[kept]))})


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in a cycle of two or more nodes over (src, dst); a component is named by its smallest node.

    Colouring (Orzan, 2004): after trimming, each node gets the least node that
    reaches it; the nodes of a colour that reach its namesake backward are one
    component; the rest goes round again. What one task can hold (`TASK_EDGES`) is
    searched there instead. Nodes outside cycles aren't returned.
    """
    rest = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    found = None
    while True:
        if rest.count() > TASK_EDGES:
            rest = _trim(rest)
        if rest.isEmpty():
            break
        if rest.count() <= TASK_EDGES:
            component = materialize(rest.select("src", "dst", F.lit(0).alias("all")).groupBy("all").applyInArrow(_strong_kernel, "node string, component string"), "scc-found", collect=True)
            found = component if found is None else found.unionByName(component)
            break
        colours = _least_reaching(rest)
        of = lambda side: colours.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour"))
        inside = materialize(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour"), "scc-inside")
        roots = colours.where("node = colour").select(F.col("colour").alias("origin"), "node")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        component = reach(back, roots).select(F.col("node"), F.col("origin").alias("component")).unionByName(roots.select("node", F.col("origin").alias("component"))).distinct()
        component = materialize(component, "scc-found", collect=True)
        found = component if found is None else found.unionByName(component)
        gone = component.select("node")
        rest = materialize(inside.select("src", "dst").join(gone, F.col("src") == F.col("node"), "left_anti").join(gone.withColumnRenamed("node", "other"), F.col("dst") == F.col("other"), "left_anti"), "scc-edges")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    sizes = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


WORDS = 16


def ancestor_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, above): the sum of the sizes of all nodes that reach each node of an acyclic graph; nodes that nothing reaches are left out.

    Sets of ancestors are bits: nodes are dealt out to blocks of 64 * `WORDS` places,
    and a row holds what one block has for one node. A round ors the rows that have
    grown along the edges; pairs are never rows. Ends when no row grows. Of a graph that
    a task can hold (`TASK_EDGES`) each task gets all edges and its share of the blocks.
    """
    if edges.count() <= TASK_EDGES:
        return _ancestor_sizes_in_tasks(nodes, edges)
    n, room = nodes.count(), 64 * WORDS
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n // (room * 3 // 4)))))
    order = Window.partitionBy("bucket").orderBy("node")
    placed = nodes.select("node", "size", block.alias("bucket")).withColumn("k", F.row_number().over(order) - 1)
    placed = materialize(placed.select("node", "size", F.concat_ws(":", "bucket", (F.col("k") / room).cast("int")).alias("block"), F.pmod("k", F.lit(room)).alias("place")), "bits")
    names = [f"w{k}" for k in range(WORDS)]
    word = lambda k: F.when((F.col("place") / 64).cast("int") == k, F.expr("shiftleft(1L, cast(place % 64 as int))")).otherwise(F.lit(0).cast("long"))
    ored = [F.bit_or(c).alias(c) for c in names]
    count = sum((F.bit_count(c) for c in names), F.lit(0))
    step = materialize(edges.select("src", "dst").distinct(), "bit-edges")
    first = step.join(placed.select(F.col("node").alias("src"), "block", *[word(k).alias(c) for k, c in enumerate(names)]), "src").groupBy(F.col("dst").alias("node"), "block").agg(*ored)
    state = materialize(first.withColumn("n", count).withColumn("was", F.lit(0)), "bit-sets", collect=True)
    while True:
        grown = state.where("n > was").select(F.col("node").alias("src"), "block", *names)
        if grown.isEmpty():
            break
        sent = grown.join(step, "src").groupBy(F.col("dst").alias("node"), "block").agg(*ored).withColumn("n", F.lit(0))
        merged = state.select("node", "block", *names, "n").unionByName(sent.select("node", "block", *names, "n"))
        following = materialize(merged.groupBy("node", "block").agg(*ored, F.max("n").alias("was")).withColumn("n", count), "bit-sets", collect=True)
        discard(state)
        state = following
    large = placed.where("size <> 1").groupBy("block").agg(F.collect_list(F.struct("place", (F.col("size") - 1).alias("more"))).alias("large"))
    held = lambda x: F.getbit(F.element_at(F.array(*names), (x.place / 64).cast("int") + 1), F.pmod(x.place, F.lit(64)).cast("int")).cast("long")
    more = F.when(F.col("large").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate("large", F.lit(0).cast("long"), lambda s, x: s + held(x) * x.more))
    return state.join(large, "block", "left").groupBy("node").agg(F.sum(F.col("n") + more).alias("above"))


def _levels_kernel(t: pa.Table) -> pa.Table:
    """Nodes in the order of their levels, a row each, and before them one row with sizes, edges by their ends and where levels begin."""
    held = pc.is_null(t["dst"])
    nodes, edges = t.filter(held), t.filter(pc.invert(held))
    names, src, dst = pc.fill_null(nodes["src"], "").combine_chunks(), pc.index_in(edges["src"], nodes["src"].combine_chunks()).to_numpy(), pc.index_in(edges["dst"], nodes["src"].combine_chunks()).to_numpy()
    n = len(names)
    order = np.argsort(src, kind="stable")
    at, to = np.searchsorted(src[order], np.arange(n + 1)), dst[order]
    waits, level = np.bincount(dst, minlength=n), np.zeros(n, "int64")
    front, depth, seen = np.flatnonzero(waits == 0), 0, 0
    while len(front):
        level[front], seen = depth, seen + len(front)
        many = at[front + 1] - at[front]
        reached = to[np.repeat(at[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        np.subtract.at(waits, reached, 1)
        near = np.unique(reached)
        front, depth = near[waits[near] == 0], depth + 1
    if seen < n:
        raise ValueError("the graph has a cycle")
    by = np.argsort(level, kind="stable")
    place = np.empty(n, "int64")
    place[by] = np.arange(n)
    src, dst = place[src], place[dst]
    order = np.argsort(dst, kind="stable")
    size = nodes["size"].to_numpy()[by]
    begins = np.searchsorted(level[by], np.arange(depth + 1))
    packed = [a.astype("int64").tobytes() for a in (size, src[order], dst[order], begins)]
    row = pa.table([[-1], pa.array([None], pa.string()), *[[x] for x in packed]], names=["place", "node", "size", "src", "dst", "begins"])
    rest = pa.table({"place": np.arange(n), "node": names.take(pa.array(by))} | {c: pa.nulls(n, pa.binary()) for c in ("size", "src", "dst", "begins")})
    return pa.concat_tables([row, rest])


def _blocks_kernel(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(place, above) from the blocks of sources of each task; nodes before a block have none of it above them."""
    for batch in batches:
        for r in batch.to_pylist():
            size, src, dst, begins = (np.frombuffer(r[c], "int64") for c in ("size", "src", "dst", "begins"))
            n, room = len(size), 64 * WORDS
            above = np.zeros(n, "int64")
            cut = np.searchsorted(dst, begins)
            for first in range(r["part"] * room, n, r["parts"] * room):
                own = np.arange(first, min(first + room, n))
                bits = np.zeros((n - first, WORDS), "uint64")
                bits[own - first, (own - first) // 64] = np.uint64(1) << ((own - first) % 64).astype("uint64")
                for k in range(np.searchsorted(begins, first, side="right"), len(begins) - 1):
                    a, b = cut[k], cut[k + 1]
                    inside = np.flatnonzero(src[a:b] >= first) + a
                    if len(inside):
                        to = dst[inside]
                        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                        bits[to[heads] - first] |= np.bitwise_or.reduceat(bits[src[inside] - first], heads, axis=0)
                above[first:] += np.bitwise_count(bits).sum(axis=1, dtype="int64")
                for v in own[size[own] != 1]:
                    above[first:] += ((bits[:, (v - first) // 64] >> np.uint64((v - first) % 64)) & np.uint64(1)).astype("int64") * (size[v] - 1)
                above[own] -= size[own]
            found = np.flatnonzero(above)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(above[found])], names=["place", "above"])


def _ancestor_sizes_in_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    rows = nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("size").cast("long").alias("size")).unionByName(edges.select("src", "dst", F.lit(0).cast("long").alias("size")).distinct())
    levels = materialize(rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _levels_kernel(t), "place long, node string, size binary, src binary, dst binary, begins binary"), "levels", collect=True)
    parts = max(1, spark.sparkContext.defaultParallelism)
    graph = F.broadcast(levels.where("place = -1").drop("place", "node"))  # one row
    each = spark.range(0, parts, 1, parts).select(F.col("id").alias("part"), F.lit(parts).alias("parts")).join(graph, F.lit(True))
    counted = each.mapInArrow(lambda b: _blocks_kernel(b), "place long, above long").groupBy("place").agg(F.sum("above").alias("above"))
    return levels.where("place >= 0").select("place", "node").join(counted, "place").select("node", "above")


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) with dangling mass spread over all nodes; stops after the round whose total change is below the tolerance."""
    n = nodes.count()
    if not n:
        return nodes.select("node").withColumn("rank", F.lit(0.0))
    step = materialize(edges.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src").select("src", "dst", "out"), "rank-edges")
    ranks = materialize(nodes.select("node").join(step.select(F.col("src").alias("node"), "out").distinct(), "node", "left").select("node", "out", F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(most):
        dangling = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = step.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        base = (1 - damping) / n + damping * dangling / n
        following = materialize(ranks.join(given, "node", "left").select("node", "out", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"), F.col("rank").alias("before")), "ranks")
        change = following.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        discard(ranks)
        ranks = following.select("node", "out", "rank")
        if change < tolerance:
            break
    return ranks.select("node", "rank")
