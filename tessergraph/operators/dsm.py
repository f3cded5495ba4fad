"""Dependency structure matrix: weights between all levels of the hierarchy, cycles of siblings and their order."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph


def weights(g: Graph) -> DataFrame:
    """(consumer, provider, weight): each type dependency counted for every pair of an element of the one path and one of the other that share no ancestor line.

    Common ancestors are exactly what both paths share, so the differences of the paths are the pairs.
    """
    p = lambda side: g.paths.select(F.col("id").alias(side), F.col("path").alias(f"{side}_path"))
    e = g.type_edges.join(p("src"), "src").join(p("dst"), "dst")
    one = e.select(F.explode(F.array_except("src_path", "dst_path")).alias("consumer"), F.array_except("dst_path", "src_path").alias("providers"))
    return one.select("consumer", F.explode("providers").alias("provider")).groupBy("consumer", "provider").agg(F.count("*").alias("weight"))


def sibling_cycles(g: Graph) -> DataFrame:
    """(a, b, kind): pairs of siblings that depend on each other, `System` directly and else `Hierarchical`."""
    w = weights(g)
    parent = lambda c: g.elements.select(F.col("id").alias(c), F.coalesce("parent_id", F.lit("")).alias(f"{c}_parent"))
    near = w.join(parent("consumer"), "consumer").join(parent("provider"), "provider").where("consumer_parent = provider_parent").select("consumer", "provider")
    direct = g.type_edges.withColumn("direct", F.lit(True))
    both = near.select(F.col("consumer").alias("a"), F.col("provider").alias("b")).where("a < b").join(near.select(F.col("provider").alias("a"), F.col("consumer").alias("b")), ["a", "b"])
    forth = direct.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("direct").alias("d1"))
    back = direct.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("direct").alias("d2"))
    return both.join(forth, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", F.when(F.col("d1") & F.col("d2"), "System").otherwise("Hierarchical").alias("kind"))


def relations_of(g: Graph, ids: DataFrame) -> DataFrame:
    """root and its subtree's ingoing, outgoing and internal type dependencies."""
    sub = g.subtree(ids)
    s = g.type_edges.join(sub.select(F.col("id").alias("src"), F.col("root").alias("r")), "src").withColumn("out", F.lit(1)).select("src", "dst", "r", "out")
    t = g.type_edges.join(sub.select(F.col("id").alias("dst"), F.col("root").alias("r")), "dst").withColumn("into", F.lit(1)).select("src", "dst", "r", "into")
    both = s.join(t, ["src", "dst", "r"], "full")
    is_ = lambda a, b: F.sum(F.when(a & b, 1).otherwise(0))
    o, i = F.col("out").isNotNull(), F.col("into").isNotNull()
    found = both.groupBy(F.col("r").alias("root")).agg(is_(i, ~o).alias("ingoing"), is_(o, ~i).alias("outgoing"), is_(o, i).alias("internal"))
    return ids.select(F.col("id").alias("root")).distinct().join(found, "root", "left").fillna(0, ["ingoing", "outgoing", "internal"])


def partition_order(nodes: list[str], edges: set[tuple[str, str]]) -> list[str]:
    """Consumers first: strongly connected members stay together in their order, groups by Kahn's method with the earliest member first."""
    after: dict[str, list[str]] = {v: [] for v in nodes}
    for a, b in sorted(edges):
        after[a].append(b)
    place, low, on, stack, group, count = {}, {}, set(), [], {}, 0
    for root in nodes:
        if root in place:
            continue
        work = [(root, iter(after[root]))]
        place[root] = low[root] = len(place)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            following = next(rest, None)
            if following is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == place[v]:
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group[x] = count
                        if x == v:
                            break
                    count += 1
            elif following not in place:
                place[following] = low[following] = len(place)
                stack.append(following)
                on.add(following)
                work.append((following, iter(after[following])))
            elif following in on:
                low[v] = min(low[v], place[following])
    members: dict[int, list[str]] = {}
    for v in nodes:
        members.setdefault(group[v], []).append(v)
    links: dict[int, list[int]] = {k: [] for k in members}
    waiting = dict.fromkeys(members, 0)
    for a, b in sorted({(group[a], group[b]) for a, b in edges if group[a] != group[b]}):
        links[a].append(b)
        waiting[b] += 1
    index = {v: k for k, v in enumerate(nodes)}
    heap = [(index[m[0]], k) for k, m in members.items() if not waiting[k]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, k = heapq.heappop(heap)
        out += members[k]
        for b in links[k]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(heap, (index[members[b][0]], b))
    return out


def sibling_order(g: Graph) -> DataFrame:
    """(parent, id, position): children of each element in partition order. The children of one element are one group, a hierarchy's fan-out."""
    near = weights(g).join(g.elements.select(F.col("id").alias("consumer"), F.coalesce("parent_id", F.lit("")).alias("parent")), "consumer").join(g.elements.select(F.col("id").alias("provider"), F.coalesce("parent_id", F.lit("")).alias("q")), "provider").where("parent = q").select("parent", F.col("consumer").alias("id"), F.col("provider").alias("to"))
    rows = g.elements.where("element_type <> 'Method' and not is_external").select(F.coalesce("parent_id", F.lit("")).alias("parent"), "id", F.lit(None).cast("string").alias("to")).unionByName(near)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        known = set(pdf["id"])
        nodes = sorted(known)
        edges = {(a, b) for a, b in zip(pdf["id"], pdf["to"], strict=True) if b is not None and b in known}
        order = partition_order(nodes, edges)
        return pd.DataFrame({"parent": pdf["parent"].iloc[0], "id": order, "position": range(len(order))})

    return rows.groupBy("parent").applyInPandas(kernel, "parent string, id string, position long")
