"""Measures of elements, types and the whole system."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import FLAGS
from ..model import Graph
from ..plans.fixpoint import ancestor_sizes, numbered, page_rank, strong_components
from ..plans.storage import materialize

LANGUAGES = {"cs": "C#", "xaml": "XAML", "vb": "Visual Basic", "cpp": "C++", "h": "C++", "java": "Java", "dart": "Dart", "py": "Python", "js": "JavaScript", "ts": "TypeScript"}


def degrees(g: Graph) -> DataFrame:
    """id, incoming, outgoing of every element, over relationships of all types."""
    count = lambda side, name: g.relationships.groupBy(F.col(side).alias("id")).agg(F.count("*").alias(name))
    return g.elements.select("id").join(count("target_id", "incoming"), "id", "left").join(count("source_id", "outgoing"), "id", "left").fillna(0, ["incoming", "outgoing"])


def fans(g: Graph) -> DataFrame:
    """id, full_name, fan_in, fan_out of every type of the analyzed code."""
    count = lambda side, name: g.type_edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias(name))
    return g.types.select("id", "full_name").join(count("dst", "fan_in"), "id", "left").join(count("src", "fan_out"), "id", "left").fillna(0, ["fan_in", "fan_out"])


def summarize(g: Graph) -> DataFrame:
    return g.elements.groupBy("element_type").agg(F.count("*").alias("elements"))


def languages(g: Graph) -> DataFrame:
    files = g.elements.select(F.explode("source_locations").alias("l")).select(F.lower("l.file").alias("file")).where("file is not null").distinct()
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return files.select(F.coalesce(names[F.regexp_extract("file", r"\.([^./\\]+)$", 1)], F.lit("Other")).alias("language")).groupBy("language").agg(F.count("*").alias("files"))


def source_root(g: Graph) -> DataFrame:
    """The longest folder all files share: that of the least and the greatest name, as every other lies between."""
    folder = F.regexp_replace(F.lower(F.col("l.file")), r"[^/\\]*$", "")
    ends = g.elements.select(F.explode("source_locations").alias("l")).select(F.split(folder, r"[/\\]").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x == y)
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s.n + (s.on & F.coalesce(x, F.lit(False))).cast("int")).alias("n"), (s.on & F.coalesce(x, F.lit(False))).alias("on")))["n"]
    return ends.select(F.array_join(F.slice("a", 1, n), "/").alias("root"))


def event_imbalances(g: Graph) -> DataFrame:
    """Handlers that are registered and not unregistered, or the other way about."""
    both = FLAGS["EventRegistration"] | FLAGS["EventUnregistration"]
    return g.relationships.where((F.col("type") == "Handles") & (F.col("attributes").bitwiseAND(both) != both)).select("source_id", "target_id", "attributes")


def method_complexity(g: Graph) -> DataFrame:
    known = g.metrics.join(g.elements.select(F.col("id").alias("element_id"), "full_name"), "element_id")
    total = F.col("code_lines") + F.col("comment_lines")
    return known.select("element_id", "full_name", "cyclomatic_complexity", "code_lines", "comment_lines", F.when(total == 0, 0.0).otherwise(F.col("comment_lines") / total).alias("comment_ratio"))


def type_ranks(g: Graph, **options) -> DataFrame:
    """id, full_name, score (mean 1) and position of every type by PageRank."""
    types = g.types.select("id", "full_name")
    ranks = page_rank(types.select(F.col("id").alias("node")), g.type_edges, **options)
    scored = types.join(ranks, types["id"] == ranks["node"]).select("id", "full_name", (F.col("rank") * types.count()).alias("score"))
    return scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "full_name")).cast("long"))


def components(g: Graph) -> DataFrame:
    """node, component of every type that is in a cycle of types."""
    if "scc" not in g._kept:
        g._kept["scc"] = materialize(strong_components(g.type_edges), "type-cycles")
    return g._kept["scc"]


def condensed(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(node, component, size) of all types, a type in no cycle being its own component; and the edges between components."""
    types = g.type_ids.select(F.col("id").alias("node"))
    named = types.join(components(g), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    at = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    edges = g.type_edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()
    return materialize(named.join(sizes, "component"), "condensed"), materialize(edges, "condensed-edges")


def blast_radius(g: Graph) -> DataFrame:
    """id and how many other types reach it. Cycles are condensed first: their members share what reaches them."""
    if "blast" in g._kept:
        return g._kept["blast"]
    named, edges = condensed(g)
    above = ancestor_sizes(named.select(F.col("component").alias("node"), "size").distinct(), edges).select(F.col("node").alias("component"), "above")
    counted = named.join(above, "component", "left").select(F.col("node").alias("id"), (F.coalesce("above", F.lit(0)) + F.col("size") - 1).alias("blast_radius"))
    g._kept["blast"] = materialize(counted, "blast-radius")
    return g._kept["blast"]


def _greedy_order(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """Vertices 0 to n - 1 ordered by the greedy method of Eades, Lin and Smyth (1993): sinks last, sources first, else the largest surplus of outgoing edges; ties to the smaller number.

    `src` and `dst` hold distinct edges. Degrees are counted down as vertices go, and a
    heap holds surpluses, so that the work is that of sorting the edges.
    """

    def listed(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        return np.searchsorted(a, np.arange(n + 1), sorter=(order := np.argsort(a, kind="stable"))).tolist(), b[order].tolist()

    (out_at, out_of), (in_at, into) = listed(src, dst), listed(dst, src)
    n_out, n_in = np.bincount(src, minlength=n).tolist(), np.bincount(dst, minlength=n).tolist()
    here, left, right = [True] * n, [], []
    heap = [(n_in[v] - n_out[v], v) for v in range(n)]
    heapq.heapify(heap)

    def take(v: int) -> list[int]:
        """Its neighbours that are left, in order."""
        here[v] = False
        near = set()
        for x in out_of[out_at[v] : out_at[v + 1]]:
            if here[x]:
                n_in[x] -= 1
                near.add(x)
        for x in into[in_at[v] : in_at[v + 1]]:
            if here[x]:
                n_out[x] -= 1
                near.add(x)
        for x in near:
            if n_out[x] and n_in[x]:
                heapq.heappush(heap, (n_in[x] - n_out[x], x))
        return sorted(near)

    ready = deque(v for v in range(n) if not n_out[v] or not n_in[v])
    while True:
        while ready:
            v = ready.popleft()
            if here[v] and not (n_out[v] and n_in[v]):
                (left if n_out[v] else right).append(v)
                ready += take(v)
        while heap and not (here[heap[0][1]] and n_in[heap[0][1]] - n_out[heap[0][1]] == heap[0][0]):
            heapq.heappop(heap)
        if not heap:
            return left + right[::-1]
        left.append(v := heap[0][1])
        ready += [x for x in take(v) if not n_out[x] or not n_in[x]]


def feedback_order(edges: pd.DataFrame) -> list[str]:
    names, src, dst = numbered(*(pa.chunked_array([pa.array(edges[c], pa.string())]) for c in ("src", "dst")))
    src, dst = np.unique(np.stack([src, dst]), axis=1)
    return names.take(pa.array(_greedy_order(len(names), src, dst), pa.int64())).to_pylist()


def feedback_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst) edges that point backward in the order of their cycle. Edges between cycles are never among them, so each cycle is one group."""

    def kernel(t: pa.Table) -> pa.Table:
        names, src, dst = numbered(t["src"], t["dst"])
        place = np.empty(len(names), "int64")
        place[_greedy_order(len(names), src, dst)] = np.arange(len(names))
        return t.select(["src", "dst"]).filter(pa.array(place[src] > place[dst]))

    at = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    inside = edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("component"))
    return inside.groupBy("component").applyInArrow(kernel, "src string, dst string")


def propagation(g: Graph) -> DataFrame:
    """One row: types, dependencies, propagation cost and cyclicity; all 0 below two types."""
    n, e = g.type_ids.count(), g.type_edges.count()
    reached = blast_radius(g).agg(F.coalesce(F.sum("blast_radius"), F.lit(0)).alias("r"))
    row = reached.join(components(g).agg(F.count("*").alias("c")), F.lit(True))  # two tables of one row
    cost, share = (F.col("r") / F.lit(float(n) * (n - 1)), F.col("c") / F.lit(float(n))) if n >= 2 else (F.lit(0.0), F.lit(0.0))
    return row.select(F.lit(n).cast("long").alias("types"), F.lit(e).cast("long").alias("dependencies"), cost.alias("propagation_cost"), share.alias("cyclicity"))


def system_metrics(g: Graph) -> DataFrame:
    """One row: types, dependencies, propagation cost, cyclicity and feedback density; all 0 below two types."""
    n, e = g.type_ids.count(), g.type_edges.count()
    reached = blast_radius(g).agg(F.coalesce(F.sum("blast_radius"), F.lit(0)).alias("r"))
    cyclic = components(g).agg(F.count("*").alias("c"))
    back = feedback_edges(g.type_edges, components(g)).agg(F.count("*").alias("f"))
    row = reached.join(cyclic, F.lit(True)).join(back, F.lit(True))  # three tables of one row
    if n < 2:
        return row.select(F.lit(n).cast("long").alias("types"), F.lit(e).cast("long").alias("dependencies"), *[F.lit(0.0).alias(c) for c in ("propagation_cost", "cyclicity", "feedback_density")])
    return row.select(F.lit(n).cast("long").alias("types"), F.lit(e).cast("long").alias("dependencies"), (F.col("r") / F.lit(float(n) * (n - 1))).alias("propagation_cost"), (F.col("c") / F.lit(float(n))).alias("cyclicity"), (F.col("f") / F.lit(float(max(e, 1)))).alias("feedback_density"))


def tangledness(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Description length of the blocks of a modular matrix over that of the plain one: one row, `tangledness`.

    `modules` holds (node, module), `edges` distinct (src, dst). No edge gives 0, all edges 1.
    Pairs of modules without edges have length 0, so only blocks that hold edges are looked at.
    """
    entropy = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    sizes = modules.groupBy("module").agg(F.count("*").alias("n"))
    at = lambda side: modules.select(F.col("node").alias(side), F.col("module").alias(f"m_{side}"))
    size = lambda side: sizes.select(F.col("module").alias(f"m_{side}"), F.col("n").alias(f"n_{side}"))
    blocks = edges.join(at("src"), "src").join(at("dst"), "dst").groupBy("m_src", "m_dst").agg(F.count("*").alias("filled")).join(size("src"), "m_src").join(size("dst"), "m_dst")
    slots = F.when(F.col("m_src") == F.col("m_dst"), F.col("n_src") * (F.col("n_src") - 1)).otherwise(F.col("n_src") * F.col("n_dst")).cast("double")
    cost = blocks.agg(F.coalesce(F.sum(slots * entropy(F.col("filled") / slots)), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("filled"), F.lit(0)).alias("edges"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    all_slots = F.col("n") * (F.col("n") - 1)
    whole = all_slots * entropy(F.col("edges") / F.greatest(all_slots, F.lit(1.0)))
    return cost.join(total, F.lit(True)).select(F.when(F.col("edges") == 0, 0.0).when(F.col("edges") == all_slots, 1.0).otherwise(F.col("cost") / whole).alias("tangledness"))
