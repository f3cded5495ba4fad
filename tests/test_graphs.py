import json
import random
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessergraph import catalog
from tessergraph.fixtures import code_graph
from tessergraph.functions.predicates import flag_names
from tessergraph.functions.search import camel_hump, compile_search
from tessergraph.model import ELEMENTS, RELATIONSHIPS, Graph
from tessergraph.operators import cohesion, cycles, deadcode, dsm, edits, explore, metrics, rules
from tessergraph.operators import history as mining
from tessergraph.plans import fixpoint
from tessergraph.plans.fixpoint import reach, strong_components
from tessergraph.sinks import graphs as sinks
from tessergraph.sinks import reports
from tessergraph.sources import graphs as sources
from tessergraph.sources import histories


def graph(spark, elements, relationships=(), metrics_=None):
    """elements: (id, type, parent[, {options}]); relationships: (source, type, target[, flags])."""
    names, rows = {}, []
    for ident, kind, parent, *more in elements:
        o = more[0] if more else {}
        name = o.get("name", ident)
        names[ident] = f"{names[parent]}.{name}" if parent else name
        rows.append((ident, kind, name, names[ident], parent, o.get("access", "Unknown"), o.get("external", False), False, o.get("attributes", []), []))
    edges = [(r[0], r[2], r[1], r[3] if len(r) > 3 else 0, []) for r in relationships]
    m = spark.createDataFrame(metrics_, "element_id string, code_lines int, comment_lines int, logical_lines_of_code int, cyclomatic_complexity int") if metrics_ else None
    return Graph(spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(edges, RELATIONSHIPS), m)


def types(spark, edges, names="ABCDEF"):
    used = sorted({x for e in edges for x in e} | set(names))
    return graph(spark, [("T", "Assembly", None), *[(n, "Class", "T") for n in used]], [(a, "Uses", b) for a, b in edges])


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def flat(df, *columns):
    return sorted(tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect())


def test_known_system_metrics(spark):
    chain = metrics.system_metrics(types(spark, [("A", "B"), ("B", "C")], "ABC")).first()
    assert (chain["propagation_cost"], chain["cyclicity"], chain["feedback_density"]) == (0.5, 0.0, 0.0)
    ring = metrics.system_metrics(types(spark, [("A", "B"), ("B", "C"), ("C", "A")], "ABC")).first()
    assert ring["cyclicity"] == 1.0 and ring["feedback_density"] == pytest.approx(1 / 3)
    half = metrics.system_metrics(types(spark, [("A", "B"), ("B", "A")], "ABCD")).first()
    assert half["cyclicity"] == 0.5 and half["feedback_density"] == 0.5
    assert metrics.system_metrics(types(spark, [], "A")).first()["propagation_cost"] == 0.0


def test_feedback_edge_of_a_ring_with_a_chord(spark):
    g = types(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("A", "C")], "ABC")
    assert flat(metrics.feedback_edges(g.type_edges, metrics.components(g)), "src", "dst") == [("C", "A")]
    every = pd.DataFrame([(a, b) for a in "ABCD" for b in "ABCD" if a != b], columns=["src", "dst"])
    place = {v: k for k, v in enumerate(metrics.feedback_order(every))}
    assert sum(place[a] > place[b] for a, b in every.itertuples(index=False)) == 6


def test_tangledness_limits(spark):
    g = types(spark, [("A", "B"), ("B", "C"), ("D", "C")], "ABCD")
    nodes = g.types.select(F.col("id").alias("node"))
    assert metrics.tangledness(g.type_edges, nodes.withColumn("module", F.lit("m"))).first()[0] == pytest.approx(1.0)
    assert metrics.tangledness(g.type_edges, nodes.withColumn("module", F.col("node"))).first()[0] == pytest.approx(0.0)


def test_ranks(spark):
    g = types(spark, [("A", "H"), ("B", "H"), ("C", "H")], "ABCH")
    rows = {r["id"]: r for r in metrics.type_ranks(g).collect()}
    assert rows["H"]["position"] == 1 and rows["H"]["score"] > 1 and sum(r["score"] for r in rows.values()) == pytest.approx(4, abs=1e-6)
    assert {r["id"]: (r["fan_in"], r["fan_out"]) for r in metrics.fans(g).collect()}["H"] == (3, 0)


def test_callers_are_followed_however_far(spark):
    n = 70
    g = graph(spark, [("T", "Assembly", None), *[x for k in range(n) for x in ((f"C{k}", "Class", "T"), (f"M{k}", "Method", f"C{k}"))]], [(f"M{k + 1}", "Calls", f"M{k}", 8) for k in range(n - 1)])
    assert {r["id"] for r in explore.follow_callers(g, ids(spark, "M0")).collect()} == {f"M{k}" for k in range(n)}
    assert {r["id"] for r in explore.follow_callers(g, ids(spark, "M66")).collect()} == {f"M{k}" for k in range(66, n)}


def test_registered_ranks_run_until_they_converge(spark):
    folder = "/root/testdata/sf0.001"
    rows = catalog.queries()["type_ranks"](spark, folder).collect()
    g = code_graph(spark, folder)
    place = {r["id"]: k for k, r in enumerate(g.types.select("id").collect())}
    n, after = len(place), defaultdict(list)
    for a, b in flat(g.type_edges, "src", "dst"):
        after[a].append(b)
    ranks, rounds, change = [1 / n] * n, 0, 1.0
    while rounds < 100 and change >= 1e-6:
        lost = sum(ranks[k] for i, k in place.items() if not after[i])
        following = [0.15 / n + 0.85 * lost / n] * n
        for a, targets in after.items():
            for b in targets:
                following[place[b]] += 0.85 * ranks[place[a]] / len(targets)
        change, ranks, rounds = sum(abs(x - y) for x, y in zip(ranks, following, strict=True)), following, rounds + 1
    assert 20 < rounds < 100
    assert {r["id"]: r["score"] for r in rows} == {i: pytest.approx(ranks[k] * n, abs=1e-9) for i, k in place.items()}
    ordered = sorted(rows, key=lambda r: (-round(r["score"], 9), r["full_name"]))
    assert [r["position"] for r in ordered] == list(range(1, n + 1))


def test_ancestor_sizes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "WORDS", 1)
    rng = random.Random(3)
    n = 200
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(260)}
    size = {k: rng.choice((1, 1, 1, 5)) for k in range(n)}
    above = [set() for _ in range(n)]
    for b in range(n):  # edges go upward
        for a in (a for a, c in edges if c == b):
            above[b] |= above[a] | {a}
    name = lambda k: f"n{k:03}"
    got = fixpoint.ancestor_sizes(spark.createDataFrame([(name(k), v) for k, v in size.items()], "node string, size long"), spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string"))
    assert {r["node"]: r["above"] for r in got.collect()} == {name(k): sum(size[x] for x in v) for k, v in enumerate(above) if v}


def test_hubs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "HUB_ROWS", 20)
    monkeypatch.setattr(fixpoint, "HUB_SHARE", 50)
    edges = [(0, k) for k in range(1, 200)] + [(500, k) for k in range(501, 560)] + [(600, 601), (199, 700)]
    got = {r["node"]: r["component"] for r in fixpoint.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in (*range(200), 700)}, **{k: 500 for k in range(500, 560)}, 600: 600, 601: 600}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_reach_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(85)}
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)

    def down(a):
        seen, todo = set(), [a]
        while todo:
            for x in after[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    nodes = {x for e in edges for x in e}
    far = {n: down(n) for n in nodes}
    expected = {n: min(m for m in nodes if m == n or m in far[n] and n in far[m]) for n in nodes if any(m != n and m in far[n] and n in far[m] for m in nodes)}
    df = spark.createDataFrame([*edges], "src string, dst string")
    assert dict(flat(strong_components(df), "node", "component")) == expected
    starts = spark.createDataFrame([(n, n) for n in nodes], "origin string, node string")
    assert flat(reach(df, starts), "origin", "node") == sorted((n, m) for n in nodes for m in far[n])


def test_search_language(spark):
    df = spark.createDataFrame([("a.FooBar", "Class", False, False), ("a.foobaz", "Method", True, False), (None, "Class", False, False)], "full_name string, element_type string, is_external boolean, is_generated boolean")
    find = lambda text: flat(df.where(compile_search(text)), "full_name")
    assert find("FoB") == ["a.FooBar"] and find("foo -bar") == ["a.foobaz"] and find("foo | nothing") == ["a.FooBar", "a.foobaz"]
    assert find("") == [] and find("-type:class") == ["a.foobaz"] and find("source:extern") == ["a.foobaz"] and find("type:what") == []
    assert camel_hump("FoB") == "Fo[a-z0-9]*B"


def test_paths_explore_and_lifting(spark):
    g = graph(spark, [("T", "Assembly", None), ("N", "Namespace", "T"), ("C", "Class", "N"), ("I", "Class", "C"), ("m", "Method", "I"), ("D", "Class", "N"), ("d", "Method", "D"), ("X", "Class", None, {"external": True})], [("m", "Calls", "d"), ("d", "Uses", "X"), ("d", "Handles", "m")])
    row = g.paths.where("id = 'm'").first()
    assert row["path"] == ["T", "N", "C", "I", "m"] and (row["containing_type"], row["assembly_id"], row["lift20"], row["lift30"]) == ("I", "T", "I", "N")
    assert flat(g.type_edges, "src", "dst") == [("I", "D")]
    assert flat(explore.hierarchy_gaps(g, ids(spark, "T", "m")), "id") == ["C", "I", "N"]
    assert flat(explore.missing_types(g, ids(spark, "m")), "id") == ["I"]
    assert flat(explore.outgoing_deep(g, ids(spark, "C")), "target_id") == ["d"]
    assert flat(explore.paths_between(g, ids(spark, "C", "D")), "a", "b", "source_id", "target_id", "depth") == [("C", "D", "m", "d", 1)]
    assert flat(cycles.search_edges(g), "src", "dst") == [("C", "D")]
    assert flat(explore.bundled_edges(g, ids(spark, "C", "D")), "source_id", "target_id", "edges", "type") == [("C", "D", 1, "Calls"), ("D", "C", 1, "Handles")]


def test_all_shortest_paths(spark):
    g = types(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("A", "E"), ("E", "F"), ("F", "D")])
    assert flat(explore.paths_between(g, ids(spark, "A", "D")), "source_id", "target_id", "depth") == [("A", "B", 1), ("A", "C", 1), ("B", "D", 2), ("C", "D", 2)]
    assert explore.paths_between(g, ids(spark, "A", "D"), 1).isEmpty()


def test_cycle_groups_by_level(spark):
    g = graph(spark, [("T", "Assembly", None), ("N", "Namespace", "T"), ("M", "Namespace", "T"), ("A", "Class", "N"), ("B", "Class", "M"), ("a", "Method", "A"), ("b", "Method", "B")], [("a", "Calls", "b"), ("b", "Calls", "a")])
    assert flat(cycles.cycle_groups(g), "component", "id") == [("M", "M"), ("M", "N")]
    assert flat(cycles.cycle_edges(g), "source_id", "target_id") == [("a", "b"), ("b", "a")]
    assert cycles.cycle_summary(g).first()["level"] == "Namespace"


def test_raised_edges_at_all_depths_in_one_plan_of_bounded_size(spark):
    """Ends at unequal depths are raised to equal levels; the shared part of two paths is computed once, wherever it is named."""
    rows = [("T", "Assembly", None), ("N", "Namespace", "T"), ("C", "Class", "N"), ("I", "Class", "C"), ("m", "Method", "I"), ("o", "Method", "C"), ("U", "Assembly", None), ("D", "Class", "U"), ("d", "Method", "D")]
    g = graph(spark, rows, [("m", "Calls", "o"), ("m", "Calls", "d"), ("d", "Calls", "d"), ("o", "Uses", "C"), ("d", "Uses", "N")])
    found = cycles.search_edges(g)
    assert flat(found, "src", "dst", "source_id", "target_id") == [("I", "C", "m", "o"), ("T", "U", "m", "d"), ("U", "T", "d", "N"), ("d", "d", "d", "d")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1


def test_forbidden_sources_without_stored_pairs(spark, monkeypatch):
    """Tasks that hold the hierarchy give the same pairs as joins, also with two bases and where classes inherit in a circle, and store none."""
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("e", "x"), ("f", "x"), ("g", "h"), ("h", "i"), ("i", "g"), ("j", "i"), ("k", "h"), ("p", "s"), ("q", "s")]
    g = graph(spark, [*((n, "Class", None) for n in "abcdefghijkpqx"), ("s", "Interface", None)], [(a, "Inherits", b) for a, b in edges])
    every = g.elements.select("id")
    monkeypatch.setattr(explore, "TASK_EDGES", 0)
    joined = flat(explore.forbidden_call_sources(g, every), "container", "id")
    monkeypatch.undo()
    monkeypatch.setattr(explore, "reach", lambda *_: pytest.fail("pairs are stored"))
    assert flat(explore.forbidden_call_sources(g, every), "container", "id") == joined and ("b", "c") in joined and ("p", "q") in joined and ("j", "k") in joined
    assert flat(explore.forbidden_call_sources(g, ids(spark, "d")), "container", "id") == [p for p in joined if p[0] == "d"]


def test_forbidden_sources_by_whole_hierarchies(spark, tmp_path, monkeypatch):
    """Only the table that inheritance is in is read, and no graph is stored; a task has few hierarchies; what inherits from null has no siblings by it."""
    stored = code_graph(spark, "/root/testdata/sf0.001")
    edges = stored.relationships.where("type = 'Inherits'").selectExpr("source_id as src", "target_id as dst")
    joined = explore.forbidden_call_sources(Graph(stored.elements, stored.relationships), stored.elements.where("element_type = 'Class'").select("id"))
    (tmp_path / "sf").mkdir()
    for name in ("part", "lineitem"):
        (tmp_path / "sf" / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    monkeypatch.setattr("tessergraph.fixtures.materialize", lambda *_, **__: pytest.fail("a graph is stored"))
    found = catalog.queries()["forbidden_call_sources"](spark, str(tmp_path / "sf"))
    assert flat(found, "container", "id") == flat(joined, "container", "id")
    g = code_graph(spark, str(tmp_path / "sf"))
    assert not {f.rsplit("/", 1)[1] for f in g.inherits.inputFiles()} - {"part.parquet"} and flat(g.inherits, "src", "dst") == flat(edges, "src", "dst")

    names = [f"{k:03}" for k in range(200)]  # even and odd ones are two hierarchies
    g = graph(spark, [(x, "Class", None) for x in names], [*((x, "Inherits", names[(k - 2) // 4 * 2 + k % 2]) for k, x in enumerate(names) if k > 1), ("000", "Inherits", None), ("001", "Inherits", None)])
    found = explore.forbidden_call_sources(g, g.elements.select("id"))
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct(F.col("container").cast("int") % 2).alias("n")).collect()
    assert len(tasks) > 2 and sum(r["n"] > 1 for r in tasks) < 2
    assert not {(int(a) + int(b)) % 2 for a, b in flat(found, "container", "id")} - {0}


def test_plain_text_joins_only_likely_relationships(spark):
    """Lines of elements aren't joined with what is defined above; an element line whose second word names a kind of relationship is read as before."""
    lines = ["Class C", "Class Uses x", "loc=a.cs:1,2", "C Uses Uses", "Class Calls C"]
    g = sources.parse_plain_text(spark.createDataFrame([*enumerate(lines)], "line_no long, line string"))
    assert flat(g.elements, "id", "element_type") == [("C", "Class"), ("Calls", "Class"), ("Uses", "Class")]
    assert flat(g.relationships, "source_id", "type", "target_id") == [("C", "Uses", "Uses")]
    plan = g.elements._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.split("\n") if "Filter" in line and "Uses" in line]
    assert len(kept) > 1, "every line is joined"


def test_propagation_orders_no_feedback(spark, monkeypatch):
    g = types(spark, [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D")])
    whole = metrics.system_metrics(g).drop("feedback_density").first()
    monkeypatch.setattr(metrics, "feedback_edges", lambda *_: pytest.fail("feedback edges are not asked for"))
    assert metrics.propagation(g).first() == whole
    assert tuple(metrics.propagation(types(spark, [], "A")).first()) == (1, 0, 0.0, 0.0)


def test_system_metrics_without_stored_elements(spark, tmp_path):
    """The measures need no names of methods, so the registered graph isn't stored whole for them; keys that are null or of no part change nothing."""
    line, part = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "part"))
    key = F.when(F.expr("l_orderkey % 7 = 0 and l_linenumber % 2 = 0"), None).when(F.expr("l_orderkey % 11 = 0"), F.col("l_partkey") + 100_000).otherwise(F.col("l_partkey"))
    line = line.withColumns({"l_partkey": key, "l_suppkey": F.when(F.expr("l_orderkey % 5 = 0"), None).otherwise(F.col("l_suppkey"))})
    swapped = line.where("l_orderkey % 3 = 0").withColumns({"l_suppkey": F.col("l_partkey"), "l_partkey": F.lit(None).cast("long"), "l_quantity": F.lit(45.0)})
    line.unionByName(swapped).write.parquet(f"{tmp_path}/lineitem.parquet")
    part.unionByName(part.where("p_partkey in (3, 4)")).write.parquet(f"{tmp_path}/part.parquet")
    g = code_graph(spark, str(tmp_path))
    got = metrics.system_metrics(g).first()
    assert "elements" not in vars(g), "all elements are stored"
    plain = Graph(g.elements, g.relationships)
    assert got == metrics.system_metrics(plain).first() and got["dependencies"] > 0
    assert flat(g.type_edges, "src", "dst") == flat(plain.type_edges, "src", "dst")
    assert flat(g.ends, "id", "element_type", "is_external", "parent_id") == flat(plain.ends, "id", "element_type", "is_external", "parent_id")
    assert any(i.count(":") == 1 and i.startswith("M:") for i in flat(g.ends, "id"))


def test_type_edges_of_nested_types_and_of_parents_in_a_circle(spark):
    parts = [("T", "Assembly", None), ("A", "Class", "T"), ("I", "Class", "A"), ("i", "Method", "I"), ("a", "Method", "A"), ("l", "Method", "a"), ("B", "Class", "T"), ("b", "Method", "B"), ("f", "Method", "T"), ("X", "Class", "T", {"external": True}), ("x", "Method", "X")]
    uses = [("i", "a"), ("l", "b"), ("b", "i"), ("f", "b"), ("b", "f"), ("b", "x"), ("x", "b"), ("a", "a"), ("p", "b"), ("q", "b"), ("b", "p"), ("B", "I"), ("o", "b"), ("s", "b")]
    g = graph(spark, parts, [(s, "Uses", t) for s, t in uses])
    circle = [("P", "Class", "p", "Q"), ("Q", "Class", "q", "P"), ("O", "Class", "o", "none"), ("S", "Class", "s", "S")]
    rows = [r for e, kind, m, parent in circle for r in ((e, kind, e, e, parent, "Public", False, False, [], []), (m, "Method", m, m, e, "Public", False, False, [], []))]
    g = Graph(g.elements.unionByName(spark.createDataFrame(rows, ELEMENTS)), g.relationships)
    assert flat(g.type_edges, "src", "dst") == [("A", "B"), ("B", "I"), ("I", "A"), ("O", "B")]
    lifted = g._lifted("containing_type", g.types.select("id"))
    assert flat(g.type_edges, "src", "dst") == flat(lifted, "src", "dst")


def test_cohesion_of_two_groups(spark):
    g = graph(spark, [("T", "Assembly", None), ("C", "Class", "T"), *[(m, "Method", "C") for m in "abcd"], ("k", "Method", "C", {"name": ".ctor"})], [("a", "Calls", "b"), ("c", "Calls", "d"), ("k", "Calls", "a"), ("k", "Calls", "c")])
    r = cohesion.type_cohesion(g).first()
    assert (r["methods"], r["partitions"], r["share"]) == (4, 2, 0.5)
    inherited = graph(spark, [("T", "Assembly", None), ("B", "Class", "T"), ("f", "Field", "B"), ("C", "Class", "T"), ("a", "Method", "C"), ("b", "Method", "C")], [("C", "Inherits", "B"), ("a", "Uses", "f"), ("b", "Uses", "f")])
    assert len({p for _, p, _ in flat(cohesion.partitions(inherited, ids(spark, "C")), "type_id", "partition", "id")}) == 2
    assert flat(cohesion.partitions(inherited, ids(spark, "C"), bases=True), "partition", "id") == [("a", "a"), ("a", "b")]


def test_unused_elements(spark):
    g = graph(
        spark,
        [("T", "Assembly", None), ("A", "Class", "T", {"access": "Internal"}), ("main", "Method", "A", {"name": "Main"}), ("B", "Class", "T"), ("used", "Method", "B"), ("idle", "Method", "B", {"access": "Private"}), ("I", "Interface", "T"), ("im", "Method", "I"), ("K", "Class", "T"), ("km", "Method", "K"), ("Q", "Class", "T"), ("q", "Method", "Q", {"attributes": ["Test"]}), ("only", "Method", "B")],
        [("main", "Calls", "used"), ("main", "Calls", "im"), ("km", "Implements", "im"), ("K", "Implements", "I"), ("q", "Calls", "only")],
    )
    rows = {r["id"]: (r["hints"], r["confidence"]) for r in deadcode.dead_code(g).collect()}
    assert rows == {"A": (1, "Low"), "idle": (0, "High"), "only": (64, "Medium")}


def test_rules(spark):
    g = graph(spark, [("A", "Assembly", None), ("N", "Namespace", "A"), ("C", "Class", "N"), ("B", "Assembly", None), ("D", "Class", "B"), ("E", "Class", "B")], [("C", "Uses", "D"), ("C", "Uses", "E"), ("D", "Uses", "C")], [("C", 10, 1, 5, 3)])
    run = lambda text: flat(rules.evaluate(g, rules.parse(text)).violations, "source_id", "target_id")
    assert run("DENY: A.** -> B.**") == [("C", "D"), ("C", "E")]
    assert run("deny A.** -> B.**\nALLOW A.N.C -> B.D // an exception") == [("C", "E")]
    assert run("ISOLATE B.**") == [("D", "C")]
    assert run("RESTRICT A.** -> B.D") == [("C", "E")] and run("RESTRICT A.** -> B.D\nRESTRICT A.N.** -> B.E") == []
    assert run("DENY A.* -> B.*") == [] and run("DENY A.global.N.C -> B.D") == [("C", "D")] and rules.evaluate(g, rules.parse("DENY x -> B.D")).warnings == ["nothing matches x"]
    assert rules.evaluate(g, rules.parse("MAXCYCLICITY = 10")).system[0][1] == pytest.approx(200 / 3)
    assert [rules.gate(g, t) for t in ("DENY B.E -> A", "DENY A.** -> B.**", "nonsense")] == [0, 1, 2]
    assert rules.baseline(g, rules.parse("DENY A.** -> B.D")) == "// DENY A.** -> B.D\nALLOW A.N.C -> B.D"
    assert rules.generate(g) == "RESTRICT A.** -> B.**\nRESTRICT B.** -> A.**"
    assert rules.remove_unused(g, "// note\nDENY x -> B\nRESTRICT A -> y\nwhat") == "// note\nRESTRICT A -> y\nwhat"
    for bad in ("DENY A", "NOCYCLES A.**", "MAXCYCLICITY A = 1", "MAXCYCLICITY = 101", "FOO x"):
        with pytest.raises(rules.RuleError, match="line 2"):
            rules.parse("\n" + bad)
    outcome = rules.evaluate(g, rules.parse("DENY A.** -> B.**"))
    report = json.loads(reports.sarif(outcome, g))["runs"][0]
    assert [r["message"]["text"] for r in report["results"]] == ["A.N.C Uses B.D", "A.N.C Uses B.E"] and len(report["results"][0]["partialFingerprints"]["primary"]) == 32
    assert reports.text(outcome, g).splitlines()[0] == "DENY A.** -> B.**" and reports.uri("C:\\src\\a b.cs", "c:/src") == "a%20b.cs"


def test_matrix(spark):
    g = graph(spark, [("T", "Assembly", None), ("N", "Namespace", "T"), ("M", "Namespace", "T"), ("A", "Class", "N"), ("B", "Class", "M"), ("C", "Class", "M")], [("A", "Uses", "B"), ("C", "Uses", "A")])
    assert flat(dsm.weights(g), "consumer", "provider", "weight") == [("A", "B", 1), ("A", "M", 1), ("C", "A", 1), ("C", "N", 1), ("M", "A", 1), ("M", "N", 1), ("N", "B", 1), ("N", "M", 1)]
    assert flat(dsm.sibling_cycles(g), "a", "b", "kind") == [("M", "N", "Hierarchical")]
    assert dsm.partition_order(["a", "b", "c", "d"], {("d", "a"), ("b", "c"), ("c", "b")}) == ["b", "c", "d", "a"]


def test_edits(spark):
    g = graph(spark, [("T", "Assembly", None), ("N", "Namespace", "T"), ("M", "Namespace", "T"), ("A", "Class", "N"), ("a", "Method", "A")], [("a", "Uses", "N")])
    moved = edits.move(g, ids(spark, "A"), "M")
    assert flat(moved.elements.where("id in ('A', 'a')"), "id", "full_name", "parent_id") == [("A", "T.M.A", "M"), ("a", "T.M.A.a", "A")]
    for what, to in (("T", "N"), ("N", "A"), ("N", "N"), ("a", "T")):
        with pytest.raises(edits.EditError):
            edits.move(g, ids(spark, what), to)
    assert flat(edits.delete(g, ids(spark, "A"))[0].elements, "id") == ["M", "N", "T"]
    assert edits.remove(g, ids(spark, "N")).relationships.isEmpty()
    once = edits.create(g, "N", "Class", "x")
    assert edits.default_name(once, "N", "Class") == "NewClass2" and flat(once.elements.where("id = 'x'"), "full_name") == ["T.N.NewClass"]
    bare = graph(spark, [("T", "Assembly", None), ("A", "Class", "T"), ("a", "Method", "A")])
    assert flat(edits.with_global_namespaces(bare).elements, "full_name") == ["T", "T.global", "T.global.A", "T.global.A.a"]


def test_plain_text_round_trip(spark, tmp_path):
    lines = ["# a graph", "Assembly T", "Class C name=Foo full=T.Foo parent=T access=Internal attr=Test,Old", "loc=src/a.cs:3,7", "Class X external", "Method m parent=gone", "C Calls m [IsStaticCall,IsThisCall]", "loc=src/a.cs:9,1", "C Uses X", "C Uses X"]
    g = sources.parse_plain_text(spark.createDataFrame([*enumerate(lines)], "line_no long, line string"))
    assert flat(g.elements, "id", "full_name", "access_level") == [("C", "T.Foo", "Internal"), ("T", "T", "Unknown"), ("X", "X", "Unknown"), ("m", "m", "Unknown")]
    assert flat(g.relationships, "source_id", "type", "target_id", "attributes") == [("C", "Calls", "m", 6), ("C", "Uses", "X", 0)]
    sinks.write_plain_text(g, str(tmp_path / "out"))
    again = sources.parse_plain_text(sources.numbered_lines(spark, str(tmp_path / "out")))
    assert sinks.digest(sinks.debug_lines(g)) == sinks.digest(sinks.debug_lines(again))
    assert flat(again.elements.select("id", F.to_json("source_locations").alias("l")), "id", "l") == flat(g.elements.select("id", F.to_json("source_locations").alias("l")), "id", "l")
    with pytest.raises(sources.FormatError):
        sources.parse_plain_text(spark.createDataFrame([(0, "what is this")], "line_no long, line string"))
    sources.write_project(g, str(tmp_path / "project"))
    assert sources.read_project(spark, str(tmp_path / "project")).elements.count() == 4


def test_other_readers(spark, tmp_path):
    g = sources.parse_class_dependencies(spark.createDataFrame([("a.b.C -> a.D mod",), ("a.b.C -> x.Y not found",), ("",), ("classes -> z",), ("  a.D -> java.lang.Object base",)], "line string"))
    assert flat(g.elements.where("element_type = 'Class'"), "id") == ["a.D", "a.b.C", "java.lang.Object"] and g.elements.count() == 7 and g.relationships.count() == 2
    data = {"format": 2, "projectName": "p", "elements": [{"id": "1", "type": "Assembly", "name": "p"}, {"id": "2", "type": "Class", "name": "C", "parent": "1"}, {"id": "2", "type": "Class", "name": "again", "parent": "1"}, {"id": "3", "type": "Nope", "name": "x"}, {"id": "4", "type": "Class", "name": "y", "parent": "5"}, {"id": "5", "type": "Class", "name": "z", "parent": "4"}], "relationships": [{"source": "2", "target": "1", "type": "Uses"}, {"source": "2", "target": "9", "type": "Uses"}], "metrics": {"2": {"code": 4, "comment": 1, "logical": 2, "complexity": 1}, "9": {"code": 1, "comment": 1, "logical": 1, "complexity": 1}}}
    (tmp_path / "g.json").write_text(json.dumps(data))
    g, skipped = sources.read_extracted(spark, str(tmp_path / "g.json"))
    assert flat(g.elements, "full_name") == ["p", "p.C"] and tuple(skipped.first()) == (4, 1) and g.metrics.count() == 1
    xml = '<doxygen><compounddef id="c1" kind="class"><compoundname>n::A</compoundname><basecompoundref refid="c2">B</basecompoundref><sectiondef><memberdef id="m1" kind="function"><name>f</name><references refid="m2">g</references><references refid="gone">h</references></memberdef></sectiondef></compounddef></doxygen>'
    other = '<doxygen><compounddef id="c2" kind="interface"><compoundname>n::B</compoundname><sectiondef><memberdef id="m2" kind="function"><name>g</name></memberdef></sectiondef></compounddef></doxygen>'
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/a.xml").write_text(xml)
    (tmp_path / "xml/b.xml").write_text(other)
    g = sources.read_documentation(spark, str(tmp_path / "xml"), "lib")
    assert flat(g.elements, "full_name") == ["lib", "lib.n", "lib.n.A", "lib.n.A.f", "lib.n.B", "lib.n.B.g"]
    assert flat(g.relationships, "source_id", "type", "target_id") == [("c1", "Implements", "c2"), ("m1", "Calls", "m2")]
    (tmp_path / "m.xml").write_text('<dsi><element id="1" name="a.b" type="C"/><element id="2" name="a.c" type="C"/><relation from="1" to="2" type="u" weight="3"/><relation from="1" to="1" type="u" weight="1"/><relation from="1" to="7" type="u" weight="1"/></dsi>')
    e, r = sources.read_matrix(spark, str(tmp_path / "m.xml"))
    assert flat(e, "full_name") == ["a", "a.b", "a.c"] and flat(r, "consumer", "provider", "weight") == [(1, 2, 3)]


def test_writers(spark):
    g = graph(spark, [("T", "Assembly", None), ("A", "Class", "T"), ("I", "Interface", "T"), ("a", "Method", "A")], [("A", "Implements", "I"), ("a", "Uses", "I"), ("a", "Handles", "I", 64)])
    assert flat(sinks.class_diagram(g), "line") == ["T_A ..|> T_I", 'class "A" as T_A', 'interface "I" as T_I']
    assert '<Link Source="a" Target="I" Label="Handles" Category="Handles" />' in flat(sinks.directed_graph(g), "line")
    assert flat(sinks.matrix_lines(g).where("section = 2"), "line") == ['<relation from="1" to="2" type="Uses" weight="1" />']
    assert spark.range(1).select(flag_names(F.lit(66)), sinks.escape_xml(F.lit("a<\x01&"))).first()[:] == ("[IsStaticCall, EventRegistration]", "a&lt;&amp;")


def test_git_log(spark, tmp_path):
    log = "START_HEADER\nh2\nAnn\n2024-05-02T10:00:00\nh1 h0\nfix\nmore\nEND_HEADER\nM\ta.cs\nR100\tb.cs\tc.cs\nA\t\"caf\\303\\251.cs\"\nSTART_HEADER\nh1\nBob\n2024-05-01T10:00:00\n\nfirst\nEND_HEADER\nA\ta.cs\nA\tb.cs\nSTART_HEADER\nh9\nEve\nSTART_HEADER\nh8\nEve\n2024-04-01T10:00:00\n\nno end\n"
    (tmp_path / "log.txt").write_text(log)
    sets, items, edges = histories.read_log(spark, str(tmp_path / "log.txt"))
    assert flat(sets, "id", "comment") == [("h1", "first"), ("h2", "fix\nmore"), ("h8", "no end\n")]
    assert flat(items, "change_set_id", "ord", "kind", "path") == [("h1", 0, 2, "a.cs"), ("h1", 1, 2, "b.cs"), ("h2", 0, 4, "a.cs"), ("h2", 1, 16, "c.cs"), ("h2", 2, 2, "café.cs")]
    assert flat(edges, "hash", "parent", "ord") == [("h2", "h0", 1), ("h2", "h1", 0)]
    tracked = flat(histories.track_renames(items, sets), "path", "id")
    assert dict(tracked)["c.cs"] == dict(tracked)["b.cs"] == "1"


@pytest.mark.parametrize(
    ("extension", "text", "expected"),
    [("cs", "// a\nint x; // b\n\n/* c\n d */ int y;\n/* e */", (2, 3)), ("cs", 's = "// no"; \n@"a ""q"" \n// in text";', (3, 0)), ("html", "<p>\n<!-- a\nb -->\n</p>", (2, 2)), ("py", "# a\nx = '#'\n'''doc\n# in\n'''", (4, 1)), ("vb", "REM a\n' b\nx = 1", (1, 2)), ("md", "# title\n\ntext", (2, 0)), ("xyz", "a\n\nb", (2, 0))],
)
def test_lines_of_code(extension, text, expected):
    assert histories.count_lines(text, extension) == expected


def test_couplings_count_from_zero(spark):
    rows = spark.createDataFrame([(c, k) for c in range(3) for k in ("a", "b")] + [(9, "a")], "change_set_id long, id string")
    assert flat(mining.change_couplings(rows, 1, 0.0), "item1", "item2", "couplings", "degree") == [("a", "b", 2, 40.0)]
    assert flat(mining.change_couplings(rows, 1, 0.0, compat=False), "couplings", "degree") == [(3, 75.0)]
    assert mining.change_couplings(rows, 1, 0.0, largest=1).isEmpty()


def test_ownership(spark):
    c = spark.createDataFrame([("f", "x", 3), ("f", "y", 1), ("g", "b", 2), ("g", "a", 2)], "path string, developer string, lines long")
    assert flat(mining.fractal_values(c), "path", "fractal") == [("f", 0.375), ("g", 0.5)]
    assert flat(mining.main_developers(c), "path", "developer", "percent") == [("f", "x", 75.0), ("g", "a", 50.0)]


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_components_and_ancestors_in_one_task_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(fixpoint, "TASK_EDGES", most)
    monkeypatch.setattr(fixpoint, "WORDS", 1)
    rng = random.Random(8)
    n = 150
    pairs = sorted({tuple(rng.sample(range(n), 2)) for _ in range(190)})
    name = lambda k: f"n{k:03}"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "src string, dst string")
    to = {k: {k} for k in range(n)}
    for _ in range(n):
        for a, b in pairs:
            to[a] |= to[b]
    parts = {k: min(x for x in to[k] if k in to[x]) for k in range(n)}
    many = {k: v for k, v in parts.items() if sum(x == v for x in parts.values()) > 1}
    assert {r["node"]: r["component"] for r in fixpoint.strong_components(edges).collect()} == {name(k): name(v) for k, v in many.items()}
    size = {v: sum(x == v for x in parts.values()) for v in set(parts.values())}
    above = {v: sum(s for u, s in size.items() if u != v and v in to[u]) for v in size}
    between = sorted({(name(parts[a]), name(parts[b])) for a, b in pairs if parts[a] != parts[b]})
    got = fixpoint.ancestor_sizes(spark.createDataFrame([(name(k), v) for k, v in size.items()], "node string, size long"), spark.createDataFrame(between, "src string, dst string"))
    assert {r["node"]: r["above"] for r in got.collect()} == {name(k): v for k, v in above.items() if v}


def test_feedback_order_of_a_large_cycle_ends_soon():
    n = 60_000
    rng = random.Random(1)
    edges = pd.DataFrame([(f"{k:06}", f"{(k + 1) % n:06}") for k in range(n)] + [(f"{rng.randrange(n):06}", f"{rng.randrange(n):06}") for _ in range(n)], columns=["src", "dst"])
    began = time.monotonic()
    order = metrics.feedback_order(edges[edges["src"] != edges["dst"]])
    assert sorted(order) == [f"{k:06}" for k in range(n)] and time.monotonic() - began < 30


def test_callers_never_list_hierarchies(spark, monkeypatch):
    """Calls on the current instance from a sibling class are forbidden, from a base are not; and no table holds all pairs of classes."""
    monkeypatch.setattr(explore, "forbidden_call_sources", lambda *_: pytest.fail("pairs of classes"))
    g = graph(
        spark,
        [("B", "Class", None), ("S", "Class", None), ("D", "Class", None), ("bm", "Method", "B"), ("sm", "Method", "S"), ("dm", "Method", "D"), ("x", "Method", "D")],
        [("S", "Inherits", "B"), ("D", "Inherits", "B"), ("sm", "Calls", "dm"), ("bm", "Calls", "dm"), ("x", "Calls", "sm", 8)],
    )
    assert flat(explore.follow_callers(g, ids(spark, "dm")), "id") == ["bm", "dm"]


def test_members_of_bases_that_tie_nothing_are_not_listed(spark, monkeypatch):
    sizes = []
    kept = cohesion.materialize
    monkeypatch.setattr(cohesion, "materialize", lambda df, label, *a, **b: (sizes.append(df.count()) if label == "members" else None, kept(df, label, *a, **b))[1])
    g = graph(spark, [("B", "Class", None), ("D", "Class", None), *((f"b{k}", "Method", "B") for k in range(9)), *((f"d{k}", "Method", "D") for k in range(4))], [("D", "Inherits", "B"), ("d0", "Calls", "b0"), ("d1", "Uses", "b0")])
    assert flat(cohesion.type_cohesion(g), "id", "methods", "partitions") == [("B", 9, 9), ("D", 4, 3)]
    assert sizes == [4]
