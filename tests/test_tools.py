import json

import pytest

from tessergraph import registry
from tessergraph.model import ELEMENTS, RELATIONSHIPS, Graph
from tessergraph.operators import explore
from tessergraph.operators.layout import squarify, treemap
from tessergraph.sinks import projects
from tessergraph.sources import extras
from tessergraph.sources import graphs as sources

from .test_graphs import flat, graph, ids, types


def test_chains_of_shortest_paths(spark):
    g = types(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")])
    assert flat(registry.find_paths(g, ids(spark, "A", "D")), "chain") == [["A", "B", "D"], ["A", "C", "D"]]
    assert explore.chains(explore.paths_between(g, ids(spark, "A", "D")), 1).count() == 1


def test_treemap_keeps_areas(spark):
    areas = [6.0, 6.0, 4.0, 3.0, 2.0, 2.0, 1.0]
    rects = squarify(areas, 0, 0, 6, 4)
    assert [w * h for _, _, w, h in rects] == pytest.approx(areas) and rects[0] == pytest.approx((0, 0, 3, 2))
    nodes = spark.createDataFrame([("a", 3.0), ("a/x", 2.0), ("a/y", 1.0), ("b", 1.0)], "node string, area double")
    rows = {r["node"]: r["w"] * r["h"] for r in treemap(nodes, 10, 10).collect()}
    assert rows == pytest.approx({"a": 75.0, "b": 25.0, "a/x": 50.0, "a/y": 25.0})


def test_questions(spark):
    g = graph(spark, [("T", "Assembly", None), ("A", "Class", "T"), ("m", "Method", "A")], [("m", "Uses", "A")])
    assert ("child", "T.A.m") in flat(registry.describe_element(g, "A"), "part", "value") and ("incoming", "1") in flat(registry.describe_element(g, "A"), "part", "value")
    assert ("relationship", "Uses", 1) in flat(registry.graph_info(g), "what", "kind", "count")
    assert flat(registry.search_elements(g, "a.m"), "id") == ["m"]
    assert set(registry.ANALYZERS) >= {"DeadCode", "TypeCohesion"}


def test_markup_links_and_reports(spark):
    g = graph(spark, [("T", "Assembly", None), ("V", "Namespace", "T", {"name": "V"}), ("P", "Class", "V", {"name": "Panel"}), ("Q", "Class", "T", {"name": "Panel"}), ("S", "Class", "T", {"name": "Single"}), ("W", "Class", "T", {"name": "Window1"})])
    files = spark.createDataFrame([("W", '<Window xmlns:v="clr-namespace:T.V"><v:Panel/><Panel/><B C="{x:Type Single}"/></Window>')], "owner_id string, text string")
    assert flat(extras.link_markup(g, files).relationships, "source_id", "target_id", "attributes") == [("W", "P", 256), ("W", "S", 256)]
    rows = extras.parse_report("warning: x\nDENY a -> b\n  a.C -> b.D (Uses)")
    assert rows[0]["source"] == "a.C" and len(rows[0]["id"]) == 16 and rows[0]["rule"] == "DENY a -> b"


def test_project_file_is_one_document_and_comes_back(spark, tmp_path):
    e = [("A", "Assembly", "a \"b\"\\", "a", None, "Unknown", False, False, [], []), ("C", "Class", "Ünï", "a.C", "A", "ProtectedAndInternal", False, True, ["X", "Y"], [("f,g.cs", 3, 4)])]
    r = [("C", "A", "Bundled", 3, []), ("C", "A", "Calls", 0, [("f", 1, 2)])]
    m = spark.createDataFrame([("C", 1, 2, 3, 4)], "element_id string, code_lines int, comment_lines int, logical_lines_of_code int, cyclomatic_complexity int")
    contracts = spark.createDataFrame([("C", 'x"y')], "element_id string, contract string")
    g = Graph(spark.createDataFrame(e, ELEMENTS), spark.createDataFrame(r, RELATIONSHIPS), m, contracts, spark.createDataFrame([("C",)], "id string"))
    projects.write_project_json(g, str(tmp_path / "p"))
    document = json.loads(next((tmp_path / "p").glob("part-*")).read_text())
    assert document["Children"] == [{"ParentId": "A", "ChildId": "C"}] and document["CodeElements"][1]["AccessLevel"] == 4 and document["Relationships"][0]["Type"] == 10
    back = sources.read_project_json(spark, str(tmp_path / "p"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back.elements.drop("parent_id")) == rows(g.elements.drop("parent_id")) and rows(back.relationships.select(*RELATIONSHIPS.names)) == rows(g.relationships)
    assert rows(back.metrics) == rows(m) and rows(back.contracts) == rows(contracts) and rows(back.notifying) == [("C",)]
    bare = Graph(g.elements, g.relationships.where("false"))
    projects.write_project_json(bare, str(tmp_path / "q"))
    assert sources.read_project_json(spark, str(tmp_path / "q")).relationships.isEmpty()


def test_only_members_can_be_hidden(spark):
    with pytest.raises(ValueError):
        explore.hide(Graph(spark.createDataFrame([], ELEMENTS), spark.createDataFrame([], RELATIONSHIPS)), ("Class",))


def test_project_file_in_parts_is_the_same_document(spark, tmp_path):
    import gzip

    g = graph(spark, [("T", "Assembly", None), *((f"C{k:05}", "Class", "T") for k in range(30_000))], [("C00001", "Uses", "C00002")])
    projects.write_project_json(g, str(tmp_path / "one"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        projects.write_project_json(g, str(tmp_path / "p"), parts=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "p").glob("part-*.gz"))
    assert len(files) > 1 and b"".join(gzip.decompress(f.read_bytes()) for f in files) == next((tmp_path / "one").glob("part-*")).read_bytes()
    back = sources.read_project_parts(spark, str(tmp_path / "p"))
    assert back.elements.where("parent_id = 'T'").count() == 30_000 and flat(back.relationships, "source_id", "target_id", "type") == [("C00001", "C00002", "Uses")]
