import math

import pytest
from pyspark.sql import functions as F

from tessergraph.operators import history as mining
from tessergraph.operators import matrix
from tessergraph.operators.edits import EditError
from tessergraph.operators.matrix_edits import ACTIONS, Editor, Matrix
from tessergraph.sinks import projects

from .test_graphs import flat, graph, ids


def nested(spark):
    elements = [("T", "Assembly", None), ("A", "Namespace", "T"), ("B", "Namespace", "A"), ("C", "Namespace", "B"), ("D", "Namespace", "B"), ("p", "Class", "C"), ("q", "Class", "C"), ("r", "Class", "D"), ("E", "Namespace", "T")]
    return graph(spark, elements, [("p", "Uses", "q"), ("q", "Calls", "p"), ("p", "Uses", "r"), ("r", "Uses", "q")])


def test_elements_without_namespaces_that_only_pass_through(spark):
    rows = {r["id"]: (r["name"], r["parent"]) for r in matrix.matrix_elements(nested(spark)).collect()}
    # A holds only B; B holds two; E holds no type
    assert rows == {"T": ("T", None), "B": ("A.B", "T"), "C": ("C", "B"), "D": ("D", "B"), "p": ("p", "C"), "q": ("q", "C"), "r": ("r", "D")}


def test_metrics_of_elements(spark):
    rows = {r["id"]: r for r in matrix.matrix_metrics(nested(spark)).collect()}
    assert [rows["C"][c] for c in ("elements", "ingoing", "outgoing", "internal", "external", "system_cycles", "hierarchical_cycles")] == [3, 1, 1, 2, 2, 1, 0]
    # C and D depend on each other, but not directly
    assert (rows["B"]["system_cycles"], rows["B"]["hierarchical_cycles"], rows["B"]["cyclicity"]) == (1, 1, 50.0)
    assert rows["p"]["cyclicity"] == 0.0 and sum(r["percent"] for i, r in rows.items() if i in "pqr") == pytest.approx(300 / 7)


def test_partners_and_search(spark):
    g = nested(spark)
    assert flat(matrix.relations_between(g, ids(spark, "C"), ids(spark, "D")), "consumer", "provider") == [("p", "r")]
    assert flat(matrix.partners(g, ids(spark, "D")), "full_name", "weight") == [("T.A.B.C.q", 1)]
    assert flat(matrix.partners(g, ids(spark, "D"), False), "id") == ["p"]
    found = matrix.search_matrix(matrix.matrix_elements(g), g, "c.P")
    assert dict(flat(found, "id", "matches")) == {"p": True, "C": False, "B": False, "T": False}
    assert matrix.search_matrix(matrix.matrix_elements(g), g, "c.P", case=True).count() == 0
    assert matrix.search_matrix(matrix.matrix_elements(g), g, "c.p", kind="Enum").count() == 0
    relations = spark.createDataFrame([("a", "b", "x"), ("a", "?", "x"), ("a", "b", "y")], "consumer string, provider string, type string")
    assert flat(matrix.relation_counts(relations, ids(spark, "a", "b")), "type", "imported", "resolved", "percent") == [("x", 2, 1, 50.0), ("y", 1, 1, 100.0)]


@pytest.fixture()
def editor(spark):
    elements = spark.createDataFrame([("m", "m", "Namespace", None), ("n", "n", "Namespace", None), ("a", "a", "Class", "m"), ("b", "b", "Class", "m"), ("c", "c", "Class", "m"), ("d", "d", "Class", "n")], "id string, name string, element_type string, parent string")
    relations = spark.createDataFrame([("b", "a", "Uses", 2), ("c", "b", "Uses", 1), ("a", "d", "Uses", 3), ("a", "a", "Uses", 9)], "consumer string, provider string, type string, weight int")
    return Editor(Matrix.of(elements, relations))


def order(matrix_, parent):
    return [r["id"] for r in matrix_.living().where(F.col("parent").eqNullSafe(F.lit(parent))).orderBy("position").collect()]


def weights(matrix_):
    return {(r["consumer"], r["provider"]): r["weight"] for r in matrix_.weights().collect()}


def test_orders(editor):
    assert order(editor.apply("sort", ident="m"), "m") == ["c", "b", "a"]
    assert order(editor.apply("move_down", ident="c"), "m") == ["b", "c", "a"]
    assert order(editor.apply("move_up", ident="a"), "m") == ["b", "a", "c"]
    with pytest.raises(EditError):
        editor.apply("move_up", ident="b")
    assert order(editor.apply("sort_deep", ident=None, order="Alphabetical"), "m") == ["a", "b", "c"]
    assert [name for name, _ in editor.log()] == ["sort", "move_down", "move_up", "sort_deep"]
    while editor.undo():
        pass
    assert order(editor.matrix, "m") == ["a", "b", "c"] and editor.redo() and order(editor.matrix, "m") == ["c", "b", "a"]


def test_edits_and_weights(editor):
    before = weights(editor.matrix)
    assert before[("m", "n")] == 3 and ("m", "m") not in before and ("a", "a") not in before
    editor.apply("reweight_relation", consumer="a", provider="d", kind="Uses", weight=5)
    assert weights(editor.matrix)[("m", "n")] == 5
    editor.apply("reparent", ident="b", to="n")
    assert weights(editor.matrix)[("n", "m")] == 2 and order(editor.matrix, "n") == ["d", "b"]
    editor.apply("delete", ident="n")
    assert weights(editor.matrix) == {} and editor.matrix.elements.count() == 6
    for _ in range(3):
        editor.undo()
    assert weights(editor.matrix) == before
    editor.apply("copy", ident="m", to="n")
    assert order(editor.matrix, "m#copy") == ["a#copy", "b#copy", "c#copy"]
    editor.apply("rename", ident="a#copy", name="z")
    editor.apply("create", ident="e", name="e", element_type="Class", parent="n")
    editor.apply("create_relation", consumer="e", provider="a", kind="Calls")
    editor.apply("retype_relation", consumer="e", provider="a", kind="Calls", to="Uses")
    editor.apply("delete_relation", consumer="c", provider="b", kind="Uses")
    assert weights(editor.matrix)[("e", "m")] == 1 and ("c", "b") not in weights(editor.matrix)
    assert {"retype", "sort_deep"} <= set(ACTIONS)


@pytest.mark.parametrize("action", [("rename", {"ident": "a", "name": "b"}), ("reparent", {"ident": "m", "to": "a"}), ("delete", {"ident": "?"}), ("create", {"ident": "a", "name": "x", "element_type": "Class"}), ("create_relation", {"consumer": "a", "provider": "a", "kind": "Uses"}), ("sort", {"ident": "m", "order": "?"}), ("delete_relation", {"consumer": "a", "provider": "b", "kind": "Uses"})])
def test_forbidden_edits(editor, action):
    with pytest.raises(EditError):
        editor.apply(action[0], **action[1])
    assert not editor.log()


def test_values_of_leaves(spark):
    nodes = mining.roll_up(spark.createDataFrame([("r/s/x", 1.0), ("r/s/y", 2.0), ("r/s/y2/z", 4.0)], "path string, area double"))
    assert flat(mining.shrink(nodes), "node") == ["r/s", "r/s/x", "r/s/y", "r/s/y2", "r/s/y2/z"]
    several = mining.roll_up(spark.createDataFrame([("a/x", 1.0), ("b/y", 2.0)], "path string, area double"))
    assert mining.shrink(several).count() == 4
    leaves = spark.createDataFrame([("Ab", 1.0), ("b", 2.0), ("c", math.nan), ("d", 2.0)], "path string, weight double")
    assert [r[0] for r in mining.distinct_values(leaves, "weight").collect()] == [1.0, 2.0]
    stand_out = lambda *a: flat(leaves.where(mining.highlighted(F.col("path"), *a)), "path")
    assert stand_out() == [] and stand_out("B") == ["Ab", "b"] and stand_out("B", F.col("weight") > 1) == ["b"]
    colours = spark.createDataFrame([("x", "ann"), ("y", ""), ("z", "ann")], "path string, colour string")
    assert flat(mining.colour_keys(colours), "colour") == ["ann"]
    sets = spark.createDataFrame([("1", "ann"), ("2", " ")], "id string, committer string")
    given = spark.createDataFrame([("p", "bob", 1)], "path string, developer string, lines int")
    known = spark.createDataFrame([("bob", "team")], "developer string, alias string")
    assert flat(mining.default_aliases(sets, given, known), "developer", "alias") == [("ann", "ann"), ("bob", "team")]


def test_files_can_be_read_back(spark, editor, tmp_path):
    m = editor.apply("delete", ident="n")
    projects.write_matrix(m, f"{tmp_path}/matrix")
    back = projects.read_matrix_folder(spark, f"{tmp_path}/matrix")
    assert sorted(map(tuple, back.elements.collect()), key=str) == sorted(map(tuple, m.elements.collect()), key=str)
    assert sorted(map(tuple, back.relations.collect()), key=str) == sorted(map(tuple, m.relations.collect()), key=str)

    sets = spark.sql("select '1' as id, 'ann' as committer, timestamp '2020-01-02 03:04:05' as date, 'x' as other")
    projects.write_history(f"{tmp_path}/history", change_sets=sets)
    (again,) = projects.read_history(spark, f"{tmp_path}/history", "change_sets")
    assert again.select("id", "committer", F.col("date").cast("string"), "comment").first() == ("1", "ann", "2020-01-02 03:04:05", None)

    g = nested(spark)
    shown = spark.createDataFrame([("p", "red"), ("q", None), ("gone", "red")], "id string, flag string")
    edges = spark.createDataFrame([("p", "q", "Uses"), ("p", "r", "Uses"), ("p", "q", "Calls")], "source_id string, target_id string, type string")
    projects.save_session(shown, edges, f"{tmp_path}/session")
    e, r = projects.restore_session(g, f"{tmp_path}/session")
    assert dict(flat(e, "id", "flag")) == {"p": "red", "q": None} and flat(r, "source_id", "target_id", "type") == [("p", "q", "Uses")]
