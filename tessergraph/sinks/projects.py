"""Files of histories, matrices and exploration sessions, as JSON lines in folders; each can be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import ACCESS_LEVELS, ELEMENT_TYPES, RELATIONSHIP_TYPES
from ..model import Graph
from ..operators.explore import get_elements
from ..operators.matrix_edits import Matrix

#: What a folder of each kind holds, with the schemas to read it by.
HISTORY = {"change_sets": "id string, committer string, date timestamp, comment string", "items": "change_set_id string, id string, kind int, path string", "code": "path string, code long, comments long", "contributions": "path string, developer string, lines long", "aliases": "developer string, alias string"}
MATRIX = {"elements": "id string, name string, element_type string, parent string, position long, deleted boolean", "relations": "consumer string, provider string, type string, weight long, deleted boolean"}
SESSION = {"elements": "id string, flag string", "relationships": "source_id string, target_id string, type string, flag string"}


def _write(frames: dict[str, DataFrame], kinds: dict[str, str], folder: str) -> None:
    """Every frame in the columns of its kind; what it lacks is null."""
    for name, schema in kinds.items():
        if name in frames:
            df = frames[name]
            columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in schema.split(","))]
            df.select(*columns).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}")


def _read(spark: SparkSession, kinds: dict[str, str], folder: str, name: str) -> DataFrame:
    return spark.read.schema(kinds[name]).json(f"{folder}/{name}")


def write_history(folder: str, **frames: DataFrame) -> None:
    """change_sets, items, code, contributions and aliases, as far as they are given."""
    _write(frames, HISTORY, folder)


def read_history(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(_read(spark, HISTORY, folder, n) for n in names)


def write_matrix(m: Matrix, folder: str) -> None:
    """Elements and relations, deleted ones as well."""
    _write({"elements": m.elements, "relations": m.relations}, MATRIX, folder)


def read_matrix_folder(spark: SparkSession, folder: str) -> Matrix:
    return Matrix(*(_read(spark, MATRIX, folder, n) for n in MATRIX))


def project_lines(g: Graph) -> DataFrame:
    """(section, ord, line) of a project file: sorted, the lines are one JSON document of children, elements, relationships, metrics, contracts and notifying types, kinds as numbers.

    Within a list every line but the first begins with a comma; the first is the one of the least key.
    """
    code = lambda c, names: (F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c)) - 1).cast("int")
    places = F.transform("source_locations", lambda p: F.struct(p.file.alias("File"), p.line.alias("Line"), p.column.alias("Column"))).alias("SourceLocations")
    columns = lambda **names: F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in names.items()]))
    pair = F.concat_ws("\x1f", "source_id", "target_id", "type")
    lists = [
        ("Children", "[]", g.elements.where("parent_id is not null").select(F.col("id").alias("ord"), columns(ParentId="parent_id", ChildId="id").alias("line"))),
        ("CodeElements", "[]", g.elements.select(F.col("id").alias("ord"), columns(Id="id", Name="name", FullName="full_name", ElementType=code("element_type", ELEMENT_TYPES), SourceLocations=places, Attributes="attributes", IsExternal="is_external", IsGenerated="is_generated", AccessLevel=code("access_level", ACCESS_LEVELS)).alias("line"))),
        ("Relationships", "[]", g.relationships.select(pair.alias("ord"), columns(Attributes="attributes", SourceId="source_id", TargetId="target_id", Type=code("type", RELATIONSHIP_TYPES), SourceLocations=places).alias("line"))),
    ]
    if g.metrics is not None:
        lists.append(("MemberMetrics", "[]", g.metrics.select(F.col("element_id").alias("ord"), columns(ElementId="element_id", CodeLines="code_lines", CommentLines="comment_lines", LogicalLinesOfCode="logical_lines_of_code", CyclomaticComplexity="cyclomatic_complexity").alias("line"))))
    if g.contracts is not None:
        text = lambda c: F.expr(f"substring(to_json(struct({c} as c)), 6, length(to_json(struct({c} as c))) - 6)")
        lists.append(("ExternalContracts", "{}", g.contracts.select(F.col("element_id").alias("ord"), F.concat(text("element_id"), F.lit(":"), text("contract")).alias("line"))))
    if g.notifying is not None:
        lists.append(("NotifyingTypes", "[]", g.notifying.select(F.col("id").alias("ord"), F.expr("substring(to_json(struct(id as c)), 6, length(to_json(struct(id as c))) - 6)").alias("line"))))
    spark, out = g.elements.sparkSession, None
    for k, (name, ends, rows) in enumerate(lists):
        first = F.broadcast(rows.agg(F.min("ord").alias("least")))  # one row
        body = rows.join(first, F.lit(True)).select(F.lit(2 * k + 1).alias("section"), "ord", F.concat(F.when(F.col("ord") == F.col("least"), "").otherwise(","), "line").alias("line"))
        before = "{" if not k else "],".replace("]", lists[k - 1][1][1])
        part = body.unionByName(spark.createDataFrame([(2 * k, "", f'{before}"{name}":{ends[0]}')], "section int, ord string, line string"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(spark.createDataFrame([(2 * len(lists), "", lists[-1][1][1] + "}")], "section int, ord string, line string"))


def write_project_json(g: Graph, path: str, parts: bool = False) -> None:
    """One sorted file in a folder; the writer's single task puts the sorted parts together, as the form asks for one document.

    With `parts` they stay as they are, compressed: in the order of their names they are the same document, and no task holds it.
    """
    lines = project_lines(g).orderBy("section", "ord").select("line")
    if parts:
        lines.write.option("compression", "gzip").text(path)
    else:
        lines.coalesce(1).write.text(path)


def save_session(elements: DataFrame, relationships: DataFrame, folder: str) -> None:
    """What an exploration shows: ids and relationships, with a column `flag` for marks."""
    _write({"elements": elements, "relationships": relationships}, SESSION, folder)


def restore_session(g: Graph, folder: str) -> tuple[DataFrame, DataFrame]:
    """The session's elements and relationships that the graph still has, with their flags."""
    spark = g.elements.sparkSession
    e, r = (_read(spark, SESSION, folder, n) for n in SESSION)
    e, r = e.dropDuplicates(["id"]), r.dropDuplicates(["source_id", "target_id", "type"])
    shown = get_elements(g, e).join(e, "id")
    edges = g.relationships.join(r, ["source_id", "target_id", "type"])
    for side in ("source_id", "target_id"):
        edges = edges.join(shown.select(F.col("id").alias(side)), side, "left_semi")
    return shown, edges
