"""Readers of graphs: plain text, class lists, extractor JSON, project JSON, documentation XML and matrix XML."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import ACCESS_LEVELS, ELEMENT_TYPES, FLAGS, RELATIONSHIP_TYPES
from ..model import ELEMENTS, RELATIONSHIPS, Graph, canonical
from ..plans.storage import materialize


class FormatError(ValueError):
    """A line that is neither an element nor a relationship."""


def _empty(field: str) -> Column:
    return F.array().cast((ELEMENTS if field == "attributes" else RELATIONSHIPS)[field].dataType)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of text files. Numbers grow along a file, as readers of one partition are in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse_plain_text(lines: DataFrame) -> Graph:
    """Graph from (line_no, line): elements `Type Id [name=] [full=] [parent=] [external] [access=] [attr=a,b]`, relationships
    `Source Type Target [Flag,Flag]`, `loc=file:line,column` after its owner, `#` comments.

    A line is a relationship if its first and third words are elements defined
    above it. An unknown parent makes a root. A relationship repeated is merged.
    """
    rows = lines.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')")
    is_loc = F.col("line").startswith("loc=")
    # of other lines than places only the numbers are dealt out here
    owned = rows.select("line_no", is_loc.alias("is_loc"), F.when(is_loc, F.col("line")).alias("line"))
    # the owner is the last other line before: within a block of lines, or the last of the blocks before, of which there is a row each
    owned = owned.withColumn("block", F.shiftright("line_no", 14))
    other = F.when(~F.col("is_loc"), F.col("line_no"))
    lasts = owned.groupBy("block").agg(F.max(other).alias("last")).withColumn("carried", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "carried")
    w = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = owned.withColumn("owner", F.max(other).over(w)).join(lasts, "block").withColumn("owner", F.coalesce("owner", "carried")).drop("block", "carried")
    place = F.struct(F.regexp_extract("line", r"^loc=(.*):(\d+),(\d+)$", 1).alias("file"), F.regexp_extract("line", r"^loc=(.*):(\d+),(\d+)$", 2).cast("int").alias("line"), F.regexp_extract("line", r"^loc=(.*):(\d+),(\d+)$", 3).cast("int").alias("column"))
    places = owned.where("is_loc").groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", place.alias("p")))), lambda x: x.p).alias("source_locations"))
    body = materialize(rows.where(~is_loc).join(places, F.col("line_no") == F.col("owner"), "left").select("line_no", "line", "source_locations"), "plain-body", codec="zstd", collect=True)
    body = body.select("line_no", F.split("line", r"\s+").alias("w"), "source_locations")
    kinds, relations = F.col("w")[0].isin(*ELEMENT_TYPES), F.size("w") >= 3
    defined = body.where(kinds & (F.size("w") >= 2)).groupBy(F.get("w", F.lit(1)).alias("id")).agg(F.min("line_no").alias("at"))
    ends = lambda c, n: defined.select(F.col("id").alias(c), F.col("at").alias(n))
    # only lines that read like a relationship are joined with what is defined
    could = F.coalesce(relations & F.get("w", F.lit(1)).isin(*RELATIONSHIP_TYPES), F.lit(False))
    likely = body.where(could).withColumn("a", F.col("w")[0]).withColumn("b", F.get("w", F.lit(2))).join(ends("a", "at_a"), "a", "left").join(ends("b", "at_b"), "b", "left")
    edge = (F.col("at_a") < F.col("line_no")) & (F.col("at_b") < F.col("line_no"))
    tagged = likely.select(*body.columns, F.coalesce(edge, F.lit(False)).alias("edge")).unionByName(body.where(~could).withColumn("edge", F.lit(False)))
    bad = tagged.where(~F.col("edge") & ~(kinds & (F.size("w") >= 2))).select(F.array_join("w", " ").alias("l")).first()
    if bad:
        raise FormatError(f"neither an element nor a relationship between elements defined above: {bad['l']}")
    option = lambda name: F.expr(f"element_at(filter(w, x -> startswith(x, '{name}=')), -1)")
    value = lambda name: F.when(F.exists("w", lambda x: x.startswith(f"{name}=")), F.substring(option(name), len(name) + 2, 1 << 30))
    e = tagged.where(~F.col("edge"))
    ident = F.get("w", F.lit(1))
    parents = defined.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    first = Window.partitionBy("id").orderBy("line_no")
    elements = e.select(
        ident.alias("id"), "line_no", F.col("w")[0].alias("element_type"), F.coalesce(value("name"), ident).alias("name"), F.coalesce(value("full"), value("name"), ident).alias("full_name"), value("parent").alias("parent_id"),
        F.when(value("access").isin(*ACCESS_LEVELS), value("access")).otherwise("Unknown").alias("access_level"), F.array_contains("w", "external").alias("is_external"), F.lit(False).alias("is_generated"),
        F.coalesce(F.array_distinct(F.split(value("attr"), ",")), _empty("attributes")).alias("attributes"), F.coalesce("source_locations", _empty("source_locations")).alias("source_locations"),
    )
    elements = elements.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(parents, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).select(*[f.name for f in ELEMENTS])
    names = F.split(F.regexp_replace(F.array_join(F.slice("w", 4, 100), ""), r"[\[\]]", ""), ",")
    bits = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    flags = F.aggregate(names, F.lit(0), lambda s, n: s.bitwiseOR(F.coalesce(bits[n], F.lit(0))))
    relationships = canonical(tagged.where("edge").select(F.col("w")[0].alias("source_id"), F.get("w", F.lit(2)).alias("target_id"), F.get("w", F.lit(1)).alias("type"), flags.alias("attributes"), F.coalesce("source_locations", _empty("source_locations")).alias("source_locations")))
    return Graph(elements, relationships)


def _chain(names: DataFrame, leaf: str) -> DataFrame:
    """Elements for dotted names (column name) and all their prefixes; the full names are the ids."""
    parts = F.split("name", r"\.")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), ".")
    steps = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(prefix(n).alias("id"), F.element_at(parts, n).alias("name"), F.when(n > 1, prefix(n - 1)).alias("parent_id"), F.when(n == F.size(parts), 1).otherwise(0).alias("leaf")))).alias("s")).select("s.*")
    merged = steps.groupBy("id", "name", "parent_id").agg(F.max("leaf").alias("leaf"))
    return merged.select("id", F.when(F.col("leaf") == 1, leaf).otherwise("Namespace").alias("element_type"), "name", F.col("id").alias("full_name"), "parent_id", F.lit("Unknown").alias("access_level"), F.lit(False).alias("is_external"), F.lit(False).alias("is_generated"), _empty("attributes").alias("attributes"), _empty("source_locations").alias("source_locations"))


def parse_class_dependencies(lines: DataFrame) -> Graph:
    """Graph from (line) `from.Class -> to.Class module`: namespaces from dotted names, classes at their ends, Uses between them. Blank lines, `not found` and headers starting `classes` are skipped."""
    pairs = lines.where("trim(line) <> '' and not contains(line, 'not found') and not startswith(trim(line), 'classes')").select(F.regexp_extract(F.trim("line"), r"^(\S+)\s+->\s+(\S+)", 1).alias("a"), F.regexp_extract(F.trim("line"), r"^(\S+)\s+->\s+(\S+)", 2).alias("b")).where("a <> '' and b <> ''")
    elements = _chain(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "Class")
    relationships = pairs.distinct().select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("Uses").alias("type"), F.lit(0).alias("attributes"), _empty("source_locations").alias("source_locations"))
    return Graph(elements, relationships)


_EXTRACTED = "format int, projectName string, elements array<struct<id:string,type:string,name:string,parent:string,external:boolean,location:struct<file:string,line:int,column:int>>>, relationships array<struct<source:string,target:string,type:string>>, metrics map<string,struct<code:int,comment:int,logical:int,complexity:int>>"


def read_extracted(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Graph of an extractor's JSON (format 2), and one row with what was skipped: elements of unknown type or without a way to a root, and edges without ends."""
    raw = spark.read.schema(_EXTRACTED).option("multiLine", True).json(path)
    if not raw.where("format is null or format <> 2").isEmpty():
        raise FormatError("the format is not 2")
    every = raw.select(F.posexplode("elements").alias("n", "e")).select("n", "e.*")
    one = every.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("n"))).where("_k = 1").where(F.col("type").isin(*ELEMENT_TYPES))
    level = one.where("parent is null").select("id", F.col("name").alias("full_name"))
    kept = level
    while True:
        level = one.join(level.select(F.col("id").alias("parent"), F.col("full_name").alias("above")), "parent").select("id", F.concat_ws(".", "above", "name").alias("full_name"))
        if level.isEmpty():
            break
        kept = kept.unionByName(level)
    place = F.when(F.col("location").isNull(), _empty("source_locations")).otherwise(F.array("location"))
    elements = one.join(kept, "id").select("id", F.col("type").alias("element_type"), "name", "full_name", F.col("parent").alias("parent_id"), F.lit("Unknown").alias("access_level"), F.coalesce("external", F.lit(False)).alias("is_external"), F.lit(False).alias("is_generated"), _empty("attributes").alias("attributes"), place.alias("source_locations"))
    edges = raw.select(F.explode("relationships").alias("r")).select(F.col("r.source").alias("source_id"), F.col("r.target").alias("target_id"), F.col("r.type").alias("type"), F.lit(0).alias("attributes"), _empty("source_locations").alias("source_locations"))
    known = elements.select("id")
    relationships = canonical(edges.where(F.col("type").isin(*RELATIONSHIP_TYPES)).join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
    metrics = raw.select(F.explode("metrics").alias("element_id", "m")).join(known.select(F.col("id").alias("element_id")), "element_id", "left_semi").select("element_id", F.col("m.code").alias("code_lines"), F.col("m.comment").alias("comment_lines"), F.col("m.logical").alias("logical_lines_of_code"), F.col("m.complexity").alias("cyclomatic_complexity"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    skipped = count(every, "a").join(count(elements, "b"), F.lit(True)).join(count(edges.select("source_id", "target_id", "type").distinct(), "c"), F.lit(True)).join(count(relationships, "d"), F.lit(True)).select((F.col("a") - F.col("b")).alias("elements"), (F.col("c") - F.col("d")).alias("relationships"))
    return Graph(elements, relationships, metrics), skipped


def write_project(g: Graph, path: str) -> None:
    """Elements, relationships and metrics as Parquet tables below `path`, the native form."""
    g.elements.write.parquet(f"{path}/elements")
    g.relationships.write.parquet(f"{path}/relationships")
    if g.metrics is not None:
        g.metrics.write.parquet(f"{path}/metrics")


def read_project(spark: SparkSession, path: str, metrics: bool = False) -> Graph:
    return Graph(spark.read.schema(ELEMENTS).parquet(f"{path}/elements"), spark.read.schema(RELATIONSHIPS).parquet(f"{path}/relationships"), spark.read.parquet(f"{path}/metrics") if metrics else None)


_PLACES = "array<struct<File:string,Line:int,Column:int>>"
_PROJECT = f"Children array<struct<ParentId:string,ChildId:string>>, CodeElements array<struct<Id:string,Name:string,FullName:string,ElementType:int,SourceLocations:{_PLACES},Attributes:array<string>,IsExternal:boolean,IsGenerated:boolean,AccessLevel:int>>, Relationships array<struct<Attributes:int,SourceId:string,TargetId:string,Type:int,SourceLocations:{_PLACES}>>, MemberMetrics array<struct<ElementId:string,CodeLines:int,CommentLines:int,LogicalLinesOfCode:int,CyclomaticComplexity:int>>, ExternalContracts map<string,string>, NotifyingTypes array<string>"


def read_project_json(spark: SparkSession, path: str) -> Graph:
    """Graph of a project file: children, elements and relationships with kinds as numbers, member metrics, contracts from outside, and types that notify."""
    raw = spark.read.schema(_PROJECT).option("multiLine", True).json(path)
    each = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    return _project(each, raw.select(F.explode("ExternalContracts").alias("element_id", "contract")), raw.select(F.explode("NotifyingTypes").alias("id")))


#: How lines of each list of a project file begin.
_BEGIN = {"Children": ('{"ParentId":',), "CodeElements": ('{"Id":',), "Relationships": ('{"Attributes":', '{"SourceId":'), "MemberMetrics": ('{"ElementId":',)}


def read_project_parts(spark: SparkSession, path: str) -> Graph:
    """Graph of a project file as `write_project_json` puts it, an entry a line, whole or in parts; lines tell by their first name what they are, so any task can read any of them."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("line"))
    schema = spark.createDataFrame([], _PROJECT).schema
    begins = lambda c: reduce(lambda a, b: a | b, [F.col("line").startswith(x) for x in _BEGIN[c]])
    each = lambda c: lines.where(begins(c)).select(F.from_json("line", schema[c].dataType.elementType).alias("x")).select("x.*")
    texts = lines.where("startswith(line, '\"')")
    contracts = texts.select(F.explode(F.from_json(F.concat(F.lit("{"), "line", F.lit("}")), "map<string,string>")).alias("element_id", "contract"))
    return _project(each, contracts, texts.select(F.explode(F.from_json(F.concat(F.lit("["), "line", F.lit("]")), "array<string>")).alias("id")).where("id is not null"))


def _project(each: Callable[[str], DataFrame], contracts: DataFrame, notifying: DataFrame) -> Graph:
    kind = lambda c, names: F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), F.col(c)), F.lit(names[0]))
    places = F.transform(F.coalesce("SourceLocations", F.array().cast(_PLACES)), lambda p: F.struct(p.File.alias("file"), p.Line.alias("line"), p.Column.alias("column"))).alias("source_locations")
    parents = each("Children").select(F.col("ChildId").alias("Id"), F.col("ParentId").alias("parent_id"))
    elements = each("CodeElements").join(parents, "Id", "left").select(F.col("Id").alias("id"), kind("ElementType", ELEMENT_TYPES).alias("element_type"), F.col("Name").alias("name"), F.col("FullName").alias("full_name"), "parent_id", kind("AccessLevel", ACCESS_LEVELS).alias("access_level"), F.coalesce("IsExternal", F.lit(False)).alias("is_external"), F.coalesce("IsGenerated", F.lit(False)).alias("is_generated"), F.coalesce("Attributes", _empty("attributes")).alias("attributes"), places)
    relationships = canonical(each("Relationships").select(F.col("SourceId").alias("source_id"), F.col("TargetId").alias("target_id"), kind("Type", RELATIONSHIP_TYPES).alias("type"), F.coalesce("Attributes", F.lit(0)).alias("attributes"), places))
    metrics = each("MemberMetrics").select(F.col("ElementId").alias("element_id"), F.col("CodeLines").alias("code_lines"), F.col("CommentLines").alias("comment_lines"), F.col("LogicalLinesOfCode").alias("logical_lines_of_code"), F.col("CyclomaticComplexity").alias("cyclomatic_complexity"))
    return Graph(elements, relationships, metrics, contracts, notifying)


def read_documentation(spark: SparkSession, folder: str, assembly: str) -> Graph:
    """Graph of a documentation tool's XML: a file a compound, with members, bases and references.

    Classes, structs, unions and interfaces go below the namespaces of their
    names (split at `::` outside angle brackets); members below their compound.
    A reference to a method is a call and else a use; a base that is an interface
    is implemented and else inherited. Self edges and references to nothing go.
    """
    kinds = {"class": "Class", "struct": "Struct", "union": "Struct", "interface": "Interface", "enum": "Enum"}
    members = {"function": "Method", "variable": "Field", "enum": "Enum", "property": "Property", "event": "Event"}
    location = "location struct<_file:string,_line:int,_column:int>"
    ref = "array<struct<_refid:string,_VALUE:string>>"
    member = f"array<struct<memberdef:array<struct<_id:string,_kind:string,name:string,location:struct<_file:string,_line:int,_column:int>,references:{ref},type:struct<ref:{ref}>,param:array<struct<type:struct<ref:{ref}>>>>>>>"
    raw = spark.read.format("xml").option("rowTag", "compounddef").schema(f"_id string, _kind string, compoundname string, {location}, basecompoundref {ref}, sectiondef {member}").load(folder)
    mapped = lambda c, table: F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(c)]
    place = lambda c: F.when(F.col(c).isNull(), _empty("source_locations")).otherwise(F.array(F.struct(F.col(f"{c}._file").alias("file"), F.col(f"{c}._line").alias("line"), F.col(f"{c}._column").alias("column"))))
    # dots for separators outside angle brackets, so that a template's arguments stay in one name
    dotted = F.array_join(F.transform(F.split("compoundname", r"::(?![^<]*>)"), lambda p: F.translate(p, ".", "_")), ".")
    compounds = raw.withColumn("kind", mapped("_kind", kinds)).where("kind is not null").withColumn("full", F.concat(F.lit(assembly + "."), dotted))
    spaces = _chain(compounds.select(F.regexp_replace("full", r"\.[^.]*$", "").alias("name")).distinct(), "Namespace").withColumn("element_type", F.when(F.col("parent_id").isNull(), "Assembly").otherwise(F.col("element_type")))
    nested = compounds.select(F.col("full").alias("parent_full"), F.col("_id").alias("parent_ref"))
    row = lambda df, ident, kind, name, full, parent, where: df.select(ident.alias("id"), kind.alias("element_type"), name.alias("name"), full.alias("full_name"), parent.alias("parent_id"), F.lit("Unknown").alias("access_level"), F.lit(False).alias("is_external"), F.lit(False).alias("is_generated"), _empty("attributes").alias("attributes"), where.alias("source_locations"))
    c = F.col
    placed = compounds.withColumn("above", F.regexp_replace("full", r"\.[^.]*$", "")).join(nested, c("above") == c("parent_full"), "left")
    types = row(placed, c("_id"), c("kind"), F.element_at(F.split("full", r"\."), -1), c("full"), F.coalesce("parent_ref", "above"), place("location"))
    inner = compounds.select("_id", "full", F.explode("sectiondef").alias("s")).select(c("_id").alias("owner"), "full", F.explode("s.memberdef").alias("m")).select("owner", "full", "m.*").withColumn("kind", mapped("_kind", members)).where("kind is not null").dropDuplicates(["_id"])
    fields = row(inner, c("_id"), c("kind"), c("name"), F.concat_ws(".", "full", "name"), c("owner"), place("location"))
    taken = nested.select(c("parent_full").alias("id"))
    elements = spaces.join(taken, "id", "left_anti").unionByName(types).unionByName(fields)
    known = elements.select(c("id").alias("target_id"), "element_type")
    bases = compounds.select(c("_id").alias("source_id"), F.explode("basecompoundref").alias("b")).select("source_id", c("b._refid").alias("target_id")).join(known, "target_id").select("source_id", "target_id", F.when(c("element_type") == "Interface", "Implements").otherwise("Inherits").alias("type"))
    calls = inner.select(c("_id").alias("source_id"), F.explode("references").alias("b")).select("source_id", c("b._refid").alias("target_id")).join(known, "target_id").select("source_id", "target_id", F.when(c("element_type") == "Method", "Calls").otherwise("Uses").alias("type"))
    typed = inner.select(c("_id").alias("source_id"), F.explode(F.concat(F.coalesce("type.ref", F.array().cast(ref)), F.flatten(F.transform(F.coalesce(F.filter("param", lambda p: p.type.ref.isNotNull()), F.array().cast(f"array<struct<type:struct<ref:{ref}>>>")), lambda p: p.type.ref)))).alias("b")).select("source_id", c("b._refid").alias("target_id")).join(known, "target_id").select("source_id", "target_id", F.lit("Uses").alias("type"))
    edges = bases.unionByName(calls).unionByName(typed).where("source_id <> target_id").distinct()
    return Graph(elements, edges.select("source_id", "target_id", "type", F.lit(0).alias("attributes"), _empty("source_locations").alias("source_locations")))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """elements(id, name, type, parent) and relations(consumer, provider, type, weight) of a matrix XML; dotted names make the elements between, self relations go."""
    elements = spark.read.format("xml").option("rowTag", "element").schema("_id int, _name string, _type string").load(path)
    relations = spark.read.format("xml").option("rowTag", "relation").schema("_from int, _to int, _type string, _weight int").load(path)
    chain = _chain(elements.select(F.col("_name").alias("name")).distinct(), "Class")
    named = chain.join(elements, chain["full_name"] == elements["_name"], "left").select(chain["id"].alias("full_name"), F.col("_id").alias("id"), "name", F.coalesce("_type", F.lit("")).alias("type"), F.col("parent_id").alias("parent"))
    known = elements.select("_id")
    kept = relations.where("_from <> _to").join(known.withColumnRenamed("_id", "_from"), "_from", "left_semi").join(known.withColumnRenamed("_id", "_to"), "_to", "left_semi")
    return named, kept.select(F.col("_from").alias("consumer"), F.col("_to").alias("provider"), F.col("_type").alias("type"), F.coalesce("_weight", F.lit(1)).alias("weight"))


def excluded(name: Column, patterns: str) -> Column:
    """Whether any of the expressions, split at `;` and line ends, is found in a name."""
    found = [p.strip() for p in re.split(r"[;\n]", patterns) if p.strip()]
    return name.rlike("|".join(f"(?:{p})" for p in found)) if found else F.lit(False)


def one_project_per_assembly(projects: DataFrame) -> DataFrame:
    """Of (assembly, project, rank) the project of highest rank, the smaller name of equals."""
    w = Window.partitionBy("assembly").orderBy(F.desc("rank"), "project")
    return projects.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_edge_lines(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all JSON-lines files below a folder, lines that are no JSON left out."""
    schema = "id string, kind string, `from` string, `to` string, evidence_source string, status string, confidence double, path string, note string, meta map<string,string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)


def edge_counts(edges: DataFrame) -> DataFrame:
    """(evidence_source, kind, status, edges): how many edges there are of each."""
    return edges.groupBy("evidence_source", "kind", "status").agg(F.count("*").alias("edges"))


def external_elements(names: DataFrame) -> DataFrame:
    """Elements of another system's types, each name (name) and all it lies in once, marked as external."""
    return _chain(names.select("name").distinct(), "Class").withColumn("is_external", F.lit(True))


def type_graph(vertices: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Distinct (src, dst) of lists (src, targets) with both ends among (id), self edges left out: the form that measures take."""
    edges = adjacency.select("src", F.explode("targets").alias("dst")).where("src <> dst").distinct()
    for side in ("src", "dst"):
        edges = edges.join(vertices.select(F.col("id").alias(side)), side, "left_semi")
    return edges.select("src", "dst")
