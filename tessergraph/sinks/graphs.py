"""Writers of graphs: plain text, dumps, directed graph markup, matrix XML, class diagrams, tables and web graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import flag_names, is_type
from ..model import Graph
from ..operators.explore import bundled_edges


def _named(g: Graph) -> DataFrame:
    n = lambda c: g.elements.select(F.col("id").alias(f"{c}_id"), F.col("full_name").alias(f"{c}_name"))
    return g.relationships.join(n("source"), "source_id").join(n("target"), "target_id")


def plain_text(g: Graph) -> DataFrame:
    """(section, ord, line) of the plain-text form: elements by full name, each after its parent is known by name, then relationships; sort by section, ord and write the lines."""
    opt = lambda test, value: F.when(test, value)
    loc = lambda a: F.transform(a, lambda p: F.concat(F.lit("loc="), p.file, F.lit(":"), p.line, F.lit(","), p.column))
    e = g.elements.select(
        F.lit(0).alias("section"), F.concat_ws("\x1f", "full_name", "id").alias("ord"),
        F.concat_ws(" ", "element_type", "id", opt(F.col("name") != F.col("id"), F.concat(F.lit("name="), "name")), opt(F.col("full_name") != F.col("name"), F.concat(F.lit("full="), "full_name")), opt(F.col("parent_id").isNotNull(), F.concat(F.lit("parent="), "parent_id")), opt(F.col("is_external"), F.lit("external")), opt(F.col("access_level") != "Unknown", F.concat(F.lit("access="), "access_level")), opt(F.size("attributes") > 0, F.concat(F.lit("attr="), F.array_join(F.array_sort("attributes"), ",")))).alias("line"),
        loc("source_locations").alias("locs"),
    )
    names = F.regexp_replace(flag_names(F.col("attributes")), ", ", ",")
    r = _named(g).select(F.lit(1).alias("section"), F.concat_ws("\x1f", "source_name", "type", "target_name", "source_id", "target_id").alias("ord"), F.concat_ws(" ", "source_id", "type", "target_id", F.when(names != "", names)).alias("line"), loc("source_locations").alias("locs"))
    return e.unionByName(r).select("section", "ord", F.array_join(F.concat(F.array("line"), "locs"), "\n").alias("line"))


def write_plain_text(g: Graph, path: str) -> None:
    """One sorted file; the range-sorted parts are put together by the writer's single task at the end, as the form asks for one."""
    plain_text(g).orderBy("section", "ord").select("line").coalesce(1).write.text(path)


def debug_lines(g: Graph) -> DataFrame:
    e = g.elements.select(F.concat_ws(": ", "element_type", "full_name").alias("line"))
    r = _named(g).select(F.concat(F.col("source_name"), F.lit(" -("), "type", F.lit(")-> "), "target_name", F.when(F.col("attributes") != 0, F.concat(F.lit(" "), flag_names(F.col("attributes")))).otherwise("")).alias("line"))
    return e.unionByName(r)


def digest(lines: DataFrame) -> str:
    """A digest that doesn't depend on the order of lines: sums of two hashes and the number of rows."""
    r = lines.agg(F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("line", F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
    return f"{r['n']}:{r['a'] or 0}:{r['b'] or 0}"


def escape_xml(c: Column) -> Column:
    """Text for an attribute, characters that XML forbids left out."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def directed_graph(g: Graph, hierarchy: bool = True, relationships: bool = True) -> DataFrame:
    """(section, line) of directed graph markup; nodes are groups if they hold others, and links have labels unless their type is a plain dependency."""
    quiet = ("Calls", "Uses", "Creates", "Inherits", "Implements")
    holders = g.elements.select(F.col("parent_id").alias("id")).where("id is not null").distinct().withColumn("holds", F.lit(True))
    q = lambda c: F.concat(F.lit('"'), escape_xml(F.col(c)), F.lit('"'))
    nodes = g.elements.join(holders, "id", "left").select(F.lit(1).alias("section"), F.concat(F.lit("<Node Id="), q("id"), F.lit(" Label="), q("name"), F.lit(" Category="), q("element_type"), F.when(F.col("holds"), ' Group="Expanded"').otherwise(""), F.lit(" />")).alias("line"))
    parts = [nodes]
    if hierarchy:
        parts.append(g.elements.where("parent_id is not null").select(F.lit(2).alias("section"), F.concat(F.lit("<Link Source="), q("parent_id"), F.lit(" Target="), q("id"), F.lit(' Category="Contains" />')).alias("line")))
    if relationships:
        label = F.when(F.col("type").isin(*quiet), "").otherwise(F.concat(F.lit(" Label="), q("type")))
        parts.append(g.relationships.select(F.lit(3).alias("section"), F.concat(F.lit("<Link Source="), q("source_id"), F.lit(" Target="), q("target_id"), label, F.lit(" Category="), q("type"), F.lit(" />")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix_lines(g: Graph) -> DataFrame:
    """(section, line) of matrix XML: elements with numbers in the order of their full names, type dependencies of weight 1.

    Numbers come from sorted blocks: the rank within a block and the number of elements before it.
    """
    types = g.types.select("id", "full_name", "element_type")
    block = F.substring("full_name", 1, 8)
    before = types.groupBy(block.alias("block")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = types.withColumn("block", block).join(before, "block").select("id", "full_name", "element_type", (F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("full_name", "id"))).alias("number"))
    at = lambda c: numbered.select(F.col("id").alias(c), F.col("number").alias(f"{c}_n"))
    e = numbered.select(F.lit(1).alias("section"), F.concat(F.lit('<element id="'), "number", F.lit('" name="'), escape_xml(F.col("full_name")), F.lit('" type="'), "element_type", F.lit('" />')).alias("line"))
    r = g.type_edges.join(at("src"), "src").join(at("dst"), "dst").select(F.lit(2).alias("section"), F.concat(F.lit('<relation from="'), "src_n", F.lit('" to="'), "dst_n", F.lit('" type="Uses" weight="1" />')).alias("line"))
    return e.unionByName(r)


ARROWS = {"Inherits": (4, "--|>"), "Implements": (3, "..|>"), "Creates": (2, "-->"), "Calls": (2, "-->"), "Uses": (1, "..>")}


def class_diagram(g: Graph) -> DataFrame:
    """(section, line) of a class diagram. A member counts for all types it lies in; of parallel arrows the strongest stays."""
    alias = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9]", "_")
    kinds = F.when(F.col("element_type") == "Interface", "interface ").when(F.col("element_type") == "Enum", "enum ").otherwise("class ")
    nodes = g.types.select(F.lit(1).alias("section"), F.concat(kinds, F.lit('"'), "name", F.lit('" as '), alias("full_name")).alias("line"))
    own = g.paths.select("id", F.explode(F.filter(F.zip_with("path", "types", lambda i, t: F.struct(i.alias("i"), t.alias("t"))), lambda x: is_type(x.t))).alias("o")).select("id", F.col("o.i").alias("owner"))
    rank = F.create_map(*[F.lit(x) for k, (n, _) in ARROWS.items() for x in (k, n)])
    e = g.relationships.where(F.col("type").isin(*ARROWS)).join(own.select(F.col("id").alias("source_id"), F.col("owner").alias("s")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("owner").alias("t")), "target_id").where("s <> t")
    best = e.groupBy("s", "t").agg(F.max(rank[F.col("type")]).alias("rank"))
    arrow = F.when(F.col("rank") == 4, "--|>").when(F.col("rank") == 3, "..|>").when(F.col("rank") == 2, "-->").otherwise("..>")
    names = lambda c: g.types.select(F.col("id").alias(c), F.col("full_name").alias(f"{c}_name"))
    links = best.join(names("s"), "s").join(names("t"), "t").select(F.lit(2).alias("section"), F.concat_ws(" ", alias("s_name"), arrow, alias("t_name")).alias("line"))
    return nodes.unionByName(links)


def web_graph(g: Graph, visible: DataFrame) -> DataFrame:
    """One JSON text a node and a bundled edge: (kind, json)."""
    nodes = g.elements.join(visible.select("id").distinct(), "id", "left_semi").select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", "element_type", "parent_id")).alias("json"))
    edges = bundled_edges(g, visible).select(F.lit("edge").alias("kind"), F.to_json(F.struct("source_id", "target_id", "edges", "type")).alias("json"))
    return nodes.unionByName(edges)


def csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """A table with a header; quotes within a value are doubled, doubles have three decimals."""
    columns = [F.format_string("%.3f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)

