"""Smaller readers: markup references to types, and reports of rule checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import FLAGS, is_type
from ..model import Graph, canonical

_TAG = r"<(?:([A-Za-z_]\w*):)?([A-Z]\w*)"
_EXTENSION = r"\{x:(?:Static|Type)\s+(?:([A-Za-z_]\w*):)?([A-Z]\w*)"


def link_markup(g: Graph, files: DataFrame) -> Graph:
    """Adds uses of types by interface markup: (owner_id, text), tags and `{x:Type ..}` or `{x:Static ..}` by namespace prefix.

    A prefix declared as `clr-namespace:A.B` names the type `A.B.Name` (at the end of
    its full name); without one the name must be that of one type only.
    """
    both = F.concat(F.regexp_extract_all("text", F.lit(_TAG), F.lit(0)), F.regexp_extract_all("text", F.lit(_EXTENSION), F.lit(0)))
    used = files.select("owner_id", "text", F.explode(F.array_distinct(both)).alias("m"))
    used = used.select("owner_id", "text", F.regexp_extract("m", r"(?:<|\s)(?:([A-Za-z_]\w*):)?([A-Z]\w*)$", 1).alias("prefix"), F.regexp_extract("m", r"([A-Z]\w*)$", 1).alias("name"))
    declared = files.select("owner_id", F.explode(F.regexp_extract_all("text", F.lit(r"xmlns:[A-Za-z_]\w*=\"clr-namespace:[\w.]+"), F.lit(0))).alias("d")).select("owner_id", F.regexp_extract("d", r"xmlns:(\w+)=", 1).alias("prefix"), F.regexp_extract("d", r"clr-namespace:([\w.]+)", 1).alias("space")).distinct()
    types = g.elements.where(is_type(F.col("element_type"))).select(F.col("id").alias("target_id"), F.col("name"), "full_name")
    named = used.drop("text").distinct().join(declared, ["owner_id", "prefix"], "left").join(types, "name")
    exact = named.where("space is not null and (full_name = concat(space, '.', name) or endswith(full_name, concat('.', space, '.', name)))").select("owner_id", "name", "prefix", "target_id")
    single = types.groupBy("name").agg(F.count("*").alias("n"), F.first("target_id").alias("target_id")).where("n = 1").drop("n")
    rest = used.drop("text").distinct().join(exact, ["owner_id", "prefix", "name"], "left_anti").join(single, "name").select("owner_id", "name", "prefix", "target_id")
    place = F.array().cast(g.relationships.schema["source_locations"].dataType)
    new = exact.unionByName(rest).select(F.col("owner_id").alias("source_id"), "target_id", F.lit("Uses").alias("type"), F.lit(FLAGS["IsXamlReference"]).alias("attributes"), place.alias("source_locations")).where("source_id <> target_id")
    return Graph(g.elements, canonical(g.relationships.unionByName(new.select(*g.relationships.columns))), g.metrics, g.contracts, g.notifying)


def parse_report(text: str) -> list[dict]:
    """Violations of a text report as rows with an id: the first 16 hex digits of SHA-1 over rule, source and target."""
    import hashlib

    out, rule = [], ""
    for line in text.splitlines():
        arrow = re.fullmatch(r"\s+(\S+) -> (\S+)(?: \((\w+)\))?", line)
        if arrow:
            mark = hashlib.sha1("|".join((rule, arrow[1], arrow[2])).encode()).hexdigest()[:16]
            out.append({"id": mark, "rule": rule, "source": arrow[1], "target": arrow[2], "type": arrow[3]})
        elif line.strip() and not line.startswith("warning:"):
            rule = line.strip()
    return out
