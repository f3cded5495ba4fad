"""Dependency rules: DENY, ISOLATE, RESTRICT, ALLOW, NOCYCLES, MAXCYCLICITY and MAXLINES over a graph.

Rules are metadata: they are parsed on the driver, and patterns become frames of
element ids. A pattern is a full name, alone, with `.*` for its children, or
with `.**` for all below it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import strip_type_parameters
from ..model import Graph
from . import metrics
from .cycles import cycle_groups

EDGE_RULES, RANGE = ("DENY", "RESTRICT", "ALLOW"), (0.0, 100.0)


class RuleError(ValueError):
    """A line that is no rule; tells its number."""


@dataclass(frozen=True)
class Rule:
    keyword: str
    text: str
    line: int
    source: str = ""
    target: str = ""
    threshold: float = 0.0


def parse(text: str) -> list[Rule]:
    """The rules of a text. Keywords in any case, with a colon or blanks after them; `//` begins a comment."""
    out = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("//", 1)[0].strip()
        if not line:
            continue
        found = re.fullmatch(r"(?i)(deny|restrict|isolate|allow|nocycles|maxcyclicity|maxlines)\b[\s:]*(.*)", line)
        if not found:
            raise RuleError(f"line {number}: no rule: {line}")
        keyword, rest = found[1].upper(), found[2].strip()
        if keyword in EDGE_RULES:
            ends = re.fullmatch(r"(\S+)\s*->\s*(\S+)", rest)
            if not ends:
                raise RuleError(f"line {number}: {keyword} needs a source -> a target")
            out.append(Rule(keyword, line, number, ends[1], ends[2]))
        elif keyword in ("ISOLATE", "NOCYCLES"):
            if not rest or re.search(r"\s", rest) or (keyword == "NOCYCLES" and "*" in rest):
                raise RuleError(f"line {number}: {keyword} needs one {'path' if keyword == 'NOCYCLES' else 'pattern'}")
            out.append(Rule(keyword, line, number, rest))
        else:
            limit = re.fullmatch(r"(\S*)\s*=\s*([0-9]+(?:\.[0-9]+)?)", rest)
            if not limit or (keyword == "MAXCYCLICITY" and limit[1]):
                raise RuleError(f"line {number}: {keyword} needs = and a number" + " and has no scope" * (keyword == "MAXCYCLICITY"))
            value = float(limit[2])
            if keyword == "MAXCYCLICITY" and not RANGE[0] <= value <= RANGE[1]:
                raise RuleError(f"line {number}: {keyword} must be from {RANGE[0]:g} to {RANGE[1]:g}")
            out.append(Rule(keyword, line, number, limit[1], threshold=value))
    return out


def resolve(g: Graph, pattern: str) -> DataFrame:
    """Ids (column id) that a pattern stands for; none if it names nothing.

    A name without type parameters also matches generic ones; if nothing
    matches, the segment `global` after the first is tried or left out.
    """
    depth = 2 if pattern.endswith(".**") else 1 if pattern.endswith(".*") else 0
    name = pattern[: -3 if depth == 2 else -2] if depth else pattern
    head, _, tail = name.partition(".")
    toggled = head + ("." + tail[7:] if tail.startswith("global.") else "" if tail == "global" else f".global{'.' + tail if tail else ''}")
    for candidate in (name, toggled):
        field_ = F.col("full_name") if "<" in candidate else strip_type_parameters(F.col("full_name"))
        roots = g.elements.where((field_ == candidate) | (F.col("full_name") == candidate)).select("id")
        if not roots.isEmpty():
            if depth == 2:
                return g.subtree(roots).select("id").distinct()
            if depth == 1:
                return roots.unionByName(g.elements.join(roots.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")).distinct()
            return roots
    return g.elements.select("id").where("false")


@dataclass
class Outcome:
    """Violations by form: relationships (rule, source_id, target_id, type), elements (rule, id, value), cycles (rule, component, id), system values, and warnings."""

    violations: DataFrame
    elements: DataFrame
    cycles: DataFrame
    system: list[tuple[str, float]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def clean(self) -> bool:
        return not self.system and all(df.isEmpty() for df in (self.violations, self.elements, self.cycles))


def _inside(edges: DataFrame, side: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return edges.join(ids.select(F.col("id").alias(side)), side, how)


def evaluate(g: Graph, rules: list[Rule]) -> Outcome:
    """Applies all rules: exceptions first, then edge rules, cycles, and limits."""
    warnings: list[str] = []
    edges = g.deps.select("source_id", "target_id", "type")
    own = _inside(edges, "target_id", g.elements.where("not is_external"))
    named: dict[str, DataFrame] = {}

    def ids(pattern: str) -> DataFrame:
        if pattern not in named:
            named[pattern] = resolve(g, pattern)
            if named[pattern].isEmpty():
                warnings.append(f"nothing matches {pattern}")
        return named[pattern]

    found: list[DataFrame] = []
    note = lambda df, text: found.append(df.select(F.lit(text).alias("rule"), "source_id", "target_id", "type"))
    for r in rules:
        if r.keyword == "DENY":
            note(_inside(_inside(edges, "source_id", ids(r.source)), "target_id", ids(r.target)), r.text)
        elif r.keyword == "ISOLATE":
            note(_inside(_inside(own, "source_id", ids(r.source)), "target_id", ids(r.source), "left_anti"), r.text)
    for group in _restrict_groups([r for r in rules if r.keyword == "RESTRICT"], ids):
        sources = _union([ids(r.source) for r in group])
        allowed = sources.unionByName(_union([ids(r.target) for r in group])).distinct()
        note(_inside(_inside(own, "source_id", sources), "target_id", allowed, "left_anti"), "; ".join(r.text for r in group))
    broken = found[0].where("false") if found else edges.select(F.lit("").alias("rule"), "source_id", "target_id", "type").where("false")
    for df in found:
        broken = broken.unionByName(df)
    for r in rules:
        if r.keyword == "ALLOW":
            pair = _inside(_inside(edges, "source_id", ids(r.source)), "target_id", ids(r.target)).select("source_id", "target_id").distinct()
            broken = broken.join(pair, ["source_id", "target_id"], "left_anti").select("rule", "source_id", "target_id", "type")

    over = g.elements.select(F.lit("").alias("rule"), "id", F.lit(0).alias("value")).where("false")
    for r in (r for r in rules if r.keyword == "MAXLINES"):
        if g.metrics is None:
            warnings.append("no metrics to compare with MAXLINES")
            continue
        methods = g.elements.where("element_type = 'Method'").select("id")
        methods = methods.join(ids(r.source), "id", "left_semi") if r.source else methods
        over = over.unionByName(g.metrics.select(F.col("element_id").alias("id"), "code_lines").join(methods, "id", "left_semi").where(F.col("code_lines") > r.threshold).select(F.lit(r.text).alias("rule"), "id", F.col("code_lines").alias("value")))
    cycles = g.elements.select(F.lit("").alias("rule"), F.col("id").alias("component"), "id").where("false")
    for r in (r for r in rules if r.keyword == "NOCYCLES"):
        below = g.subtree(ids(r.source)).select("id").distinct().withColumn("in", F.lit(True))
        kinds = g.elements.select("id", F.col("element_type").isin("Assembly", "Namespace", "Class", "Interface", "Struct", "Record", "Enum", "Delegate").alias("container"))
        held = cycle_groups(g).join(below, "id", "left").join(kinds, "id").groupBy("component").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("whole"), F.bool_or("container").alias("high")).where("whole and high").select("component")
        cycles = cycles.unionByName(cycle_groups(g).join(held, "component", "left_semi").select(F.lit(r.text).alias("rule"), "component", "id"))
    system = []
    limits = [r for r in rules if r.keyword == "MAXCYCLICITY"]
    if limits:
        value = 100 * metrics.system_metrics(g).first()["cyclicity"]
        system = [(r.text, value) for r in limits if value > r.threshold + 1e-9]
    return Outcome(broken, over, cycles, system, list(dict.fromkeys(warnings)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.distinct()


def _restrict_groups(rules: list[Rule], ids) -> list[list[Rule]]:
    """Rules whose sources share an element belong together, through others as well. There are few rules, so pairs are looked at one by one."""
    groups: list[list[Rule]] = []
    for r in rules:
        near = [x for x in groups if any(o.source == r.source or not ids(o.source).join(ids(r.source), "id", "left_semi").isEmpty() for o in x)]
        groups = [x for x in groups if x not in near] + [[*(o for x in near for o in x), r]]
    return groups


def baseline(g: Graph, rules: list[Rule]) -> str:
    """ALLOW lines, under a comment for each rule, that freeze today's violations; a system limit is raised to today's value."""
    outcome = evaluate(g, rules)
    names = g.elements.select("id", "full_name")
    rows = outcome.violations.join(names.select(F.col("id").alias("source_id"), F.col("full_name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("full_name").alias("t")), "target_id")
    out, last = [], None
    for r in rows.groupBy("s", "t").agg(F.min("rule").alias("rule")).orderBy("rule", "s", "t").toLocalIterator():
        if r["rule"] != last:
            out.append(f"// {r['rule']}")
            last = r["rule"]
        out.append(f"ALLOW {r['s']} -> {r['t']}")
    for _, value in outcome.system:
        out.append(f"MAXCYCLICITY = {min(RANGE[1], math.ceil(round(value * 100, 6)) / 100):g}")
    return "\n".join(out)


def generate(g: Graph) -> str:
    """Rules that describe the assemblies as they are: ISOLATE without a dependency, else RESTRICT for each."""
    names = {r["id"]: r["full_name"] for r in g.elements.where("element_type = 'Assembly' and not is_external").select("id", "full_name").collect()}
    to: dict[str, set[str]] = {}
    for r in g.assembly_edges.collect():
        to.setdefault(names[r["src"]], set()).add(names[r["dst"]])
    lines = []
    for name in sorted(names.values(), key=lambda n: (n.lower(), n)):
        lines += [f"RESTRICT {name}.** -> {t}.**" for t in sorted(to.get(name, ()), key=lambda n: (n.lower(), n))] or [f"ISOLATE {name}.**"]
    return "\n".join(lines)


def remove_unused(g: Graph, text: str) -> str:
    """The text without rules whose patterns name nothing (of RESTRICT the source only); comments and lines that are no rule stay."""
    out = []
    for line in text.splitlines():
        try:
            found = parse(line)
        except RuleError:
            found = []
        patterns = [p for r in found for p in ((r.source,) if r.keyword == "RESTRICT" else (r.source, r.target)) if p]
        if all(not resolve(g, p).isEmpty() for p in patterns):
            out.append(line)
    return "\n".join(out)


def fingerprints(violations: DataFrame, g: Graph) -> DataFrame:
    """Violations with both ends' full names and a fingerprint that is stable across runs: 32 hex digits of SHA-256 over rule, names and type."""
    names = g.elements.select("id", "full_name")
    rows = violations.join(names.select(F.col("id").alias("source_id"), F.col("full_name").alias("source_name")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("full_name").alias("target_name")), "target_id")
    return rows.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "rule", "source_name", "target_name", "type"), 256), 1, 32))


def gate(g: Graph, text: str) -> int:
    """Exit code of a check: 0 clean, 1 violations, 2 if the rules can't be read."""
    try:
        rules = parse(text)
    except RuleError:
        return 2
    return 0 if evaluate(g, rules).clean() else 1
