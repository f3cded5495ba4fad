"""Reports of violations: text, and SARIF 2.1 for code scanners."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import functions as F

from ..model import Graph
from ..operators.rules import Outcome, fingerprints

CYCLE_LOCATIONS = 25


def text(outcome: Outcome, g: Graph) -> str:
    """Warnings, then each rule with its violations. A report is read by people, so its rows come to the driver one at a time."""
    out = [f"warning: {w}" for w in outcome.warnings]
    last = None
    for r in fingerprints(outcome.violations, g).orderBy("rule", "source_name", "target_name", "type").toLocalIterator():
        if r["rule"] != last:
            out.append(r["rule"])
            last = r["rule"]
        out.append(f"  {r['source_name']} -> {r['target_name']} ({r['type']})")
    names = g.elements.select("id", "full_name")
    for r in outcome.elements.join(names, "id").orderBy("rule", F.desc("value"), "full_name").toLocalIterator():
        out.append(f"{r['rule']}: {r['full_name']} has {r['value']}")
    for r in outcome.cycles.join(names, "id").groupBy("rule", "component").agg(F.array_sort(F.collect_list("full_name")).alias("n")).orderBy("rule", "component").toLocalIterator():
        out.append(f"{r['rule']}: cycle of {len(r['n'])}: {', '.join(r['n'][:CYCLE_LOCATIONS])}")
    out += [f"{rule}: {value:.2f}" for rule, value in outcome.system]
    return "\n".join(out)


def uri(path: str, root: str = "") -> str:
    """A location below the root as a relative, escaped address."""
    plain = path.replace("\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/" if root else ""
    return quote(plain[len(base) :] if base and plain.lower().startswith(base.lower()) else plain)


def sarif(outcome: Outcome, g: Graph, root: str = "") -> str:
    """One result a violating edge, element or cycle, ordered by source, target and type; rules are numbered as they first appear; warnings become notifications."""
    results, rules = [], {}

    def result(rule: str, message: str, mark: str, places: list[str]) -> None:
        k = rules.setdefault(rule, len(rules))
        results.append({"ruleId": rule.split()[0], "ruleIndex": k, "level": "error", "message": {"text": message}, "partialFingerprints": {"primary": mark}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri(p, root)}}} for p in places]})

    place = g.elements.select(F.col("id").alias("source_id"), F.get(F.col("source_locations"), F.lit(0))["file"].alias("file"))
    for r in fingerprints(outcome.violations, g).join(place, "source_id", "left").orderBy("source_name", "target_name", "type").toLocalIterator():
        result(r["rule"], f"{r['source_name']} {r['type']} {r['target_name']}", r["fingerprint"], [r["file"]] if r["file"] else [])
    mark = F.substring(F.sha2(F.concat_ws("|", "rule", "name"), 256), 1, 32).alias("mark")
    names = g.elements.select("id", F.col("full_name").alias("name"))
    for r in outcome.elements.join(names, "id").withColumn("mark", mark).orderBy("name").toLocalIterator():
        result(r["rule"], f"{r['name']} has {r['value']}", r["mark"], [])
    for r in outcome.cycles.join(names, "id").groupBy("rule", "component").agg(F.array_sort(F.collect_list("name")).alias("members")).withColumn("name", F.array_join("members", "|")).withColumn("mark", mark).orderBy("rule", "component").toLocalIterator():
        result(r["rule"], f"cycle of {len(r['members'])}: {', '.join(r['members'][:CYCLE_LOCATIONS])}", r["mark"], [])
    listed = [{"id": text_.split()[0], "shortDescription": {"text": text_}} for text_ in rules]
    run = {"tool": {"driver": {"name": "tessergraph", "rules": listed}}, "results": results, "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "warning", "message": {"text": w}} for w in outcome.warnings]}]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=1)
