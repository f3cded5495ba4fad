"""`python -m tessergraph RULES PROJECT`: checks a stored graph; exit code 0 clean, 1 violations, 2 error."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators import rules
from .sinks import reports
from .sources.graphs import read_project


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        with open(arguments[0], encoding="utf-8") as f:
            parsed = rules.parse(f.read())
        g = read_project(SparkSession.builder.getOrCreate(), arguments[1])
        outcome = rules.evaluate(g, parsed)
    except (OSError, rules.RuleError) as e:
        print(e, file=sys.stderr)
        return 2
    print(reports.text(outcome, g))
    return 0 if outcome.clean() else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
