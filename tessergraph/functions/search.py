"""The search language as a Column: `|` is or, blanks are and, a leading `-` negates its term.

A term is `type:<kind>`, `source:intern|extern|generated`, a camel-hump pattern
(if it holds a capital) or a part of the name in any case. No term matches nothing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import ELEMENT_TYPES

_KINDS = {t.lower(): t for t in ELEMENT_TYPES}


def camel_hump(term: str) -> str:
    """Humps may be followed by lower-case letters and digits: `FoB` finds FooBar."""
    humps = re.split(r"(?=[A-Z])", term)
    return "[a-z0-9]*".join(re.escape(h) for h in humps if h)


def _term(text: str, field: Column) -> Column:
    key, _, value = text.partition(":")
    if key.lower() == "type" and ":" in text:  # a missing or unknown kind is Other
        return F.col("element_type") == _KINDS.get(value.lower(), "Other")
    if key.lower() == "source" and value.lower() in ("intern", "extern", "generated"):
        return {"intern": ~F.col("is_external"), "extern": F.col("is_external"), "generated": F.col("is_generated")}[value.lower()]
    if re.search("[A-Z]", text):
        return field.rlike(camel_hump(text))
    return F.lower(field).contains(text)


def compile_search(text: str, field: str = "full_name", negation: bool = True) -> Column:
    """The predicate of a search text. A null field never matches, negated or not."""
    column = F.col(field)
    either = []
    for part in text.split("|"):
        terms = part.split()
        if terms:
            every = [~_term(t[1:], column) if negation and t[0] == "-" and len(t) > 1 else _term(t, column) for t in terms]
            either.append(reduce(lambda a, b: a & b, every))
    return column.isNotNull() & (reduce(lambda a, b: a | b, either) if either else F.lit(False))


def ranked(elements, limit: int = 50):
    """Matches, own code first, then by kind, then by full name."""
    from .predicates import ordinal

    return elements.orderBy("is_external", ordinal(F.col("element_type")), "full_name", "id").limit(max(1, min(limit, 200)))
