"""Fixed vocabularies of the graph model, and predicates over its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model, in their natural order.
ELEMENT_TYPES = ("Assembly", "Namespace", "Class", "Interface", "Struct", "Method", "Property", "PropertyAccessor", "Delegate", "Event", "Enum", "Field", "Record", "Other")
TYPE_KINDS = ("Class", "Interface", "Struct", "Record", "Enum", "Delegate")
NOT_DEPENDENCIES = ("Containment", "Bundled", "Handles")
CONFINED = ("Private", "Internal", "ProtectedAndInternal")
ACCESS_LEVELS = ("Unknown", "Private", "Protected", "Internal", "ProtectedAndInternal", "ProtectedOrInternal", "Public")
RELATIONSHIP_TYPES = ("Calls", "Creates", "Uses", "Inherits", "Implements", "Overrides", "Containment", "UsesAttribute", "Invokes", "Handles", "Bundled")
FLAGS = {"IsBaseCall": 1, "IsStaticCall": 2, "IsThisCall": 4, "IsInstanceCall": 8, "IsExtensionMethodCall": 16, "IsMethodGroup": 32, "EventRegistration": 64, "EventUnregistration": 128, "IsXamlReference": 256}
COLOURS = {"Method": "#569CD6", "Property": "#4677A2", "PropertyAccessor": "#4677A2", "Interface": "#B8D7A3", "Class": "#FFD700", "Record": "#FFD700", "Struct": "#FFA500", "Namespace": "#4EC9B0", "Enum": "#9370DB", "Field": "#D7BA7D", "Assembly": "#EEEEEE", "Event": "#FF69B4", "Delegate": "#C586C0"}
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyattributes.cs")


def ordinal(element_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in ELEMENT_TYPES]), element_type) - 1


def is_type(element_type: Column) -> Column:
    return element_type.isin(*TYPE_KINDS)


def is_dependency(kind: Column) -> Column:
    return ~kind.isin(*NOT_DEPENDENCIES)


def is_confined(access_level: Column) -> Column:
    return access_level.isin(*CONFINED)


def container_level(element_type: Column) -> Column:
    return F.when(element_type.isin("Assembly", "Namespace"), 30).when(is_type(element_type), 20).otherwise(0)


def has_flag(attributes: Column, name: str) -> Column:
    return attributes.bitwiseAND(FLAGS[name]) != 0


def dispatches_on_current_instance(attributes: Column) -> Column:
    how = attributes.bitwiseAND(31)
    return (how == 0) | (how.bitwiseAND(5) != 0)


def flag_names(attributes: Column) -> Column:
    """`[A, B]` of the flags set, empty if none is."""
    names = F.concat_ws(", ", *[F.when(has_flag(attributes, n), F.lit(n)) for n in FLAGS])
    return F.when(names == "", "").otherwise(F.concat(F.lit("["), names, F.lit("]")))


def is_generated_file(name: Column, first_lines: Column | None = None) -> Column:
    lower = F.lower(name)
    found = reduce(lambda a, b: a | b, [lower.endswith(s) for s in GENERATED_SUFFIXES]) | F.element_at(F.split(lower, r"[/\\]"), -1).startswith("temporarygeneratedfile_")
    return found if first_lines is None else found | F.lower(first_lines).contains("<auto-generated")


def relevant_for_cycles(kind: Column, source_type: Column, target_type: Column) -> Column:
    """Not event handling, nor a contract between two members of one kind, save that overriding properties counts."""
    same = lambda t: (source_type == t) & (target_type == t)
    contract = kind.isin("Implements", "Overrides") & (same("Method") | same("PropertyAccessor"))
    return (kind != "Handles") & ~contract & ~((kind == "Implements") & same("Property"))


def rating(value: Column, good: float, warning: float, higher_is_worse: bool = True) -> Column:
    better = (lambda limit: value <= limit) if higher_is_worse else (lambda limit: value >= limit)
    return F.when(better(good), "Good").when(better(warning), "Warning").otherwise("Bad")


def strip_type_parameters(name: Column) -> Column:
    return F.regexp_replace(name, "<[^<>]*>", "")


def colour(element_type: Column) -> Column:
    """Colour of an element in pictures, white for other kinds."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[element_type], F.lit("#FFFFFF"))


def has_extension(path: Column, *extensions: str) -> Column:
    """Whether a path ends, in any case, in one of the extensions; a filter of files."""
    return reduce(lambda a, b: a | b, [F.lower(path).endswith(e.lower()) for e in extensions], F.lit(False))


def row_filter(terms: str, *columns: Column) -> Column:
    """All words of `terms`, in any case, within the columns joined by blanks."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, b: a & b, [joined.contains(t) for t in terms.lower().split()], F.lit(True))
