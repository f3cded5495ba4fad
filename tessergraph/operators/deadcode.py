"""Elements that nothing refers to, by marking what dependencies reach and passing marks on through contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_confined, is_type
from ..model import Graph
from ..plans.fixpoint import reach
from ..plans.storage import materialize

# Attributes (each also with the ending `Attribute`) that mark tests and types that a serializer reads, and those that speak to
# tools only and say nothing about callers. Tests and tools go by exact case, serializers by any.
TEST_ATTRIBUTES = ("Test", "TestCase", "TestCaseSource", "TestFixture", "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown", "Fact", "Theory", "TestMethod", "DataTestMethod", "TestClass", "TestInitialize", "TestCleanup", "ClassInitialize", "ClassCleanup", "Benchmark")
TOOLING_ATTRIBUTES = ("Obsolete", "Flags", "AttributeUsage", "Conditional", "MethodImpl", "CLSCompliant", "DebuggerDisplay", "DebuggerStepThrough", "DebuggerHidden", "DebuggerNonUserCode", "DebuggerBrowsable", "DebuggerTypeProxy", "ExcludeFromCodeCoverage", "SuppressMessage", "EditorBrowsable", "GeneratedCode")
SERIALIZED = ("Serializable", "DataContract", "JsonObject", "JsonConverter", "XmlRoot", "XmlType", "ProtoContract", "MessagePackObject")
HINTS = {"EntryPoint": 1, "Attributed": 4, "ContractNeverCalled": 8, "ImplementsDeadContract": 16, "ImplementsExternalContract": 32, "UsedOnlyByTests": 64, "Generated": 128}


def _among(attribute: Column, names: tuple[str, ...], any_case: bool = False) -> Column:
    plain = F.regexp_replace(F.lower(attribute), "attribute$", "") if any_case else F.regexp_replace(attribute, "Attribute$", "")
    return plain.isin(*[n.lower() for n in names] if any_case else names)


def _has(names: tuple[str, ...], any_case: bool = False) -> Column:
    return F.exists("attributes", lambda a: _among(a, names, any_case))


def in_tests(g: Graph) -> DataFrame:
    """Ids of all elements in test types: every type on the path of an element that a test attribute marks."""
    kinds = F.zip_with("path", "types", lambda i, t: F.struct(i.alias("id"), t.alias("type")))
    tests = g.elements.where(_has(TEST_ATTRIBUTES)).select("id")
    types = g.paths.join(tests, "id", "left_semi").select(F.explode(F.filter(kinds, lambda x: is_type(x.type))).alias("x")).select("x.id").distinct()
    return g.subtree(types).select("id").distinct()


def public_properties_of(g: Graph, types: DataFrame) -> DataFrame:
    """Ids of public properties whose containing type is among the ids, and of their public accessors."""
    near = g.paths.join(types.select(F.col("id").alias("containing_type")), "containing_type", "left_semi").select("id")
    properties = g.elements.where("element_type = 'Property' and access_level = 'Public'").join(near, "id", "left_semi").select("id")
    accessors = g.elements.where("element_type = 'PropertyAccessor' and access_level = 'Public'").join(properties.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    return properties.unionByName(accessors)


def references(g: Graph, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, production, by_tests) of everything referred to: whether production code does, and the test elements that do; and the contract edges (source_id, target_id, outside, contract).

    An edge reaches all of its target's path that isn't on its source's. Contracts
    between members reach nothing by themselves: who refers to one refers to all
    implementations, with their whole paths. One pass over the edges marks both
    sets, and one loop passes both on.
    """
    p = g.paths.select("id", "path", "element_type", "is_external")
    end = lambda side, short: p.select(F.col("id").alias(side), F.col("path").alias(short), F.col("element_type").alias(f"{short}_kind"), F.col("is_external").alias(f"{short}_external"))
    both = g.deps.select("source_id", "target_id", "type").distinct().join(end("source_id", "s"), "source_id").join(end("target_id", "t"), "target_id")
    both = both.join(tests.select(F.col("id").alias("source_id"), F.lit(True).alias("test")), "source_id", "left")
    both = materialize(both.withColumn("contract", F.col("type").isin("Implements", "Overrides") & ~is_type(F.col("s_kind"))), "marking")
    reached = both.where("not contract").select(F.explode(F.array_except("t", "s")).alias("id"), "source_id", "test")
    direct = materialize(reached.groupBy("id").agg(F.bool_or(F.col("test").isNull()).alias("production"), F.array_sort(F.collect_set(F.when(F.col("test"), F.col("source_id")))).alias("by_tests")), "marked")
    names = g.elements.select(F.col("id").alias("target_id"), F.col("full_name").alias("contract_name"))
    contracts = both.where("contract").join(names, "target_id").select("source_id", "target_id", (F.col("t_external") | is_type(F.col("t_kind"))).alias("outside"), "contract_name")
    contracts = materialize(contracts.distinct(), "contracts")
    passes = contracts.where("not outside").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    seeds = direct.join(passes.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    starts = seeds.select(F.lit(0).alias("origin"), F.col("id").alias("node")).unionByName(seeds.where("production").select(F.lit(1).alias("origin"), F.col("id").alias("node")))
    through = reach(passes, starts).join(p.select(F.col("id").alias("node"), "path"), "node").select(F.explode("path").alias("id"), (F.col("origin") == 1).alias("production"))
    every = direct.select("id", "production").unionByName(through).groupBy("id").agg(F.bool_or("production").alias("production"))
    return materialize(every.join(direct.select("id", "by_tests"), "id", "left"), "referred"), contracts


def dead_code(g: Graph) -> DataFrame:
    """Unused elements, of nested ones the outermost: id, full_name, hints (bits as in `HINTS`), confidence, and as evidence the attributes of the subtree, the external contract, related members (contracts and implementations) and test references, each list sorted and joined by commas."""
    tests = materialize(in_tests(g), "tests")
    referred, contracts = references(g, tests)
    production = referred.where("production").select("id")
    candidate = g.elements.where("not is_external and element_type not in ('Assembly', 'Namespace') and not (element_type = 'Method' and name in ('.cctor', 'Finalize'))")
    reported = materialize(candidate.join(tests, "id", "left_anti").join(production, "id", "left_anti"), "unused")
    serialized = public_properties_of(g, g.elements.where(is_type(F.col("element_type")) & _has(SERIALIZED, True)).select("id"))
    outer = reported.join(reported.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").join(serialized, "id", "left_anti")

    inside = contracts.where("not outside")
    implemented = inside.groupBy(F.col("target_id").alias("id")).agg(F.collect_set("source_id").alias("implementations"))
    implements = inside.groupBy(F.col("source_id").alias("id")).agg(F.collect_set("target_id").alias("contracts"))
    outside = contracts.where("outside").groupBy(F.col("source_id").alias("id")).agg(F.min("contract_name").alias("from_edges"))
    recorded = (g.contracts.select(F.col("element_id").alias("id"), F.col("contract").alias("recorded")) if g.contracts is not None else outside.select("id", F.col("from_edges").alias("recorded")).where("false")).groupBy("id").agg(F.min("recorded").alias("recorded"))
    external = recorded.join(outside, "id", "full").select("id", F.coalesce("recorded", "from_edges").alias("external_contract"))
    of_subtree = g.subtree(outer.select("id")).join(g.elements.select("id", "name", "attributes", "element_type"), "id").groupBy(F.col("root").alias("id")).agg(
        F.bool_or((F.col("element_type") == "Method") & (F.col("name") == "Main")).alias("entry"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attributes")))).alias("attributes")
    )
    levels = g.elements.select(F.col("id").alias("above"), is_confined(F.col("access_level")).alias("confined"))
    confined = g.paths.select("id", F.explode("path").alias("above")).join(levels, "above").groupBy("id").agg(F.bool_or("confined").alias("confined"))
    bindable = (public_properties_of(g, g.notifying) if g.notifying is not None else g.elements.select("id").where("false")).withColumn("bindable", F.lit(True))

    rows = outer.select("id", "full_name", "is_generated").join(of_subtree, "id").join(confined, "id")
    for more in (implemented, implements, external, referred.select("id", F.coalesce("by_tests", F.array().cast("array<string>")).alias("by_tests")), bindable):
        rows = rows.join(more, "id", "left")
    bit = lambda test, name: F.when(test, HINTS[name]).otherwise(0)
    attributed = F.exists("attributes", lambda a: ~_among(a, TOOLING_ATTRIBUTES))
    hints = bit(F.col("entry"), "EntryPoint") + bit(attributed, "Attributed") + bit(F.col("implementations").isNotNull(), "ContractNeverCalled") + bit(F.col("contracts").isNotNull(), "ImplementsDeadContract")
    hints = hints + bit(F.col("external_contract").isNotNull(), "ImplementsExternalContract") + bit(F.col("by_tests").isNotNull(), "UsedOnlyByTests") + bit(F.col("is_generated"), "Generated")
    low = HINTS["EntryPoint"] | HINTS["Attributed"] | HINTS["ImplementsExternalContract"]
    high = F.col("confined") & F.col("bindable").isNull() & F.col("by_tests").isNull()
    none = F.array().cast("array<string>")
    related = F.array_sort(F.array_union(F.coalesce("contracts", none), F.coalesce("implementations", none)))
    return rows.withColumn("hints", hints.cast("int")).select(
        "id", "full_name", "hints", F.when(F.col("hints").bitwiseAND(low) != 0, "Low").when(high, "High").otherwise("Medium").alias("confidence"),
        F.array_join("attributes", ",").alias("attributes"), "external_contract", F.array_join(related, ",").alias("related"), F.array_join(F.coalesce("by_tests", none), ",").alias("test_references"),
    )
