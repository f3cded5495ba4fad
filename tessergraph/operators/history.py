"""Mining of change histories: artifacts, change coupling, hotspots, ownership and roll-ups.

Frames: change_sets(id, committer, date), items(change_set_id, id, kind, path),
contributions(path, developer, lines). Paths compare in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"None": 1, "Add": 2, "Edit": 4, "Copy": 8, "Rename": 16, "Delete": 32, "Branch": 128, "Merge": 256, "TypeChanged": 512}


def artifacts(change_sets: DataFrame, items: DataFrame, accepted: Column | None = None) -> DataFrame:
    """id, path, commits, committers and date; the newest item of an id decides its path and whether it is deleted or filtered out."""
    rows = items.join(change_sets.select(F.col("id").alias("change_set_id"), "committer", "date"), "change_set_id")
    newest = F.struct("date", "change_set_id", F.struct("path", "kind").alias("last"))
    out = rows.groupBy("id").agg(F.max(newest).alias("m"), F.count("*").alias("commits"), F.count_distinct("committer").alias("committers")).select("id", "m.last.path", "m.last.kind", "m.date", "commits", "committers")
    out = out.where(F.col("kind").bitwiseAND(KINDS["Delete"]) == 0)
    return (out if accepted is None else out.where(accepted)).select("id", "path", "commits", "committers", "date")


def only_files(items: DataFrame, accepted: DataFrame | None = None, *filters: Column) -> DataFrame:
    """Items that pass all filters, and whose path, in any case, is in (path) if that is given."""
    for f in filters:
        items = items.where(f)
    return items if accepted is None else items.withColumn("_p", F.lower("path")).join(accepted.select(F.lower("path").alias("_p")), "_p", "left_semi").select(*items.columns)


def _coupled(rows: DataFrame, first_counts_none: bool) -> DataFrame:
    """rows: distinct (change_set_id, key). The counter of a pair begins at 0 on first sight if so asked, so it is one short."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    a, b = rows.select("change_set_id", F.col("key").alias("item1")), rows.select("change_set_id", F.col("key").alias("item2"))
    pairs = a.join(b, "change_set_id").where("item1 < item2").groupBy("item1", "item2").agg((F.count("*") - int(first_counts_none)).alias("couplings"))
    both = pairs.join(counts.select(F.col("key").alias("item1"), F.col("n").alias("n1")), "item1").join(counts.select(F.col("key").alias("item2"), F.col("n").alias("n2")), "item2")
    degree = F.bround(100.0 * F.col("couplings") / (F.col("n1") + F.col("n2") - F.col("couplings")), 2)
    return both.select("item1", "item2", F.col("couplings").cast("long").alias("couplings"), degree.alias("degree"))


def change_couplings(items: DataFrame, least: int = 20, degree: float = 20.0, largest: int = 300, compat: bool = True) -> DataFrame:
    """Pairs of files changed together. Change sets over `largest` items don't count, which bounds the pairs of each."""
    sized = items.groupBy("change_set_id").agg(F.count("*").alias("n")).where(F.col("n") <= largest)
    rows = items.join(sized, "change_set_id", "left_semi").select("change_set_id", F.col("id").alias("key")).distinct()
    return _coupled(rows, compat).where((F.col("couplings") >= least) & (F.col("degree") >= degree))


def classified_couplings(items: DataFrame, classifier: Column, compat: bool = True) -> DataFrame:
    """Couplings of classes of files; a change set counts each class once, no threshold."""
    rows = items.select("change_set_id", classifier.alias("key")).where("key is not null and key <> ''").distinct()
    return _coupled(rows, compat)


def fractal_values(contributions: DataFrame) -> DataFrame:
    """path and 1 - sum of squared shares of its developers: 0 is one owner."""
    total = F.sum("lines").over(Window.partitionBy("path"))
    return contributions.withColumn("share", F.try_divide(F.col("lines"), total)).groupBy("path").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("fractal"))


def main_developers(contributions: DataFrame) -> DataFrame:
    """path, developer with most lines (the smaller name of equals) and their percentage."""
    best = contributions.groupBy("path").agg(F.max_by("developer", F.struct("lines", F.lit(0))).alias("_"), F.max("lines").alias("most"), F.sum("lines").alias("total")).drop("_")
    named = contributions.join(best, "path").where("lines = most").groupBy("path", "most", "total").agg(F.min("developer").alias("developer"))
    return named.select("path", "developer", F.coalesce(F.try_divide(100.0 * F.col("most"), F.col("total")), F.lit(0.0)).alias("percent"))


def by_alias(contributions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Contributions summed by alias(developer, alias); a developer without one stands for themselves."""
    return contributions.join(aliases, "developer", "left").groupBy("path", F.coalesce("alias", "developer").alias("developer")).agg(F.sum("lines").alias("lines"))


def developers(change_sets: DataFrame, contributions: DataFrame) -> DataFrame:
    return change_sets.select(F.col("committer").alias("developer")).unionByName(contributions.select("developer")).where("trim(developer) <> ''").distinct()


def hotspots(summary: DataFrame, code: DataFrame, least_code: int = 2, least_commits: int = 2) -> DataFrame:
    """path, commits, code and hotspot (product of both, each scaled over all artifacts; null if a range is zero) of artifacts of some size.

    The ranges are one row, joined as such.
    """
    sized = summary.join(code.select(F.lower("path").alias("_p"), "code"), F.lower("path") == F.col("_p"), "left").withColumn("code", F.coalesce("code", F.lit(0)))
    r = sized.agg(*[f(c).alias(f"{n}_{c}") for c in ("commits", "code") for n, f in (("low", F.min), ("high", F.max))])
    part = lambda c: F.try_divide((F.col(c) - F.col(f"low_{c}")).cast("double"), (F.col(f"high_{c}") - F.col(f"low_{c}")).cast("double"))
    scored = sized.join(F.broadcast(r), F.lit(True)).withColumn("hotspot", part("commits") * part("code"))
    return scored.where((F.col("code") >= least_code) & (F.col("commits") >= least_commits)).select("path", "commits", F.col("code").cast("long").alias("code"), "hotspot")


def knowledge(code: DataFrame, contributions: DataFrame, only: str | None = None) -> DataFrame:
    """path, area and colour key (the main developer, or only the chosen one) of files that have lines."""
    mains = main_developers(contributions).select(F.lower("path").alias("_p"), "developer")
    rows = code.where("code >= 1").join(mains, F.lower("path") == F.col("_p"), "left")
    name = F.coalesce("developer", F.lit(""))
    return rows.select("path", F.col("code").cast("double").alias("area"), (name if only is None else F.when(name == only, name).otherwise("")).alias("colour"))


def roll_up(leaves: DataFrame) -> DataFrame:
    """Sums of the areas of (path, area) leaves for each folder and leaf: node, area, leaves. Leaves without an area are pruned, and so are folders of such only."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return leaves.where("area > 0").select(F.explode(prefixes).alias("node"), "area").groupBy("node").agg(F.sum("area").alias("area"), F.count("*").alias("leaves"))


def normalized_weights(leaves: DataFrame) -> DataFrame:
    """path, rank percentile of weight (ties get their mean rank, a single leaf 0.5) and square-rooted share of its range (0.5 for none).

    Ranks come from counts of equal weights and a running sum over distinct weights, a table far smaller than the leaves.
    """
    counts = leaves.groupBy("weight").agg(F.count("*").alias("k"))
    ranked = counts.withColumn("below", F.coalesce(F.sum("k").over(Window.orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = counts.agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.sum("k").alias("n"))
    rows = leaves.join(ranked, "weight").join(F.broadcast(r), F.lit(True))
    percentile = F.when(F.col("n") == 1, 0.5).otherwise((F.col("below") + (F.col("k") - 1) / 2.0) / F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.select("path", percentile.alias("percentile"), F.coalesce(F.sqrt(F.try_divide((F.col("weight") - F.col("low")).cast("double"), (F.col("high") - F.col("low")).cast("double"))), F.lit(0.5)).alias("normalized"))


def clean(items: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """Items of ids that are alive, deletes dropped; without a list of these, of ids that were never deleted."""
    gone = F.col("kind").bitwiseAND(KINDS["Delete"]) != 0
    kept = items.join(alive.select("id"), "id", "left_semi") if alive is not None else items.join(items.where(gone).select("id").distinct(), "id", "left_anti")
    return kept.where(~gone)


def shrink(nodes: DataFrame) -> DataFrame:
    """Of rolled-up nodes those from the first folder with more than one child on; without such a folder the deepest node."""
    top = nodes.select("node", F.size(F.split("node", "/")).alias("depth"))
    # a level with one node, and all below it, is passed
    single = top.groupBy("depth").agg(F.count("*").alias("n"))
    passed = single.withColumn("open", F.max(F.when(F.col("n") > 1, 1).otherwise(0)).over(Window.orderBy("depth"))).where("open = 0")  # a row a level of the tree
    start = passed.agg(F.max("depth").alias("from"))
    return nodes.withColumn("_d", F.size(F.split("node", "/"))).join(F.broadcast(start), F.lit(True)).where(F.col("_d") >= F.coalesce("from", F.lit(0))).drop("_d", "from")


def colour_keys(knowledge: DataFrame) -> DataFrame:
    """Distinct colour keys of leaves, the empty one left out."""
    return knowledge.select("colour").where("colour <> ''").distinct()


def distinct_values(leaves: DataFrame, column: str) -> DataFrame:
    """What a range of areas or weights can be picked from."""
    return leaves.select(column).where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).distinct().orderBy(column)


def highlighted(name: Column, text: str | None = None, ranges: Column | None = None) -> Column:
    """Whether a leaf stands out: its name holds the text in any case, and it lies in the ranges; of both only what is given counts, and nothing given marks none."""
    found = F.lower(name).contains(text.lower()) if text else None
    given = [c for c in (found, ranges) if c is not None]
    return F.lit(False) if not given else given[0] if len(given) == 1 else given[0] & given[1]


def default_aliases(change_sets: DataFrame, contributions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(developer, alias): everyone stands for themselves, but for the aliases that are known already."""
    every = developers(change_sets, contributions).withColumn("alias", F.col("developer"))
    return every if known is None else known.select("developer", "alias").unionByName(every.join(known, "developer", "left_anti"))
