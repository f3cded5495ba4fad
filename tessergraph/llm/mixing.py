"""Mixing sources to target weights.

Every document gets a hash-random key (MD5 of seed and doc_id, so other engines
can follow). Rows that agree in doc_id, source and size are one group with a
number of rows, added up before the shuffle, so rows that share a key because
they repeat or have no doc_id are few. Groups are range-sorted by key within
their source: the key's leading bits name a range (about `RANGE_ROWS` documents
of a source that is the whole table), sizes are summed a range, and running sums
of the ranges of a source give each range its offset; within a range a running
sum gives each group its place. So a source of any size is spread over its
ranges and no task holds a source. The source's budget is cut at the exact
word: whole epochs of the source first, then the documents that lie below the
rest, the one across the cut in part.

Targets: sources share the total by weight; none takes more than `MOST` times
its own size, and the excess is shared again by weight among the others, until
none is above (water filling). Each round is one aggregation over the table of
sources, of which the driver sees sums only.

Defined results: a null text counts 0 words; a null source is a source of its
own, sorted last; an empty table gives no rows; documents with equal keys are
ordered by doc_id (null first) and size, so repeated rows share a cut in an
arbitrary but harmless order (they are equal); a source without words has
target 0; other columns are ignored. Rows of a null doc_id share one key and are
ordered by size; in the mixed corpus their text takes its place. There, rows that agree in doc_id, source and text
are one document that was given several times: it is there as often as all of
them together were to be taken, with the other columns of one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize

WEIGHTS, MOST, RANGE_ROWS, SEED = (5.0, 2.0, 1.0), 3.0, 4000, 4211


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, rows: int | None = None) -> DataFrame:
    """source, source_size, target of each source of a (source, size) table, of which `rows` may tell the length; the sources are ranked by code point, null last."""
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources", rows)
    # ranking without one ordered partition: the number of smaller names, from sorted blocks by first two code points
    block = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    blocks = sources.where("source is not null").groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    named = sources.where("source is not null").withColumn("block", block).join(before, "block").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("source")) - 1).drop("block", "before")
    n = named.count()
    ranked = named.select("source", "source_size", "rank").unionByName(sources.where("source is null").select("source", "source_size", F.lit(n).cast("long").alias("rank")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", weight), "mix-ranked", rows)

    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # level = words a unit of weight gets; a source is full where the level lifts it above its most
    level, full = 0.0, -1
    while True:
        above = (F.col("weight") * level > F.col("source_size") * most) | (F.col("source_size") == 0)
        row = table.agg(F.sum(above.cast("int")), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if row[0] is None or row[0] == full or not row[2]:
            break
        full, level = row[0], max(level, (total - row[1]) / row[2])
    discard(sources)
    return table.select("source", "source_size", F.least(F.col("weight") * level, F.col("source_size") * most).alias("target"))


def _placed(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int, text: str, name: Column, *more: Column) -> DataFrame:
    """doc_id, source, size (and `more`) of each group of equal rows, their number m, source_size, target, epochs taken whole, and words below the rest: `room` from the group's first row on."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name)).alias("key")
    rows = docs.select("doc_id", "source", words(F.col(text)).alias("size"), key, *more)
    groups = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "mix-sizes")
    n = groups.count()
    bits = min(32, max(0, math.ceil(math.log2(max(1, n) / RANGE_ROWS))))
    by_source = source_targets(groups.select("source", (F.col("size") * F.col("m")).alias("size")), weights, most, n)
    # the order of keys is the order of ranges as well
    ranged = groups.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)).withColumn("all", F.col("size") * F.col("m"))
    offsets = ranged.groupBy("source", "range").agg(F.sum("all").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *[c for c in rows.columns[4:]]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("all").over(within), F.lit(0)))
    targets = by_source.withColumnRenamed("source", "s")
    both = offsets.join(targets, offsets["source"].eqNullSafe(targets["s"])).select(F.col("source").alias("s"), F.col("range").alias("r"), "offset", "source_size", "target")
    joined = placed.join(both, placed["source"].eqNullSafe(both["s"]) & (placed["range"] == both["r"])).drop("s", "r", "key", "all")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    return joined.withColumns({"epochs": epochs, "room": rest - F.col("offset") - F.col("inside")})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    groups = _placed(docs, weights, most, seed, text, F.col("doc_id").cast("string"))
    # a row each again, in two steps, so that no list is as long as a group
    some, n = 4096, F.col("m")
    pages = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / some))))
    rows = pages.withColumn("j", F.explode(F.sequence(F.col("page") * some, F.least(n, (F.col("page") + 1) * some) - 1)))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("room") - F.col("j") * F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


def cut_text(text: Column, n: Column) -> Column:
    """A text up to and with its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def apply_mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus in the input's columns: a document is there once an epoch, the one across a source's cut with the words before the cut; n_chars follows the text. Documents without words, or wholly above the cut, are not there."""
    identity = F.md5(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.md5(text).alias("t"))))
    groups = _placed(docs, WEIGHTS, MOST, SEED, text, F.coalesce(F.col("doc_id").cast("string"), F.md5(text)), identity.alias("_mix_same"))
    taken = F.col("epochs") * F.col("size") * F.col("m") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size") * F.col("m"), F.col("room")))
    groups = materialize(groups.select("_mix_same", F.col("size").alias("_mix_size"), F.col("m").alias("_mix_m"), taken.alias("_mix_taken")).where("_mix_taken > 0"), "mix-taken")
    named = docs.withColumn("_mix_same", identity)
    single = named.join(groups.where("_mix_m = 1").drop("_mix_m"), "_mix_same")
    # few but for rows given again and again, which are brought together before the shuffle
    again = named.join(groups.where("_mix_m > 1").drop("_mix_m"), "_mix_same").groupBy("_mix_same", "_mix_size", "_mix_taken").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*[c for c in docs.columns if c != text]))).alias("_mix_row"))
    every = single.select("_mix_size", "_mix_taken", *docs.columns).unionByName(again.select("_mix_size", "_mix_taken", "_mix_row.*"))
    copies = every.withColumn("_mix_words", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_taken") - 1) / F.col("_mix_size"))), lambda i: F.least(F.col("_mix_size"), F.col("_mix_taken") - i * F.col("_mix_size")))))
    cut = F.when(F.col("_mix_words") < F.col("_mix_size"), cut_text(F.col(text), F.col("_mix_words"))).otherwise(F.col(text))
    out = copies.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out
