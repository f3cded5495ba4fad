"""N-gram Jaccard self-join with Bayesian candidate pruning (BayesLSH-Lite,
Satuluri and Parthasarathy, 2012).

Documents are sets of five-word shingles, words split at white space; a shorter
document has one shingle of all its words. Two documents are linked if their
sets' Jaccard similarity is 0.8 or more.

1. One pass over the texts makes each document's set digest (128 bits) and the
   keys of `BANDS` bands of `ROWS` MinHash values. Documents with equal digests
   are copies; one representative of them goes on, with their number.
2. Representatives that share a band key are joined to the smallest of them, and
   connected components of those edges are the candidate groups. A pair at the
   threshold misses all bands with probability (1 - 0.8^4)^32 < 1e-7.
3. Groups are cut into blocks of bounded shingles and rows; a task compares two
   blocks of a group, and in them only pairs that share a band key. MinHash
   values of a pair are compared 16 at a time; the
   pair is dropped when the posterior probability that its similarity reaches
   the threshold (uniform prior, binomial matches) is below `TOLERANCE`; pairs
   left after all 128 are verified by the exact sizes of their intersections.
   A task returns a row a document (links counted, smallest partner found), not
   a row a pair, so no plan node grows with the square of a group.
4. Classes are the connected components of the verified links.

Defined results: null, empty and blank texts have no shingle, no link and a
class of their own; rows with equal doc_id are one document for the classes
(each row is returned); a null doc_id gives class null and no link; an empty
table gives no rows; links of a document count all other documents with the
same set or a linked set; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, hash_spans, in_small_batches, materialize, mix64, ranges, text_slices, word_spans

SHINGLE, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 32, 4, 16, 1e-6
#: Bounds of a block: shingles, and rows.
BLOCK_SHINGLES, BLOCK_ROWS = 600_000, 3000
_seeds = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = (_seeds | np.uint64(1)).astype(np.uint32), (_seeds >> np.uint64(32)).astype(np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    starts, ends, first = word_spans(buf, offsets)
    h = hash_spans(buf, starts, ends)
    n = np.diff(first)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the row's end
    s = np.zeros(len(h), np.uint64)
    for k in range(width):
        s = mix64((s ^ np.where(left > k, padded[k : k + len(h)], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    counts = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    return [np.unique(s[a : a + c]) for a, c in zip(first[:-1], counts, strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_ADD), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(out, (x[a : a + 2048, None] * _MULTIPLY + _ADD).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of the bands of signatures (a row each)."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return mix64(mix64((s[:, :, 0] << np.uint64(32)) | s[:, :, 1]) ^ ((s[:, :, 2] << np.uint64(32)) | s[:, :, 3]))


class Buckets:
    """Which rows share a band key with a row."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, axis=0, kind="stable")
        ranked = np.take_along_axis(keys, self.order, 0)
        self.first, self.last = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for b in range(keys.shape[1]):
            self.first[:, b], self.last[:, b] = np.searchsorted(ranked[:, b], keys[:, b]), np.searchsorted(ranked[:, b], keys[:, b], "right")
        self.mark = np.zeros(len(keys), bool)

    def near(self, i: int, least: int) -> np.ndarray:
        """Rows from `least` on that share a key with row i."""
        for b in np.flatnonzero(self.last[i] - self.first[i] > 1).tolist():
            self.mark[self.order[self.first[i, b] : self.last[i, b], b]] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found[np.searchsorted(found, least) :]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after each step."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() / mass.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mult = np.uint64(0x9E3779B97F4A7C15)
    for part, buf, offsets in text_slices(batches):
        n, one, two, bands = [], [], [], []
        for s in shingle_sets(buf, offsets):
            n.append(len(s))
            one.append(mix64(s * mult).sum(dtype=np.uint64))
            two.append(mix64(s ^ mult).sum(dtype=np.uint64))
            if len(s):
                bands.append(band_keys(signature(s)[None])[0])
            else:
                bands.append(np.zeros(BANDS, np.uint64))
        flat = np.concatenate(bands).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        yield pa.record_batch([part.column("key"), pa.array(np.array(n, np.int64)), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), lists], names=["key", "n", "one", "two", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its shingle set, as bytes."""
    for part, buf, offsets in text_slices(batches):
        others = [c for c in part.schema.names if c != "text"]
        yield pa.record_batch([part.column(c) for c in others] + [pa.array([s.tobytes() for s in shingle_sets(buf, offsets)], pa.binary())], names=[*others, "shingles"])


def _compare(threshold: float):
    """The kernel for two blocks of each group in a bin: a row a document, with its links and a document of the same class."""
    steps = least_matches(threshold)

    def linked_to(i: int, others: np.ndarray, sig: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
        if not len(others):
            return others
        # a pair's similarity is at most the ratio of its sizes
        others = others[np.minimum(lengths[others], lengths[i]) >= threshold * np.maximum(lengths[others], lengths[i]) - 1e-9]
        matches, done = np.zeros(len(others), np.int64), 0
        for n, least in steps:
            matches += (sig[others, done:n] == sig[i, done:n]).sum(1)
            keep = matches >= least
            others, matches, done = others[keep], matches[keep], n
            if not len(others):
                return others
        mine = ids[offsets[i] : offsets[i + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[ids[ranges(offsets[others], lengths[others])]], np.concatenate(([0], np.cumsum(lengths[others])[:-1])), dtype=np.int64)
        mark[mine] = False
        return others[shared >= threshold * (lengths[i] + lengths[others] - shared) - 1e-9]

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby("component", sort=False):
            group = group.drop_duplicates(["rep", "shingles"]).sort_values(["side", "rep"], kind="stable")
            rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            whole = bool((group["i"] == group["j"]).iloc[0])  # a block compared with itself
            split = len(rep) if whole else int((group["side"] == 0).sum())
            sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
            lengths = np.array([len(s) for s in sets], np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark, sig = np.zeros(int(ids.max()) + 1, bool), np.stack([signature(s) for s in sets])
            links, root = np.zeros(len(rep), np.int64), list(range(len(rep)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            buckets = Buckets(band_keys(sig))
            for i in range(split):
                found = linked_to(i, buckets.near(i, i + 1 if whole else split), sig, lengths, offsets, ids, mark)
                links[i] += copies[found].sum()
                links[found] += copies[i]
                for j in found.tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        low, high = (a, b) if rep[a] <= rep[b] else (b, a)
                        root[high] = low
            out.append(pd.DataFrame({"rep": rep, "links": links, "partner": rep[[find(x) for x in range(len(rep))]]}))
        return pd.concat(out, ignore_index=True)

    return pairs


def _classes(texts: DataFrame, threshold: float) -> DataFrame:
    """key, class (the smallest key of its class) and links of every row of (key, text); a null key has no class."""
    kind = texts.schema["key"].dataType.simpleString()
    prints = materialize(in_small_batches(texts).mapInArrow(_fingerprints, f"key {kind}, n long, one long, two long, bands array<long>"), "jaccard-prints")
    held = prints.where("n > 0 and key is not null")
    classes = materialize(held.groupBy("one", "two", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "key").alias("bands")), "jaccard-classes")
    n_classes = classes.count()

    banded = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").drop("last")
    edges = banded.join(shared, ["band", "hash"]).where("rep <> leader").select("rep", "leader").distinct()
    groups = materialize(connected_components(edges, "rep", "leader", "jaccard-candidates"), "jaccard-groups", n_classes)

    members = groups.withColumnRenamed("node", "rep").join(classes.select("rep", "copies", "n", "one", "two"), "rep")
    sizes = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    # blocks of a large group; small groups share bins, so that a task has enough to do
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)).cast("int")
    total = sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    bins = max(1, math.ceil(total / BLOCK_SHINGLES))
    sizes = sizes.select("component", blocks.alias("blocks"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    # block b meets every block: as the first of a pair with those after it, as the second with those before
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    work = placed.withColumn("shard", F.when(F.col("blocks") > 1, F.col("component")))
    placed = work.select("component", "shard", "bin", "rep", "copies", meets.alias("meets"))
    kinds = f"component {kind}, shard {kind}, bin long, rep {kind}, copies long, meets array<struct<i:int,j:int,side:int>>, shingles binary"
    sets = in_small_batches(texts.join(placed, texts["key"] == placed["rep"]).drop("key").select(*placed.columns, "text")).mapInArrow(_sets, kinds)
    tasks = sets.withColumn("m", F.explode("meets")).select("component", "shard", "bin", "rep", "copies", "shingles", "m.*")
    found = materialize(tasks.groupBy("shard", "bin", "i", "j").applyInPandas(_compare(threshold), f"rep {kind}, links long, partner {kind}"), "jaccard-links")

    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = connected_components(found.where("rep <> partner"), "rep", "partner", "jaccard-classes")
    named = named.select(F.col("node").alias("rep"), "component")
    outcome = classes.select("one", "two", "n", "rep", "copies").join(counted, "rep", "left").join(named, "rep", "left")
    outcome = outcome.select("one", "two", "n", F.coalesce("component", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    discard(groups)
    alone = prints.where("n = 0 or key is null").select("key", F.col("key").alias("class"), F.lit(0).cast("long").alias("links"))
    return held.select("key", "one", "two", "n").join(outcome, ["one", "two", "n"]).select("key", "class", "links").unionByName(alone)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and n_links of every document."""
    found = _classes(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), threshold)
    return found.select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of near copies, in the input's columns: that with the smallest doc_id.

    Documents without a doc_id come last and are told apart by their texts, so of
    equal ones one stays, and one that is a near copy of a document with an id
    goes. Of rows that share a doc_id one stays, that with the least text.
    """
    # doc_ids as texts that sort as the numbers do
    known = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    key = F.coalesce(known, F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))))
    first = _classes(docs.select(key.alias("key"), "text"), threshold).where("key = class").select(F.col("key").alias("_near_copy_key")).distinct()
    left = docs.withColumn("_near_copy_key", key).join(first, "_near_copy_key", "left_semi")
    # joined by key already, so this needs no further shuffle
    return left.groupBy("_near_copy_key").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
