"""Approximate nearest neighbours by cosine with a forest of hash prefixes
(LSH Forest, Bawa, Condie and Ganesan, 2005).

Each of `TREES` trees gives a vector a string of `LENGTH` bits, the signs of
products with random directions, of the unit vector less the mean of all unit
vectors: distances of unit vectors order as cosines do, and vectors around a
common direction would else share most bits.

`build_index` deals the rows out by hash into segments of about `SEGMENT`
vectors. A segment is one row of the index: its vectors, once, and for each tree
the array of their strings in sorted order and which vector each belongs to.
`search` takes queries in blocks of about `BLOCK`; each block meets each segment
in a task of its own, so a task holds one of either and no group grows with the
table. In a segment, for each query:

* Descending: the place of the query's string in a tree's sorted array is found
  by bisection; what shares its first x bits is one stretch around that place,
  and the longest match over all trees is where the search begins.
* Synchronously ascending: all trees shorten the prefix together, bit by bit,
  until their stretches hold `SHARE` of the segment's rows (counted a tree each)
  and k different vec_ids. That goes on to the empty prefix, which all rows
  share, so a query finds k rows wherever there are k. Stretches only grow, so
  the prefix length where this is first so is itself found by bisection.
* The vectors in the stretches are measured exactly, and the k nearest vec_ids
  are the segment's answer. Answers of all segments are merged.

The candidates' share is set for recall: on vectors without structure the depth
at which a neighbour still shares a prefix depends on the angle and not on the
row count, so a fixed share keeps recall as tables grow.

Defined results: vectors that are null, zero, of another length than most (ties
to the shorter) or hold null or non-finite components take no part; rows that
agree in vec_id and vector count once; of further rows of one vec_id the nearest
is its result, and as a query a vec_id has the results of all its vectors
together; a query is left out of its own by vec_id; ties go to the smaller
vec_id; fewer candidates than k give fewer rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, LENGTH, SHARE, SEGMENT, BLOCK, SEED = 64, 32, 0.75, 16_384, 16_384, 8191
_RESULT = "query_id long, vec_id long, score double"


def directions(width: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, trees * LENGTH))


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit strings as integers, a row a tree and a column a vector."""
    out = np.empty((planes.shape[1] // LENGTH, len(vectors)), np.uint32)
    weights = np.uint32(1) << np.arange(LENGTH - 1, -1, -1, dtype=np.uint32)
    for a in range(0, len(vectors), 2048):
        bits = (vectors[a : a + 2048] @ planes > 0).reshape(-1, len(out), LENGTH)
        out[:, a : a + 2048] = (bits * weights).sum(2, dtype=np.uint32).T
    return out


def centred(vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors less the mean; what is left of vectors equal to it but for rounding is zero."""
    left = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)) - mean
    return np.where((left * left).sum(1, keepdims=True) < 1e-18, 0.0, left)


def _stack(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).astype(float).reshape(len(lists), -1)


def vectors_of(table: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows that take part, once each: vec_id and vector; the vectors' length; and an upper bound of the rows."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return rows, 0, 0
    return rows.where(F.size("vector") == common["width"]).distinct(), common["width"], common["count"]


def mean_direction(rows: DataFrame, width: int) -> np.ndarray:
    """The mean of the unit vectors."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(width), 0
        for batch in batches:
            if batch.num_rows:
                sums += centred(_stack(batch.column(0)), np.zeros(width)).sum(0)
                n += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(sums), pa.array(np.full(width, n))], names=["place", "sum", "n"])

    sums = rows.select("vector").mapInArrow(add, "place long, sum double, n long").groupBy("place").agg((F.sum("sum") / F.sum("n")).alias("mean")).toPandas()  # one row a component
    mean = np.zeros(width)
    mean[sums["place"].to_numpy(np.int64)] = np.round(sums["mean"].to_numpy(), 12)
    return mean


def _packed(label: str, most: int, rows: DataFrame, n: int, width: int, more: str, extra) -> DataFrame:
    """One row for each of the parts of about `most` rows that hashing makes: its number, vec_ids and vectors as bytes, and what `extra` makes of the vectors."""

    def pack(group: pa.Table) -> pa.Table:
        ids, vectors = np.asarray(group.column("vec_id").combine_chunks()), _stack(group.column("vector"))
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        blobs = [ids.tobytes(), vectors.tobytes(), *extra(vectors)]
        return pa.table([pa.array([group.column(label)[0].as_py()], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=[f.split()[0] for f in f"{label} int, ids binary, vectors binary{more}".split(", ")])

    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, math.ceil(n / most)))).cast("int")
    return rows.withColumn(label, part).groupBy(label).applyInArrow(pack, f"{label} int, ids binary, vectors binary{more}")


def build_index(rows: DataFrame, n: int, width: int, mean: np.ndarray, trees: int = TREES, segment: int = SEGMENT) -> DataFrame:
    """A forest over the rows, a segment a row, in the shared folder."""
    planes = rows.sparkSession.sparkContext.broadcast(directions(width, trees))

    def forest(vectors: np.ndarray) -> tuple[bytes, bytes]:
        codes = strings(centred(vectors, mean), planes.value)
        order = np.argsort(codes, axis=1, kind="stable").astype(np.uint32)
        return np.take_along_axis(codes, order, 1).tobytes(), order.tobytes()

    return materialize(_packed("segment", segment, rows, n, width, ", strings binary, places binary", forest), "forest")


def _stretches(strings_: np.ndarray, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where what shares the first `depth` bits with each query begins and ends, a row a tree."""
    drop = (LENGTH - depth).astype(np.uint64)
    low = codes.astype(np.uint64) >> drop << drop
    high = low + (np.uint64(1) << drop)
    first, last = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
    for t in range(len(codes)):
        tree = strings_[t].astype(np.uint64)
        first[t], last[t] = np.searchsorted(tree, low[t]), np.searchsorted(tree, high[t])
    return first, last


def longest_match(strings_: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each query, the bits of the longest prefix that it shares with any string of any tree: its neighbours in sorted order share most."""
    best = np.zeros(codes.shape[1], np.int64)
    for t in range(len(codes)):
        at = np.searchsorted(strings_[t], codes[t])
        for near in (np.maximum(at - 1, 0), np.minimum(at, strings_.shape[1] - 1)):
            apart = (strings_[t][near] ^ codes[t]).astype(float)
            best = np.maximum(best, LENGTH - np.ceil(np.log2(apart + 1)).astype(np.int64))
    return best


def ascend(strings_: np.ndarray, codes: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common prefix length at which all trees' stretches together hold `wanted` rows, or 0, and the stretches."""
    low, high = np.zeros(codes.shape[1], np.int64), longest_match(strings_, codes)
    while (low < high).any():
        middle = (low + high + 1) // 2
        first, last = _stretches(strings_, codes, middle)
        enough = (last - first).sum(0) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low, *_stretches(strings_, codes, low)


def search_segment(ids: np.ndarray, vectors: np.ndarray, strings_: np.ndarray, places: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, codes: np.ndarray, k: int, share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query_id, vec_id and score of the k nearest candidates of each query in one segment."""
    n, trees = len(ids), len(strings_)
    norm, out = np.sqrt((vectors * vectors).sum(1)), []
    depth, first, last = ascend(strings_, codes, max(share * n, (k + 1) * trees))
    for i in range(len(q_ids)):
        x, a, b = int(depth[i]), first[:, i], last[:, i]
        while True:
            if x:
                mark = np.zeros(n, bool)
                for t in range(trees):
                    mark[places[t, a[t] : b[t]]] = True
                near = np.flatnonzero(mark & (ids != q_ids[i]))
            else:
                near = np.flatnonzero(ids != q_ids[i])
            # rows of the same vec_id stand together
            if not x or len(near) >= k and 1 + np.count_nonzero(np.diff(ids[near])) >= k:
                break
            x -= 1
            a, b = (s[:, 0] for s in _stretches(strings_, codes[:, i : i + 1], np.array([x])))
        if not len(near):
            continue
        rough = vectors[near] @ q_vectors[i] / norm[near]
        size = math.sqrt(float((q_vectors[i] * q_vectors[i]).sum()))
        tried = 4 * k
        while True:
            if len(near) > tried:
                floor = np.partition(rough, len(rough) - tried)[len(rough) - tried] - 1e-9 * size
                some = near[rough >= floor]
            else:
                some = near
            if len(some) == len(near) or 1 + np.count_nonzero(np.diff(ids[some])) >= k:
                break
            tried *= 4
        # row sums, not a matrix product: equal vectors get equal scores wherever they stand
        exact = (vectors[some] * q_vectors[i]).sum(1) / (norm[some] * size)
        order = np.lexsort((-exact, ids[some]))
        new = np.ones(len(order), bool)
        new[1:] = ids[some][order][1:] != ids[some][order][:-1]
        order = order[new]  # the nearest of each vec_id
        order = order[np.lexsort((ids[some][order], -exact[order]))][:k]
        out.append((np.full(len(order), q_ids[i]), ids[some][order], exact[order]))
    return out


def search(index: DataFrame, queries: DataFrame, n_queries: int, width: int, mean: np.ndarray, k: int = 5, trees: int = TREES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row (vec_id, vector) of `queries`."""
    planes = index.sparkSession.sparkContext.broadcast(directions(width, trees))
    blocks = _packed("block", block, queries, n_queries, width, ", codes binary", lambda vectors: (strings(centred(vectors, mean), planes.value).tobytes(),))
    blocks = materialize(blocks, "forest-queries")
    segments, parts = index.agg(F.max("segment")).first()[0], blocks.agg(F.max("block")).first()[0]
    if segments is None or parts is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            read = lambda table, name, kind: np.frombuffer(table.column(name)[0].as_buffer(), kind)
            codes = read(right, "codes", np.uint32).reshape(trees, -1)
            mine = [read(left, "strings", np.uint32).reshape(trees, -1), read(left, "places", np.uint32).reshape(trees, -1)]
            out = search_segment(read(left, "ids", np.int64), read(left, "vectors", float).reshape(-1, width), *mine, read(right, "ids", np.int64), read(right, "vectors", float).reshape(-1, width), codes, k, share)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    # every block of the stated query set meets every segment, each pair in a group of its own
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts)))).groupBy("segment", "block")
    right = blocks.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments)))).groupBy("segment", "block")
    once = left.cogroup(right).applyInArrow(answer, _RESULT).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, k: int = 5, queries: str = "vec_id % 50 = 0", trees: int = TREES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row that `queries` selects, against all rows."""
    rows, width, n = vectors_of(table)
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean = mean_direction(rows, width)
    asked = rows.where(queries)
    return search(build_index(rows, n, width, mean, trees), asked, asked.count(), width, mean, k, trees, share)
