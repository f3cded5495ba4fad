"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning.

The index is built in one pass: about `SHARD` bytes of text make a shard, which
holds its terms (64-bit hashes of lower-cased words, split at white space),
their postings (document, frequency) and its documents' lengths, packed in one
row of a shared table. Terms' document frequencies are summed over all shards
for the terms of a block of queries, so every shard scores with the same global
statistics and the merge of the shards' top k is exact.

Like documents (by the common terms they have) stand in the same shards, so that
a query meets most of its postings in few of them.

Queries are a stated set; they meet the shards in blocks of about `BLOCK_TERMS`
terms, the size of what is broadcast, and within a shard in batches:
  * a query whose terms' best impacts together don't reach the k-th best score so
    far (over all shards the task has seen) skips the shard;
  * lists are split as WAND does: those of terms in more than one in `DENSE`
    documents have a small bound for their length and can't make a document a
    result alone; the others are essential and are summed at once, those in more
    than one in `MIDDLE` documents as a product of matrices;
  * block maxima of the long lists over `WINDOW` documents, weighted and added,
    bound what the long lists can add anywhere in a window; a document is a
    pivot if its sum and its window's bound reach the k-th best score so far;
  * only queries with pivots meet the long lists, and only documents that still
    reach the floor are scored in double precision. Sums before that are in 32
    bits, with a margin for what those are off.
Blocks that fail the bound are skipped as a whole, so nothing that could enter
the top k is lost. Scores are rounded to six decimals before they are ranked, so
that equal documents of different shards tie and the smaller doc_id wins.

Defined results: null, empty and blank texts are not in the index, don't count
in the statistics and find nothing as queries; a document is never its own
result (by doc_id); rows with a null doc_id take no part; repeated rows are
documents each, and as queries they give the same rows once; documents that
share no term with the query aren't results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_spans, in_small_batches, materialize, pack, ranges, shared_path, text_slices, unpack, word_spans

K1, B = 1.2, 0.75
SHARD, BLOCK_TERMS, DENSE, WINDOW, SLACK = 12 << 20, 1_700_000, 6, 8, 1e-5
#: Text in hand, in shards, when like documents are put together; groups of documents, and the terms that tell them apart.
HELD, GROUPS, COMMON = 4, 6, 64
#: Lists in more than one in MIDDLE documents are columns of a table of up to CELLS numbers; queries of a batch, those whose short lists are in hand at once, and pairs of a query and a pivot.
MIDDLE, CELLS, BATCH, FEW = 20, 8 << 20, 512, 16


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row by row and then term: row, term, frequency; and the rows' lengths."""
    starts, ends, first = word_spans(buf, offsets)
    n = np.diff(first)
    term, row = hash_spans(buf, starts, ends), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(np.concatenate((at, [len(term)]))), n


def _alike(row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A group of each of n documents by the common terms that it has: k-means over cosines, from the document farthest from all before."""
    names, at, df = np.unique(term, return_inverse=True, return_counts=True)
    common = np.argsort(-df, kind="stable")[:COMMON]
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    has = column[at] >= 0
    x = np.zeros((n, len(common)), np.float32)
    x[row[has], column[at[has]]] = 1
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    middle = x.mean(0)[None]
    for _ in range(GROUPS - 1):
        near = (x @ middle.T).max(1)
        near[x.sum(1) < 1.5] = 1  # of very short texts nothing is told
        middle = np.concatenate((middle, x[np.argmin(near)][None]))
    for _ in range(6):
        group = np.argmax(x @ middle.T, axis=1)
        for g in range(len(middle)):
            if (group == g).any():
                middle[g] = x[group == g].mean(0)
        middle /= np.maximum(np.sqrt((middle**2).sum(1, keepdims=True)), 1e-9)
    return np.argmax(x @ middle.T, axis=1)


def _shard(ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((rows, terms))
    terms, rows, times = terms[order], rows[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate((first, [len(terms)])))
    blobs = pack(np.diff(terms[first], prepend=np.uint64(0)), df.astype(np.uint32)), pack(rows.astype(np.uint32), times.astype(np.uint32)), pack(ids, lengths.astype(np.int64))
    return pa.record_batch([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *(pa.array([b], pa.binary()) for b in blobs)], names=["docs", "words", "lexicon", "postings", "documents"])


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def shards() -> Iterator[pa.RecordBatch]:
        """What is in hand, like documents together: the group with most in it has shards of its own, and so on."""
        at = np.concatenate(([0], np.cumsum([len(x[0]) for x in held])))
        ids, terms, times, lengths, weight = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4, 5))
        rows = np.concatenate([x[1] + a for x, a in zip(held, at, strict=False)])
        held.clear()
        group = _alike(rows, terms, len(ids)) if len(terms) else np.zeros(len(ids), np.int64)
        order = np.argsort(group, kind="stable")
        total = np.bincount(group, weight).astype(np.int64)
        parts = np.maximum(1, np.ceil(total / SHARD)).astype(np.int64)
        before = np.cumsum(weight[order]) - weight[order]
        before -= (np.cumsum(total) - total)[group[order]]
        piece = np.minimum((before * parts[group[order]] / np.maximum(1, total[group[order]])).astype(np.int64), parts[group[order]] - 1)
        shard_of, place = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        cut = np.flatnonzero(np.diff(group[order] * (parts.max() + 1) + piece, prepend=-1))
        n = np.diff(np.append(cut, len(ids)))
        shard_of[order] = np.repeat(np.arange(len(cut)), n)
        place[order] = np.arange(len(ids)) - np.repeat(cut, n)
        of = np.argsort(shard_of[rows], kind="stable")
        ends = np.searchsorted(shard_of[rows[of]], np.arange(len(cut) + 1))
        for k in range(len(cut)):
            x, docs = of[ends[k] : ends[k + 1]], order[cut[k] : cut[k] + n[k]]
            yield _shard(ids[docs], place[rows[x]], terms[x], times[x], lengths[docs])

    for part, buf, offsets in text_slices(batches):
        row, term, tf, n = _terms(buf, offsets)
        held.append((np.asarray(part.column("doc_id")).astype(np.int64), row.astype(np.int32), term, tf.astype(np.int32), n, np.diff(offsets)))
        size += len(buf)
        if size >= HELD * SHARD:
            yield from shards()
            size = 0
    if held:
        yield from shards()


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of an index over (doc_id, text), in the shared folder."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return materialize(in_small_batches(rows).mapInArrow(_build, "docs long, words long, lexicon binary, postings binary, documents binary"), "index")


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, offsets in text_slices(batches):
        row, term, tf, n = _terms(buf, offsets)
        at = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
        yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(term.view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array(tf))], names=["doc_id", "terms", "times"])


class Queries:
    """A block of queries: ids, terms as places in the block's sorted vocabulary, and their frequencies.

    They stand in an order that puts queries with the same common words together, so
    that a batch of them uses few columns of a shard's tables.
    """

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        first, flat = (rows["terms"].combine_chunks().flatten().to_numpy().view(np.uint64), rows["times"].combine_chunks().flatten().to_numpy())
        n = pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
        self.vocabulary, terms = np.unique(first, return_inverse=True)
        common = np.argsort(-np.bincount(terms, minlength=len(self.vocabulary)), kind="stable")[:32]
        bit = np.zeros(len(self.vocabulary))
        bit[common] = 2.0 ** -np.arange(1, len(common) + 1)
        offsets = np.concatenate(([0], np.cumsum(n)))
        order = np.argsort(np.bincount(np.repeat(np.arange(len(n)), n), bit[terms], len(n)), kind="stable")
        moved = ranges(offsets[order], n[order])
        self.ids = rows["doc_id"].to_numpy().astype(np.int64)[order]
        self.offsets = np.concatenate(([0], np.cumsum(n[order])))
        self.terms, self.times = terms[moved].astype(np.int32), flat[moved].astype(np.int32)
        self.who = np.repeat(np.arange(len(n), dtype=np.int32), n[order])

    def places(self, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of the block a shard has, and where."""
        if not len(lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(lexicon, self.vocabulary), len(lexicon) - 1)
        mine = np.flatnonzero(lexicon[at] == self.vocabulary)
        return mine, at[mine]


def _lexicon(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, df = unpack(blob, "<u8", "<u4")
    return np.cumsum(steps, dtype=np.uint64), df.astype(np.int64)


class Shard:
    """A shard unpacked for a block of queries, its lists by how many documents they have."""

    def __init__(self, q: Queries, average: float, blobs: tuple[bytes, bytes, bytes]):
        lexicon, self.df = _lexicon(blobs[0])
        rows, times = unpack(blobs[1], "<u4", "<u4")
        self.ids, lengths = unpack(blobs[2], "<i8", "<i8")
        self.n = n = len(self.ids)
        mine, at = q.places(lexicon)
        self.start = np.concatenate(([0], np.cumsum(self.df)))
        self.rows = rows.astype(np.int64)
        self.impact = times * (K1 + 1) / (times + (K1 * (1 - B + B * lengths / average))[self.rows])
        self.pairs = np.stack((self.rows, self.impact.view(np.int64)), axis=1)  # side by side, so that a list is one place in memory
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(lexicon) else np.zeros(0)
        self.where = np.full(len(q.vocabulary), -1)
        self.where[mine] = at
        # long lists: a column each of a dense table with block maxima; lists of middle length: a column each of another
        kind, size = np.zeros(len(lexicon), np.int8), self.df[at]
        kind[at[size * DENSE > n]] = 2
        middle = at[(size * MIDDLE > n) & (size * DENSE <= n)]
        kind[middle[np.argsort(-self.df[middle], kind="stable")[: CELLS // max(1, n)]]] = 1
        self.kind, self.column = kind, np.zeros(len(lexicon), np.int64)
        self.windows = -(-n // WINDOW)
        self.long, self.middle = self._table(2), self._table(1)
        # in 32 bits, for bounds
        self.long32, self.middle32 = self.long.astype(np.float32), self.middle.astype(np.float32)
        self.maxima = self.long32.reshape(len(self.long), WINDOW, self.windows).max(1)
    def _table(self, kind: int) -> np.ndarray:
        """Impacts of the lists of a kind, a row each, over all documents."""
        lists = np.flatnonzero(self.kind == kind)
        self.column[lists] = np.arange(len(lists))
        table, every = np.zeros((len(lists), self.windows * WINDOW)), ranges(self.start[lists], self.df[lists])
        table[np.repeat(np.arange(len(lists)), self.df[lists]), self.rows[every]] = self.impact[every]
        return table


def _product(who: np.ndarray, column: np.ndarray, weights: np.ndarray, m: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weighted rows of a table for m queries; the queries' weights of the rows that any of them uses, and those rows."""
    used, at = np.unique(column, return_inverse=True)
    heavy = np.zeros((m, len(used)), np.float32)
    heavy[who, at] = weights
    return heavy @ table[used], heavy, used


def search_shard(q: Queries, idf: np.ndarray, average: float, blobs: tuple[bytes, bytes, bytes], k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Puts a shard's results into `best` (scores and doc_ids of each query); returns the pivots scored."""
    s, pivots = Shard(q, average, blobs), 0
    n, wide = s.n, s.windows * WINDOW
    if not (s.where >= 0).any():
        return 0
    places = s.where[q.terms]
    here = np.flatnonzero(places >= 0)
    places, who, weights = places[here], q.who[here], q.times[here] * idf[q.terms[here]]
    # queries for which the best impacts of their terms together reach the floor; others skip the shard
    floors = np.array([found[0][-1] if len(found[0]) == k else 0.0 for found in best])
    active = np.bincount(who, weights * s.most[places], len(q.ids)) >= np.maximum((floors - SLACK) * (1 - 1e-9), 1e-12)
    here, asked = active[who], np.flatnonzero(active)
    all_places, all_who, all_weights = places[here], (np.cumsum(active) - 1)[who[here]], weights[here]
    first = np.searchsorted(all_who, np.arange(len(asked) + 1))
    batch = max(1, min(BATCH, (2 << 20) // wide))
    for a in range(0, len(asked), batch):
        own = asked[a : a + batch]
        m, x = len(own), slice(first[a], first[min(a + batch, len(asked))])
        places, who, weights = all_places[x], all_who[x] - a, all_weights[x]
        kind, column = s.kind[places], s.column[places]
        of = kind == 1
        sums, _, used = _product(who[of], column[of], weights[of], m, s.middle32)
        short = kind == 0
        p, w, r = places[short], weights[short], who[short]
        rest = np.zeros((m, wide))
        cut = np.searchsorted(r, np.arange(m + 1))
        for c in range(0, m, FEW):  # what is in hand at once stays in the cache
            d = min(c + FEW, m)
            y = slice(cut[c], cut[d])
            lists = ranges(s.start[p[y]], s.df[p[y]])
            if len(lists):
                both = s.pairs.take(lists, axis=0)
                to = both[:, 0] + np.repeat((r[y] - c) * wide, s.df[p[y]])
                rest[c:d] = np.bincount(to, both[:, 1].view(np.float64) * np.repeat(w[y], s.df[p[y]]), (d - c) * wide).reshape(d - c, wide)
                sums[c:d] += rest[c:d]
        of = kind == 2
        over, heavy, columns = _product(who[of], column[of], weights[of], m, s.maxima)
        # 32 bits: a sum of so many numbers above 0 is off by less than this part of it
        off = 1 - (len(used) + len(columns) + 64) * 2.0**-23
        long = s.long32[columns]
        floor = np.maximum((floors[own] - SLACK) * off, 1e-12)
        least = ((floor[:, None] - over) * off - 1e-12).astype(np.float32)
        reached = sums.reshape(m, WINDOW, s.windows) >= least[:, None, :]
        some = np.flatnonzero(reached.reshape(m, wide).any(1))
        # the long lists of queries that have pivots
        whole = sums[some] + heavy[some] @ long
        whole[:, n:] = 0
        if n > k:  # the k-th best of this shard is a floor as well
            new = np.flatnonzero((whole >= floor[some][:, None]).sum(1) > 4 * k)
            other = np.where(s.ids[None, :] == q.ids[own[some[new]], None], np.float32(0), whole[new, :n])
            floor[some[new]] = np.maximum(floor[some[new]], np.partition(other, n - k, axis=1)[:, n - k] * off - SLACK)
        at, pivot = np.divmod(np.flatnonzero(reached.reshape(m, wide)[some] & (whole >= (floor[some] * off)[:, None])), wide)
        for c, d in pairwise(np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))):
            i, docs = some[at[c]], pivot[c:d]
            docs = docs[s.ids[docs] != q.ids[own[i]]]
            if not len(docs):
                continue
            pivots += len(docs)
            z = slice(first[a + i] - first[a], first[a + i + 1] - first[a])
            exact = rest[i, docs]
            for of, table in ((2, s.long), (1, s.middle)):
                y = kind[z] == of
                exact = exact + weights[z][y] @ table[column[z][y][:, None], docs]
            exact = np.round(exact, 6)
            scores, found = np.concatenate((best[own[i]][0], exact[exact > 0])), np.concatenate((best[own[i]][1], s.ids[docs[exact > 0]]))
            order = np.lexsort((found, -scores))[:k]
            best[own[i]] = scores[order], found[order]
    return pivots


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of the index for each (doc_id, text) of `queries`."""
    spark = index.sparkSession
    wanted = queries.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).distinct()
    asked = materialize(in_small_batches(wanted).mapInArrow(_query_terms, "doc_id long, terms array<long>, times array<long>").where(F.size("terms") > 0), "queries")
    size, docs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0], index.agg(F.sum("docs"), F.sum("words")).first()
    blocks, path = max(1, math.ceil(size / BLOCK_TERMS)), shared_path(spark, "found")
    schema = "query_id long, rank int, doc_id long, score double"
    if not size or not docs[0]:
        return spark.createDataFrame([], schema)
    total, average = docs[0], docs[1] / docs[0]
    # a task a core: each gives k rows a query, and floors rise with the shards that a task has seen
    index = index.coalesce(spark.sparkContext.defaultParallelism)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        block = Queries(rows)
        shared = spark.sparkContext.broadcast(block)

        def frequencies(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(shared.value.vocabulary), np.int64)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    lexicon, n = _lexicon(blob)
                    mine, at = shared.value.places(lexicon)
                    df[mine] += n[at]
            some = np.flatnonzero(df)
            yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["term", "df"])

        found = in_small_batches(index.select("lexicon"), 1).mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # at most the block's vocabulary
        df = np.zeros(len(block.vocabulary))
        df[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(float)
        weights = spark.sparkContext.broadcast(np.log(1 + (total - df + 0.5) / (df + 0.5)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q.ids)
            for batch in batches:
                for blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    search_shard(q, weights.value, average, blobs, k, best)
            n = np.array([len(x[0]) for x in best])
            yield pa.record_batch([pa.array(np.repeat(q.ids, n)), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))], names=["query_id", "doc_id", "score"])

        parts = in_small_batches(index.select("lexicon", "postings", "documents"), 1).mapInArrow(run, "query_id long, doc_id long, score double")
        merged = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        merged.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
        weights.unpersist()
    return spark.read.schema(schema).parquet(path)


def similar_documents(docs: DataFrame, k: int = 10, queries: str = "doc_id % 50 = 0") -> DataFrame:
    """The k best documents for every document that `queries` selects, its whole text as the query."""
    return search(build_index(docs), docs.where(queries), k)
