"""Stupid-backoff scores (Brants et al., 2007) of documents under a bigram model of the whole corpus.

Score of a word w after v: c(vw) / c(v) if the bigram's count in the corpus is
`least` or more, else `BACKOFF` * c(w) / N. A document's first word is scored by
its unigram. The query takes every bigram seen (`least` = 1), so the corpus's
own documents never back off; with 2, a bigram that no other place confirms is
scored by its unigram.

Every word and every bigram is counted. Words more frequent than one in
`VOCABULARY` of all words, at most `VOCABULARY` of them whatever the corpus, are
numbered and broadcast with their counts; the others, the rare words, keep their
64-bit hash as name and are counted where they are scored. Where a word is
counted has no influence on its score.

* Pairs of two of the `HEAD` most frequent words are counted in a table of at
  most HEAD^2 numbers, summed on the map side and broadcast as well.
* Any other pair of numbered words holds at most one in HEAD of all words. These
  pairs are partitioned by hash of the pair.
* A pair with a rare word is partitioned by that word, which holds at most one
  in `VOCABULARY` of all words, so no key of the shuffle is hot. All occurrences
  of a rare word as second of a pair, and those at the start of a document, meet
  in one partition, which so has the word's count. A pair of two rare words goes
  to both: that of the second word adds the score if the pair is not in the
  table, that of the first if it is.

Pairs of a document are deduplicated, delta-coded a batch of documents, and meet
their counts in their partition; a partition returns one partial sum a document,
and the sums are added up.

Defined results: null, empty and blank texts have 0 words and score null (no
word to score); repeated rows count as documents of their own and each gets its
score; an empty table gives no rows; other columns are ignored; doc_id may be
null or repeated (an internal row number ties sums to rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_spans, in_small_batches, materialize, mix64, pack, text_slices, unpack, word_spans

VOCABULARY, HEAD, LEAST, BACKOFF = 1_000_000, 512, 1, 0.4
#: Roles of a rare word: second of a pair with a numbered or a rare word, first of one with either, start of a document.
_AFTER, _AFTER_RARE, _BEFORE, _BEFORE_RARE, _START = range(5)
#: Bits of a word's number, words of a bucket of pairs, bytes of text coded together, and the unit of scores.
_BITS, _BUCKET, _SLICE, _UNIT = 20, 2_000_000, 8 << 20, 1e6
_NULL = -(2**63)


class Model:
    """The bounded tables every task holds: numbers and counts of words that are not rare, and counts of pairs of the most frequent."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, least: int = LEAST):
        self.least = least
        order = np.lexsort((hashes, -counts))
        self.total = total
        #: By number; number 0 is any rare word, which has no count here.
        self.counts = np.concatenate(([0], counts[order])).astype(np.int64)
        self.sorted = np.argsort(hashes[order], kind="stable")
        self.hashes = hashes[order][self.sorted]
        self.head = np.zeros((HEAD, HEAD), np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.sorted[at] + 1, 0)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log(count / self.total)

    def score(self, before: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores of words with the given counts after words counted `before`, of which pairs the corpus has n."""
        known = n >= self.least
        return np.where(known, np.log(np.where(known, n, 1) / before), math.log(BACKOFF) + self.unigram(count))


def _units(score: np.ndarray) -> np.ndarray:
    return np.rint(score * _UNIT).astype(np.int64)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, buf, offsets in text_slices(batches, most=_SLICE):
        starts, ends, _ = word_spans(buf, offsets)
        h, n = np.unique(hash_spans(buf, starts, ends), return_counts=True)
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])


def _pairs(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word numbers and hashes, first word of each row, and the place of each word that follows another of its row."""
    starts, ends, first = word_spans(buf, offsets)
    h = hash_spans(buf, starts, ends)
    w = model.numbers(h)
    follows = np.ones(len(w), bool)
    follows[first[:-1][first[:-1] < len(w)]] = False
    return w, h, first, np.flatnonzero(follows)


def _in_head(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v > 0) & (w > 0) & (v < HEAD) & (w < HEAD)


def _rare(w: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rare word, its role, the other word of the pair (number or hash), and document, of all that rare words take part in."""
    start = np.ones(len(w), bool)
    start[at] = False
    start = np.flatnonzero(start & (w == 0))
    second, first = at[w[at] == 0], at[w[at - 1] == 0]
    name = np.where(w == 0, h, w.astype(np.uint64))
    return (
        np.concatenate((h[start], h[second], h[first - 1])),
        np.concatenate((np.full(len(start), _START), np.where(w[second - 1] == 0, _AFTER_RARE, _AFTER), np.where(w[first] == 0, _BEFORE_RARE, _BEFORE))).astype(np.uint8),
        np.concatenate((np.zeros(len(start), np.uint64), name[second - 1], name[first])),
        np.concatenate((doc[start], doc[second], doc[first])),
    )


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the keys, first one first, and where in that order each new combination begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _spread(sums: np.ndarray, order: np.ndarray, where: np.ndarray) -> np.ndarray:
    """What each group has, at each of its rows."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(sums, np.diff(np.concatenate((where, [len(order)]))))
    return out


def train(docs: DataFrame, least: int = LEAST) -> Model:
    """Two passes over all texts: word counts, then counts of the most frequent words' pairs."""
    words = materialize(in_small_batches(docs.select("text")).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # more frequent than one in VOCABULARY: at most VOCABULARY rows; the others are counted in `score`
    frequent = words.where(F.col("n") * VOCABULARY > total).toPandas()
    model = Model(frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64), total, least)
    discard(words)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(HEAD * HEAD, np.int64)
        for _, buf, offsets in text_slices(batches, most=_SLICE):
            w, _, _, at = _pairs(shared.value, buf, offsets)
            v, w = w[at - 1], w[at]
            both = _in_head(v, w)
            seen += np.bincount(v[both] * HEAD + w[both], minlength=HEAD * HEAD)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some), pa.array(seen[some])], names=["pair", "n"])

    head = in_small_batches(docs.select("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most HEAD^2 rows
    model.head.reshape(-1)[head["pair"].to_numpy(np.int64)] = head["n"].to_numpy(np.int64)
    shared.unpersist()
    return model


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words and score (mean natural logarithm a word) of every document, under the model of the same documents."""
    spark = docs.sparkSession
    model = model or train(docs)
    shared = spark.sparkContext.broadcast(model)
    buckets = max(16, math.ceil(model.total / _BUCKET))
    mask = np.uint64((1 << _BITS) - 1)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a slice's documents, with scores as if no shuffled pair were in the table and without what rare words take part in. Kind 1: its pairs of numbered words of a bucket. Kind 2: the roles of rare words of a bucket."""
        model = shared.value
        for part, buf, offsets in text_slices(batches, most=_SLICE):
            w, h, first, at = _pairs(model, buf, offsets)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            units = np.zeros(len(w), np.int64)
            units[w > 0] = _units(model.unigram(model.counts[w[w > 0]]))
            roles = _rare(w, h, doc, at)
            at = at[(w[at - 1] > 0) & (w[at] > 0)]
            v = w[at - 1]
            both = _in_head(v, w[at])
            counts = np.zeros(len(at), np.int64)
            counts[both] = model.head[v[both], w[at][both]]
            units[at] = _units(model.score(model.counts[v], model.counts[w[at]], counts))
            # the second word of a pair with a rare first is scored there
            follows = np.flatnonzero((w[1:] > 0) & (w[:-1] == 0) & (doc[1:] == doc[:-1])) + 1
            units[follows] = 0
            base = np.concatenate(([0], np.cumsum(units)))
            ids = np.asarray(part.column("doc_id").fill_null(_NULL))
            slice_id = part.column("row")[0].as_py()
            out = [(slice_id % buckets, slice_id, 0, pack(ids.astype(np.int64), n.astype(np.int64), base[first[1:]] - base[first[:-1]]))]

            rest = at[~both]
            key = (w[rest - 1].astype(np.uint64) << np.uint64(_BITS)) | w[rest].astype(np.uint64)
            order = np.lexsort((key, doc[rest]))
            key, owner = key[order], doc[rest][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            where = np.flatnonzero(new)
            times = np.diff(np.concatenate((where, [len(key)])))
            key, owner = key[where], owner[where]
            bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, owner, times, bucket = key[order], owner[order], times[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                x = slice(edges[b], edges[b + 1])
                out.append((int(b), slice_id, 1, pack(np.diff(key[x], prepend=np.uint64(0)), owner[x].astype(np.uint32), times[x].astype(np.uint32))))

            order, where = _grouped(*roles)
            times = np.diff(np.concatenate((where, [len(order)])))
            rare, role, other, owner = (c[order][where] for c in roles)
            bucket = (mix64(rare) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rare, role, other, owner, times, bucket = (c[order] for c in (rare, role, other, owner, times, bucket))
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                x = slice(edges[b], edges[b + 1])
                out.append((int(b), slice_id, 2, pack(np.diff(rare[x], prepend=np.uint64(0)), role[x], other[x], owner[x].astype(np.uint32), times[x].astype(np.uint32))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "slice", "kind", "data"])

    def look_up(table: pa.Table) -> pa.Table:
        """What the shuffled pairs and rare words of a bucket add to their documents' scores."""
        model = shared.value
        slices, kinds, data = (table.column(c).to_pylist() for c in ("slice", "kind", "data"))
        out = [(s, 0, d) for s, k, d in zip(slices, kinds, data, strict=True) if k == 0]

        def give(parts: list[tuple[int, np.ndarray]], gain: np.ndarray) -> None:
            at = 0
            for s, owner in parts:
                mine = gain[at : at + len(owner)]
                at += len(owner)
                docs_, place = np.unique(owner[mine != 0], return_inverse=True)
                if len(docs_):
                    sums = np.zeros(len(docs_), np.int64)
                    np.add.at(sums, place, mine[mine != 0])
                    out.append((s, 1, pack(docs_.astype(np.uint32), sums)))

        parts = [(s, *unpack(d, "<u8", "<u4", "<u4")) for s, k, d in zip(slices, kinds, data, strict=True) if k == 1]
        if parts:
            key = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
            times = np.concatenate([p[3] for p in parts]).astype(np.int64)
            order, where = _grouped(key)
            n = _spread(np.add.reduceat(times[order], where), order, where)
            before, count = model.counts[(key >> np.uint64(_BITS)).astype(np.int64)], model.counts[(key & mask).astype(np.int64)]
            give([(p[0], p[2]) for p in parts], np.where(n >= model.least, _units(model.score(before, count, n)) - _units(model.score(before, count, np.zeros(len(key), np.int64))), 0) * times)

        parts = [(s, *unpack(d, "<u8", "u1", "<u8", "<u4", "<u4")) for s, k, d in zip(slices, kinds, data, strict=True) if k == 2]
        if parts:
            rare = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
            role, other = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            times = np.concatenate([p[5] for p in parts]).astype(np.int64)
            order, where = _grouped(rare)
            # every occurrence of the word is at the start of a document or after some word
            own = _spread(np.add.reduceat(np.where(np.isin(role, (_START, _AFTER, _AFTER_RARE)), times, 0)[order], where), order, where)
            order, where = _grouped(rare, role, other)
            n = np.where(role == _START, 0, _spread(np.add.reduceat(times[order], where), order, where))
            numbered = model.counts[np.where((role == _AFTER) | (role == _BEFORE), other, np.uint64(0)).astype(np.int64)]
            before, count = np.where(role == _AFTER, numbered, own), np.where(role == _BEFORE, numbered, own)
            units = _units(np.where(role == _START, model.unigram(own), model.score(np.maximum(before, 1), count, n)))
            elsewhere = ((role == _AFTER_RARE) & (n >= model.least)) | ((role == _BEFORE_RARE) & (n < model.least))
            give([(p[0], p[4]) for p in parts], np.where(elsewhere, 0, units) * times)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary())], names=["slice", "kind", "data"])

    def add_up(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        ids, n, units = unpack(data[kinds.index(0)], "<i8", "<i8", "<i8")
        units = units.copy()
        for k, d in zip(kinds, data, strict=True):
            if k == 1:
                docs_, sums = unpack(d, "<u4", "<i8")
                units[docs_] += sums
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = units / _UNIT / n
        return pa.table([pa.array(ids, mask=ids == _NULL), pa.array(n), pa.array(mean, mask=n == 0)], names=["doc_id", "n_words", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    coded = in_small_batches(rows).mapInArrow(code, "bucket long, slice long, kind int, data binary")
    found = coded.groupBy("bucket").applyInArrow(look_up, "slice long, kind int, data binary")
    return found.groupBy("slice").applyInArrow(add_up, "doc_id long, n_words long, score double")
