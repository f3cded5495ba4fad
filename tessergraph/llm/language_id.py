"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the `top` most frequent character n-grams (n = 1..3, words
lower-cased and padded with a blank). A document's own profile is compared to
each language profile by the out-of-place distance: the sum over the document's
n-grams of the difference of ranks, `top` for an n-gram the profile lacks. The
nearest profile wins.

An n-gram of three code points is packed exactly into 63 bits, so ranking is
sorting integers in numpy. Profiles are learned from a bounded sample of the
labelled rows (`sample_rows` a language, chosen by a hash of doc_id), which is
the one bound here; prediction reads every whole text.

Defined results: null, empty and letterless texts give lang_pred `und` and
score 0; ties between languages go to the smaller name; ties of counts within a
profile to the smaller n-gram; no labelled rows at all give `und` for all; an
empty table gives no rows; repeated rows are each predicted; further columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches

UNDETERMINED = "und"
_BLANK = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """All packed 1- to 3-grams of a text: lower-cased letters, runs of others as one blank. Empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    codes = np.concatenate(([_BLANK], codes[keep], [_BLANK])).astype(np.uint64)
    shift = np.uint64(21)
    two = (codes[:-1] << shift) | codes[1:]
    three = (two[:-1] << shift) | codes[2:]
    one = codes[codes != _BLANK]
    two = two[two != np.uint64((_BLANK << 21) | _BLANK)]
    return np.concatenate((one, two, three))


def profile(grams: np.ndarray, top: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The most frequent n-grams by rank."""
    if counts is None:
        grams = np.sort(grams)
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        counts = np.diff(np.concatenate((first, [len(grams)])))
        grams = grams[first]
    if len(grams) > 4 * top:  # only counts that can be among the top need sorting
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:top]]


class Profiles:
    """Language profiles as one sorted n-gram table with a rank for each language."""

    def __init__(self, ranked: dict[str, np.ndarray], top: int):
        self.names, self.top = sorted(ranked), top
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *ranked.values()]))
        self.ranks = np.full((len(self.grams), len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, ranked[name]), k] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text else np.zeros(0, np.uint64)
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        own = profile(grams, self.top)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.top).sum(0)
        k = int(np.argmin(apart))
        return self.names[k], float(1 - apart[k] / (self.top * len(own)))


def learn(labelled: DataFrame, top: int = 400, sample_rows: int = 3000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Profiles:
    """Profiles from at most about `sample_rows` labelled rows of each language.

    The sample is the rows whose hash falls below a share of the hash space set
    from the language's row count, so it is the same on every run. N-gram counts
    are summed on the executors; each language's `top` n-grams reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    # a row a label: the driver holds as much as the profiles themselves, `top` n-grams a label
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, top)
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, sample_rows / n)))])
    picked = rows.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(ngrams(value))
            for name, parts in by.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    totals = in_small_batches(picked).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked: dict[str, list[int]] = {}
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    for r in totals.withColumn("rank", order).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({name: np.array(grams, np.uint64) for name, grams in ranked.items()}, top)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The input's columns, the text only with `keep_text`, with lang_pred and score of each whole text."""
    others = [c for c in docs.columns if (keep_text or c != text) and c not in ("lang_pred", "score")]
    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(value.as_py()) for value in batch.column(text)]
            columns = [batch.column(c) for c in others] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.record_batch(columns, names=[*others, "lang_pred", "score"])

    return in_small_batches(docs.select(*others, *([] if keep_text else [text]))).mapInArrow(label, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows not learned from: the remainder of crc32 of the id as text by three is one."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def keep_identified(docs: DataFrame, top: int = 400, sample_rows: int = 3000) -> DataFrame:
    """The documents whose language is determined, in the input's columns; a missing lang is filled with the prediction."""
    known = predict(docs, learn(docs.where(~held_out()), top, sample_rows), keep_text=True).where(F.col("lang_pred") != UNDETERMINED)
    return known.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def identify(docs: DataFrame, top: int = 400, sample_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from labelled rows that are not held out."""
    # a null doc_id has no remainder: such a row is not held out, and not learned from
    profiles = learn(docs.where(~held_out()), top, sample_rows)
    ids = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(ids, profiles)
