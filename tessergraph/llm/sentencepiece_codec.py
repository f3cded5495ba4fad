"""SentencePiece encoding and decoding with a unigram model: Viterbi search over
a double-array trie of pieces with log scores, byte fallback, and white-space
markers.

The public vocabulary on this machine is a BPE model whose scores are ranks.
Nothing is trained: the unigram model takes its pieces, and the log score of
rank r is -log(r + 1) - log(sum of 1/(k + 1)) (Zipf's law over the ranks).

Spaces are piece bytes themselves: the marker U+2581 of a piece is stored as
0x20, so text needs no escaping, and a marker that the text itself holds falls
back to bytes and survives decoding. A space is put before the text and taken
off again on decoding. No piece holds a marker after another character, so a
text is cut before each run of spaces and its parts are encoded on their own:
the best path of the whole is the best paths of the parts. A slice's distinct
parts are searched together by length, position by position, as arrays; a part
of another length than all others goes through the same search alone. A character no
piece covers costs the least score less 10 and becomes its UTF-8 bytes.

Defined results: null text gives null ids and null decoded text; an empty text
gives the one piece of its leading space and decodes to the empty text; ties
between paths go to the piece that begins earlier; repeated rows are each
encoded; an empty table gives no rows; other columns are kept or ignored as the
caller says.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_spans, in_small_batches, ranges, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
_SLICE = 4 << 20
_models: dict[str, UnigramModel] = {}


class DoubleArray:
    """Double-array trie over byte strings: child of s by byte c is base[s] + c, if check[] of it is s."""

    def __init__(self, pieces: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for piece, value in pieces.items():
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = value
        room = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        free = np.ones(room, bool)
        free[0] = False
        place, lowest, queue = {0: 0}, 1, [0]
        for node in queue:
            at = place[node]
            self.value[at] = values[node]
            keys = sorted(children[node])
            if not keys:
                self.base[at] = 0
                continue
            while not free[lowest]:
                lowest += 1
            b = max(1, lowest - keys[0])
            wide = np.array(keys)
            while True:
                if b + 256 >= len(free):
                    grow = len(free)
                    free = np.concatenate((free, np.ones(grow, bool)))
                    self.base, self.check, self.value = (np.concatenate((x, np.full(grow, f, np.int32))) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                if free[b + wide].all():
                    break
                # the next place where the first child fits
                nxt = np.flatnonzero(free[b + keys[0] + 1 : b + keys[0] + 4096])
                b += int(nxt[0]) + 1 if len(nxt) else 4096
            self.base[at] = b
            for c in keys:
                place[children[node][c]] = b + c
                free[b + c] = False
                self.check[b + c] = at
                queue.append(children[node][c])
        size = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = self.base[:size].copy(), self.check[:size].copy(), self.value[:size].copy()
        if len(self.check) < size:
            pad = size - len(self.check)
            self.base, self.check, self.value = (np.concatenate((x, np.full(pad, f, np.int32))) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))


class UnigramModel:
    def __init__(self, pieces: dict[bytes, int], scores: dict[int, float], byte_ids: list[int], table: dict[int, bytes]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        self.trie = DoubleArray(pieces)
        top = max(table) + 1
        self.scores = np.zeros(top)
        for k, v in scores.items():
            self.scores[k] = v
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces))
        sizes = np.array([len(table.get(k, b"")) for k in range(top)])
        self.piece_at = np.concatenate(([0], np.cumsum(sizes)))
        self.piece_bytes = np.frombuffer(b"".join(table.get(k, b"") for k in range(top)), np.uint8)

    @classmethod
    def load(cls, path: str = MODEL) -> UnigramModel:
        """The model of a vocabulary file, made once a process."""
        if path not in _models:
            import sentencepiece

            source = sentencepiece.SentencePieceProcessor(model_file=path)
            every = range(source.get_piece_size())
            bytes_ = {int(source.id_to_piece(k)[3:5], 16): k for k in every if source.is_byte(k)}
            normal = [k for k in every if not (source.is_byte(k) or source.is_control(k) or source.is_unknown(k))]
            text = {k: source.id_to_piece(k).replace("▁", " ").encode() for k in normal}
            if any(b" " in p.lstrip(b" ") for p in text.values()):
                raise ValueError("a piece holds a white-space marker after another character")
            ranked = sorted(normal, key=lambda k: (-source.get_score(k), k))
            mass = np.log((1 / np.arange(1, len(ranked) + 1)).sum())
            scores = {k: float(-np.log(r + 1) - mass) for r, k in enumerate(ranked)}
            _models[path] = cls({p: k for k, p in text.items()}, scores, [bytes_[b] for b in range(256)], text | {k: bytes([b]) for b, k in bytes_.items()})
        return _models[path]

    def _search(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of parts of one length (rows of bytes): ids, and pieces a row, as for `encode_parts`."""
        rows, length = part.shape
        trie = self.trie
        begins = (part & 0xC0) != 0x80
        best = np.full((length + 1, rows), -np.inf)
        best[0] = 0
        came, via = np.zeros((length + 1, rows), np.int32), np.full((length + 1, rows), -1, np.int32)
        # where the character at each position ends
        ends = np.full((rows, length + 1), length, np.int32)
        for p in range(length - 1, -1, -1):
            ends[:, p] = np.where(begins[:, p], p, ends[:, p + 1])
        for p in range(length):
            live = np.flatnonzero(begins[:, p])
            if not len(live):
                continue
            state, at, covered = np.zeros(len(live), np.int32), live, np.zeros(rows, bool)
            stop = ends[live, p + 1]
            for q in range(p, min(length, p + self.longest)):
                following = trie.base[state] + part[at, q]
                good = trie.check[following] == state
                good &= following > 0
                if not good.all():
                    at, state = at[good], following[good]
                else:
                    state = following
                if not len(at):
                    break
                value = trie.value[state]
                hit = value >= 0
                if hit.any():
                    rows_, ids = at[hit], value[hit]
                    covered[rows_[ends[rows_, p + 1] == q + 1]] = True
                    total = best[p, rows_] + self.scores[ids]
                    better = total > best[q + 1, rows_]
                    chosen = rows_[better]
                    best[q + 1, chosen], came[q + 1, chosen], via[q + 1, chosen] = total[better], p, ids[better]
            bare = ~covered[live]
            if bare.any():
                rows_, to = live[bare], stop[bare]
                total = best[p, rows_] + self.unknown
                better = total > best[to, rows_]
                best[to[better], rows_[better]], came[to[better], rows_[better]], via[to[better], rows_[better]] = total[better], p, -1
        # back from the end, all rows together
        at, rows_, steps = np.full(rows, length), np.arange(rows), []
        while len(rows_):
            here = at[rows_]
            back, ids = came[here, rows_], via[here, rows_]
            known = ids >= 0
            for width in range(4, 0, -1):  # the bytes of an unknown character, last first
                some = ~known & (here - back >= width)
                if some.any():
                    steps.append((rows_[some], self.byte_ids[part[rows_[some], back[some] + width - 1]]))
            if known.any():
                steps.append((rows_[known], ids[known]))
            at[rows_] = back
            rows_ = rows_[back > 0]
        row, ids = np.concatenate([s[0] for s in steps])[::-1], np.concatenate([s[1] for s in steps])[::-1]
        order = np.argsort(row, kind="stable")
        return ids[order].astype(np.int32), np.bincount(row, minlength=rows)

    def encode_parts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, one part after the other, and the number of each part's ids."""
        length = ends - starts
        counts, found = np.zeros(len(starts), np.int64), []
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            size = int(length[order[a]])
            step = max(1, 2_000_000 // (size + 1))
            for c in range(a, b, step):
                rows = order[c : min(b, c + step)]
                ids, n = self._search(buf[starts[rows][:, None] + np.arange(size)])
                counts[rows] = n
                found.append((rows, ids, n))
        where = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(where[-1]), np.int32)
        for rows, ids, n in found:
            out[ranges(where[rows], n)] = ids
        return out, counts

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows one after the other, and the rows' offsets in them."""
        rows = len(offsets) - 1
        spaced = np.full(len(buf) + rows, 32, np.uint8)
        first = offsets[:-1] + np.arange(rows)
        keep = np.ones(len(spaced), bool)
        keep[first] = False
        spaced[keep] = buf
        cut = spaced == 32
        cut[1:] &= spaced[:-1] != 32
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate((starts[1:], [len(spaced)]))
        h = hash_spans(spaced, starts, ends)
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, n = self.encode_parts(spaced, starts[one], ends[one])
        at = np.concatenate(([0], np.cumsum(n)))
        out = ids[ranges(at[inverse], n[inverse])]
        total = np.concatenate(([0], np.cumsum(n[inverse])))
        return out, total[np.searchsorted(starts, np.concatenate((first, [len(spaced)])))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and the rows' offsets in them: pieces with spaces for markers, without the leading one."""
        size = np.diff(self.piece_at)[ids]
        data = self.piece_bytes[ranges(self.piece_at[ids], size)]
        at = np.concatenate(([0], np.cumsum(size)))[offsets]
        keep = np.ones(len(data), bool)
        first = at[:-1][at[1:] > at[:-1]]
        keep[first[data[first] == 32]] = False
        return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """The columns `keep`, ids (array of int) and round_trip: whether decoding gives the text back byte for byte; with `decoded` the decoded text too."""
    shared = docs.sparkSession.sparkContext.broadcast(UnigramModel.load(model))  # a vocabulary's size, whatever the table
    keep = tuple(c for c in keep if c not in ("ids", "round_trip", "decoded"))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = shared.value
        for part, buf, offsets in text_slices(batches, "_text", _SLICE):
            ids, at = unigram.encode(buf, offsets)
            back, back_at = unigram.decode(ids, at)
            same = np.diff(back_at) == np.diff(offsets)
            if same.all():
                wrong = np.concatenate(([0], np.cumsum(back != buf)))
                same = wrong[offsets[1:]] == wrong[offsets[:-1]]
            else:
                same = np.array([np.array_equal(back[c:d], buf[a:b]) for a, b, c, d in zip(offsets[:-1], offsets[1:], back_at[:-1], back_at[1:], strict=True)])
            null = np.asarray(part.column("_text").is_null())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            columns = [part.column(c) for c in keep] + [lists, pa.array(same, mask=null)]
            if decoded:
                values = back.tobytes()
                columns.append(pa.array([None if z else values[a:b].decode(errors="replace") for a, b, z in zip(back_at[:-1], back_at[1:], null, strict=True)], pa.string()))
            yield pa.record_batch(columns, names=[f.name for f in schema])

    return in_small_batches(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns `keep` and the text of each row's ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(UnigramModel.load(model))
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = shared.value
        for batch in batches:
            lists = batch.column("_ids")
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            data, at = unigram.decode(np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(n))))
            values = data.tobytes()
            texts = [None if z else values[a:b].decode(errors="replace") for a, b, z in zip(at[:-1], at[1:], lists.is_null().to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[f.name for f in schema])

    return in_small_batches(encoded.select(*keep, F.col(ids).alias("_ids"))).mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip of every document."""
    return encode(docs, model=model).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "round_trip", "ids")


