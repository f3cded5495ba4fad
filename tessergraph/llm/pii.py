"""Personal data: fixed-pattern spans, and further spans from a semi-Markov
conditional random field (Sarawagi and Cohen, 2004).

Base spans (email, ip, card, phone) come from regular expressions with checks;
see `base_spans`. The random field segments the surroundings of digits and `@`
into entities of up to `MOST_TOKENS` tokens and single other tokens. A candidate
segment is scored as a whole: digits in it, Luhn's check, values of dotted
parts, separators, its shape, the words beside it and whether it stands free.
Bounded-entity dynamic programming chooses boundaries and types jointly; its
state is the place in the text and whether an entity ends there. Tokens outside
the windows hold no candidate, so leaving them out changes nothing.

Weights are learned here by maximum likelihood with stochastic gradients: from
windows of a bounded sample of documents (`sample_docs` in expectation, chosen by
hash of doc_id; at most `most` windows of at most `longest` characters, which bound
what is learned from and not what is searched) whose labels are the base spans, from the same windows with
spans rewritten into forms the patterns don't cover (a phone number without its
plus sign), and from made-up windows that show all types and numbers that are
none (dates, amounts, versions, times). An entity is reported if its posterior
probability is at least `CONFIDENT` and it touches no base span.

Defined results: null and empty texts have no spans (counts 0, digest of the
empty string); repeated rows are each searched; an empty table gives no rows;
texts of any length are read whole, windows of any length are searched in time
linear in their tokens; counts are those of base spans; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_SPACES, FEATURES, CONFIDENT, SEED = 16, 6, 1 << 14, 0.9, 77
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that has failed at its begin fails at each later digit as well, so searches start at runs only
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
# possessive and from a word's begin, so that long words cost linear time
_HOT = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of all base spans, by kind as listed and then by start."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        # the local part is the run before the sign, after the last match
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and `@`, with a word or two on either side."""
    out: list[list[int]] = []
    for m in _HOT.finditer(text):
        a, b = max(0, m.start() - 24), min(len(text), m.end() + 24)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    # not through a word
    return [(a if a == 0 or text[a - 1].isspace() else next((k for k in range(a, b) if text[k].isspace()), a), b) for a, b in out]


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % FEATURES


def _admissible(kind: str, s: str, n_digits: int) -> bool:
    if kind == "email":
        return " " not in s and s.count("@") == 1 and 0 < s.index("@") < len(s) - 1 and all(c in _LOCAL or c == "@" for c in s)
    if kind == "ip":
        return s.count(".") == 3 and all(c == "." or "0" <= c <= "9" for c in s)
    if kind == "card":
        return 12 <= n_digits <= 19 and all(c in " -" or "0" <= c <= "9" for c in s)
    return 7 <= n_digits <= 15 and all(c in " ().-/+" or "0" <= c <= "9" for c in s)


def _features(kind: str, s: str, digits: str, before: str, after: str, word: str, n: int) -> list[int]:
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 6)), s))
    f = [("bias",), ("shape", shape), ("coarse", re.sub(r"[0-9]+", "9", shape)), ("digits", len(digits)), ("tokens", min(n, 12)), ("free", not before.strip() and not after.strip().isalnum()), ("before", before), ("after", after.isalnum()), ("word", word), ("first", s[0] if not s[0].isalnum() else "x"), ("balanced", s.count("(") == s.count(")"))]
    if kind == "card":
        f.append(("luhn", bool(digits) and luhn(digits)))
    if kind == "ip":
        f.append(("parts", all(len(p) <= 3 and int(p or 999) <= 255 for p in s.split("."))))
    if kind == "email":
        tail = s.rsplit("@", 1)[1]
        f.append(("domain", "." in tail.strip("."), tail[-1].isalpha()))
    return [_hash(kind, *x) for x in f]


class Lattice:
    """Tokens of a window and its candidate segments: (first token, token after the last, kind, features)."""

    def __init__(self, text: str, a: int, b: int):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
        self.segments: list[tuple[int, int, str, list[int]]] = []
        spans = self.tokens
        for i, (start, _) in enumerate(spans):
            head = text[start]
            if not (head.isalnum() or head in "+("):
                continue
            for j in range(i + 1, min(len(spans), i + MOST_TOKENS) + 1):
                end = spans[j - 1][1]
                if j - 1 > i and ("\n" in text[spans[j - 2][1] : spans[j - 1][0]] or spans[j - 1][0] - spans[j - 2][1] > 2):
                    break
                s = text[start:end]
                if not s[-1].isalnum() or s.count(" ") > MOST_SPACES:
                    continue
                digits = _digits(s)
                if not digits and "@" not in s:
                    continue
                kinds = [k for k in KINDS if _admissible(k, s, len(digits))]
                if kinds:
                    before, after = text[start - 1 : start], text[end : end + 1]
                    word = text[spans[i - 1][0] : spans[i - 1][1]].lower() if i else ""
                    word = word if word.isalpha() and len(word) <= 8 else "#"
                    self.segments += [(i, j, k, _features(k, s, digits, before, after, word, j - i)) for k in kinds]

    def forward(self, weights: np.ndarray) -> tuple[list[float], list[float], list[list[float]], list[list[float]]]:
        """Scores of segments, posterior probabilities, and both passes; a token outside entities scores 0."""
        n = len(self.tokens)
        scores = [float(weights[f].sum()) for *_, f in self.segments]
        adjacent = float(weights[_ADJACENT])
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(self.segments):
            ending[j].append(k)
            starting[i].append(k)
        low = -1e30
        ahead = [[low, low] for _ in range(n + 1)]  # after a plain token, after an entity
        ahead[0][0] = 0.0
        for t in range(1, n + 1):
            ahead[t][0] = float(np.logaddexp(*ahead[t - 1]))
            for k in ending[t]:
                i = self.segments[k][0]
                ahead[t][1] = float(np.logaddexp(ahead[t][1], scores[k] + np.logaddexp(ahead[i][0], ahead[i][1] + adjacent)))
        back = [[low, low] for _ in range(n + 1)]
        back[n] = [0.0, 0.0]
        for t in range(n - 1, -1, -1):
            plain = [back[t + 1][0]] * 2
            for k in starting[t]:
                x = scores[k] + back[self.segments[k][1]][1]
                plain = [float(np.logaddexp(plain[0], x)), float(np.logaddexp(plain[1], x + adjacent))]
            back[t] = plain
        total = float(np.logaddexp(*ahead[n]))
        posterior = [float(np.exp(min(0.0, np.logaddexp(ahead[i][0], ahead[i][1] + adjacent) + scores[k] + back[j][1] - total))) for k, (i, j, _, _) in enumerate(self.segments)]
        return scores, posterior, ahead, back

    def best(self, weights: np.ndarray) -> list[int]:
        """The segments of the best segmentation (Viterbi)."""
        n = len(self.tokens)
        adjacent = float(weights[_ADJACENT])
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j, _, _) in enumerate(self.segments):
            ending[j].append(k)
        best: list[list[tuple[float, int, int]]] = [[(-1e30, -1, 0), (-1e30, -1, 0)] for _ in range(n + 1)]
        best[0][0] = (0.0, -1, 0)
        for t in range(1, n + 1):
            state = 0 if best[t - 1][0][0] >= best[t - 1][1][0] else 1
            best[t][0] = (best[t - 1][state][0], -1, state)
            for k in ending[t]:
                i, _, _, f = self.segments[k]
                plain, after = best[i][0][0], best[i][1][0] + adjacent
                score = float(weights[f].sum()) + max(plain, after)
                if score > best[t][1][0]:
                    best[t][1] = (score, k, int(after > plain))
        out, t, state = [], n, 0 if best[n][0][0] >= best[n][1][0] else 1
        while t:
            _, k, before = best[t][state]
            if k >= 0:
                out.append(k)
                t = self.segments[k][0]
            else:
                t -= 1
            state = before
        return out[::-1]


_ADJACENT = _hash("adjacent")


def _example(text: str, spans: list[Span]) -> tuple[Lattice, list[int]]:
    lattice = Lattice(text, 0, len(text))
    wanted = set(spans)
    return lattice, [k for k, (i, j, kind, _) in enumerate(lattice.segments) if (kind, lattice.tokens[i][0], lattice.tokens[j - 1][1]) in wanted]


def _made_up(rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Windows with a number or address of each type, and with numbers that are none of them."""
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    words = lambda: " ".join("".join(rng.choice("aeinrstlodhu") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 4)))
    out = []
    for _ in range(60):
        number = d(15)
        card = next(number + c for c in "0123456789" if luhn(number + c))
        sep = rng.choice(["", "", " ", "-"])
        card = sep.join(card[k : k + 4] for k in range(0, 16, 4))
        phone = rng.choice(["+1 (%s) %s-%s", "+1 %s %s %s", "(%s) %s-%s", "(%s) %s %s"]) % (d(3), d(3), d(4))
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        email = f"{words().replace(' ', '.')}{rng.choice(['', d(2)])}@{words().split()[0]}.{rng.choice(['com', 'org', 'net', 'de'])}"
        for kind, value in zip(KINDS, (email, ip, card, phone), strict=True):
            left = words() + " "
            out.append((f"{left}{value} {words()}", [(kind, len(left), len(left) + len(value))]))
        none = [f"{rng.randrange(1900, 2100)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(rng.randrange(1, 7))}.{d(2)}", f"{d(2)}:{d(2)}", d(rng.randrange(1, 12)), f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"{rng.randrange(256, 999)}.{d(3)}.{d(3)}.{d(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40))]
        out += [(f"{words()} {x} {words()}", []) for x in none]
    return out


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> np.ndarray:
    """Weights by stochastic gradients of the log likelihood."""
    rng, weights = random.Random(seed), np.zeros(FEATURES)
    weights[[_hash(k, "bias") for k in KINDS]] = -2.0
    lattices = [x for x in (_example(*e) for e in examples) if x[0].segments]
    for epoch in range(epochs):
        rng.shuffle(lattices)
        step = rate / (1 + epoch)
        for lattice, gold in lattices:
            _, posterior, _, _ = lattice.forward(weights)
            for k, p in enumerate(posterior):
                slope = (k in gold) - p
                if abs(slope) > 1e-4:
                    f = lattice.segments[k][3]
                    weights[f] += step * (slope - decay * weights[f])
    return weights


def learn(docs: DataFrame, sample_docs: int = 4000, most: int = 1500, longest: int = 400) -> np.ndarray:
    """Weights from windows of about `sample_docs` documents; of those of up to `longest` characters at most `most` reach the driver."""
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    key = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, text[a:b]) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in windows(text) if b - a <= longest]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["key", "window"])

    sample = docs.where(key < share * (1 << 30)).where(F.col("text").rlike("[0-9@]")).select(key.alias("key"), "text")
    sample = in_small_batches(sample).mapInArrow(cut, "key long, window string")
    real = [(r["window"], base_spans(r["window"])) for r in sample.orderBy("key", "window").limit(most).collect()]
    bare = []
    for text, spans in real:
        for kind, a, b in spans:
            at = text.find("(", a, b)
            if kind == "phone" and at > a:  # the same number without the plus sign and country
                bare.append((text[:a] + text[at:], [("phone", a, a + b - at)]))
    return fit(real + bare + _made_up(random.Random(SEED)))


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base, added = base_spans(text), []
    for a, b in windows(text):
        lattice = Lattice(text, a, b)
        if not lattice.segments:
            continue
        chosen = lattice.best(weights)
        if not chosen:
            continue
        new = [(k, lattice.segments[k][2], lattice.tokens[lattice.segments[k][0]][0], lattice.tokens[lattice.segments[k][1] - 1][1]) for k in chosen]
        new = [x for x in new if not any(s < x[3] and e > x[2] for _, s, e in base)]
        if new:
            posterior = lattice.forward(weights)[1]
            added += [(kind, s, e) for k, kind, s, e in new if posterior[k] >= CONFIDENT]
    return base, added


_INTEREST = np.zeros(256, bool)
_INTEREST[[*range(48, 58), 64]] = True


def detect(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) of every document."""
    weights = learn(docs) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            hits = np.concatenate(([0], np.cumsum(_INTEREST[buf])))[offsets]
            base, added = [[]] * batch.num_rows, [[]] * batch.num_rows
            for k in np.flatnonzero(np.diff(hits)).tolist():
                base[k], added[k] = ([{"kind": x[0], "start": x[1], "end": x[2]} for x in part] for part in find(batch.column(1)[k].as_py(), shared.value))
            yield pa.record_batch([batch.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, added {span}"
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _is(kind: str):
    return lambda s: s.kind == kind


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s.kind)
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return detect(docs).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
