"""Secret scans: fixed-pattern spans, and further tokens found by a battery of
randomness tests with length-aware false-discovery control. Spark SQL
expressions only: higher-order functions over arrays, which Spark evaluates
outside whole-stage code generation but in the JVM.

Base spans (kinds assign, access, hex) are regular expressions; see `_PATTERNS`.
Positions come from marking each match in place and adding up the lengths of the
pieces between marks. Running sums over an array of n go by blocks of its square
root (`_running`), so a text of many matches doesn't copy a growing array.

The battery looks at tokens of [A-Za-z0-9+/_-] that hold letters and digits and
touch no base span, and within them at each part without separators (+/_-) that
holds both. `MIN_TOKEN` is no threshold of significance, which depends on length
below: of fewer symbols no alphabet here makes 48 bits. The encoding is inferred
for each as the smallest alphabet holding its letters and digits: hex, base32 or
base36 of one case, in which separators are left out, else base64.

The battery has three tests, each of two hypotheses: symbols drawn uniformly from
the inferred alphabet, or ordinary text, a chain that goes from one of lower case,
capitals and digits to another with probability `ORDINARY_CHANGES` and in which
letters follow letters as `_PAIRS` has them.
  * uniformity: the G form of the chi-squared test over all symbols of the
    alphabet, log likelihood ratio of their frequencies;
  * runs: log likelihood ratio of the number of changes of class;
  * serial correlation at lag one: log likelihood ratio of letters given the
    letter before against letters alone.
The sum of the three is the log likelihood ratio of the whole token, so by
Markov's inequality p = `ENCODINGS` (for the choice of alphabet) * exp(-sum) is
a p-value of the hypothesis that the token is ordinary: the battery's combined
p-value. It is set to 1, which keeps it valid, for a token that isn't random
either: where the classical tests against uniform symbols (chi-squared over the
alphabet, Wald-Wolfowitz runs above and below its middle, serial correlation of
symbol values) reject uniformity, with three times the least of their p-values
below `COMPATIBLE`.

The combined p-values of all candidates of the table go through the
Benjamini-Hochberg procedure, weighted by length (weights proportional to length,
mean one; Genovese, Roeder and Wasserman, 2006) at level `FDR`: short tokens need
stronger evidence, and of the tokens reported about `FDR` at most are ordinary, as
far as ordinary tokens are like that chain. A part within a reported token is not
reported again. The cut comes from a histogram of p-values with at most 2000
bins, so the driver sees one number.

Defined results: a null or empty text has no spans (counts 0, empty strings; the
digest is that of the empty string); repeated rows are each scanned; an empty
table gives no rows; marks that the text itself holds are read as any other
character outside the patterns; other columns are ignored, or kept by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex")
MIN_TOKEN, ORDINARY_CHANGES, COMPATIBLE, FDR, BINS = 8, 0.15, 0.001, 0.01, 2000
ENCODINGS = 4
_MARK = "\x02"
#: Patterns in Java's syntax. Where the least length can be part of the pattern without changing what is found, it is.
_PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Cheap necessary conditions, so that texts without a match are not rewritten.
_MAYBE = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Of each letter (a row; the first row is the start of a word) and the letter after it -8 ln(probability) as a character
#: from "0" on, from words of four languages and of program text, smoothed.
_PAIRS = "".join((
    r"DOHFAKQOJ\WIKFGKOHECMQQa^]",
    r"PPFGM[QYF\YEI@RQZBCBCTZZWc",
    r"F]PV9_^[KFc>\V?XbNNUFbcbMa",
    r"GaWZE]`9AcKIXW?\aOTDQaac^d",
    r"EVVN8Z^S@acQ]Q<\cOKNLaZ`Zd",
    r"EVKIIOVWG_\EP?PQW>CGNUYOYR",
    r"CWTVFGWW<e]HZU<YaCLJG[`cX]",
    r">SU\9_TLGe[KXIMWcKCMIV[cbX",
    r"?OS\7_UMFeVNZNEU_NKGRVVc`W",
    r"LTFP@SQZT`_IK;BRYMGAZRaXcU",
    r"4aT\=`a\UeY[_WG\cXVWIccc`d",
    r"M`UR4[U[GebJ]MRTaSGUQ^Jc`d",
    r"EZVP:B\\Aaa@ZUGW_UILL__cHb",
    r"AM[U6^`\AeaUQVEDcWMSPbbc]d",
    r"DQHB@VCQJ\UNSODTVNH>ORYc\Z",
    r"ONKHOSV\I[YOJ;QM[@DHAWR_ba",
    r"<_VT@E_WKe_E\VBJaCQDNX^cNd",
    r"Xa]\S`a\YddZ_VY`cVXX1ccccd",
    r"AROR9YLSF^VROHEV]EIGOVYcQ[",
    r"IVCS;]RHFW[PPTKOUOG=J_[bSd",
    r"DXSW>Y\<@d^RXTKV`CKLI[XaON",
    r"LRQX:QWXMe^HK@NLXBJGXX`Bc_",
    r"=`[]6^_[<ec[XUG]cXYW\b_bcc",
    r"@_ZRGZ`9=ddQ^KF]cDNU[`Y^cd",
    r"C\?YAV_YFecLNWGEPIS;[PaUYb",
    r"MQRTBVZNHedNMHH<bO@?[[Mb\]",
    r"GMJS=`PTHUUNNUOUTONL8Vcc`V",
))
_TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
_TOKEN_MAYBE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{{{MIN_TOKEN}}}"
_PART, _SEPARATOR = rf"[A-Za-z0-9]{{{MIN_TOKEN},}}", "[+/_-]"


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, add, zero: Column) -> Column:
    """Running totals by `add` of an array, each with its own element: block by block of the square root of its size, then blocks put after one another."""

    def scan(block: Column) -> Column:
        last = lambda so_far: F.when(F.size(so_far) > 0, F.element_at(so_far, -1)).otherwise(zero)
        return F.aggregate(block, F.slice(F.array(zero), 1, 0), lambda so_far, x: F.concat(so_far, F.array(add(last(so_far), x))))

    def joined(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0))), lambda k: scan(F.slice(v, k * width + 1, width)))
        return _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.concat(F.array(zero), scan(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda x: F.element_at(x, -1)))), lambda block, before: F.transform(block, lambda x: add(before, x)))))

    return F.when(F.size(values) > 0, _let(values, joined)).otherwise(F.slice(F.array(zero), 1, 0))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _before(totals: Column, zero: Column) -> Column:
    """Of running totals, those without their own element."""
    return F.when(F.size(totals) > 0, F.concat(F.array(zero), F.slice(totals, 1, F.greatest(F.size(totals) - 1, F.lit(0))))).otherwise(totals)


def _spans(text: Column, kind: str, pattern: str, maybe: str, keep) -> Column:
    """Array of (start, end, kind, token) of the pattern's leftmost non-overlapping matches that `keep` accepts."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, "\x03"), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    span = lambda p, end: F.struct((end - F.length(p)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p.alias("token"))
    placed = _let(pieces, lambda all_: F.zip_with(all_, _running(F.transform(all_, F.length), _sum, F.lit(0)), span))
    # text and matches take turns
    found = F.filter(placed, lambda x, k: (k % 2 == 1) & keep(x.token))
    return F.when(text.rlike(maybe), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>"))


def _untouched(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, in time of a sort: seen from the left no span before it ends after its start, from the right none after it starts before its end."""
    event = lambda rank: lambda x: F.struct(x.start.alias("start"), F.lit(rank).alias("rank"), x.end.alias("end"), x.kind.alias("kind"), x.token.alias("token"))
    far = 2**31 - 1

    def kept(all_: Column) -> Column:
        ended = _before(_running(F.transform(all_, lambda x: F.when(x.rank == 0, x.end).otherwise(0)), F.greatest, F.lit(0)), F.lit(0))
        begins = F.reverse(_before(_running(F.transform(F.reverse(all_), lambda x: F.when(x.rank == 0, x.start).otherwise(far)), F.least, F.lit(far)), F.lit(far)))
        free = F.zip_with(all_, F.arrays_zip(ended.alias("e"), begins.alias("b")), lambda x, y: F.struct(x.alias("x"), ((x.rank == 1) & (y["e"] <= x.start) & (y["b"] >= x.end)).alias("free")))
        return F.transform(F.filter(free, lambda y: y.free), lambda y: F.struct(*[y.x[c].alias(c) for c in ("start", "end", "kind", "token")]))

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), _let(F.array_sort(F.concat(F.transform(base, event(0)), F.transform(tokens, event(1)))), kept)).otherwise(tokens)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed and then by start."""
    value = F.regexp_extract
    return F.concat(
        _spans(text, "assign", _PATTERNS["assign"], _MAYBE["assign"], lambda p: F.length(value(p, _PATTERNS["assign"], 2)) >= 6),
        _spans(text, "access", _PATTERNS["access"], _MAYBE["access"], lambda p: F.lit(True)),
        _spans(text, "hex", _PATTERNS["hex"], _MAYBE["hex"], lambda p: F.lit(True)),
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation 26.2.17 of Abramowitz and Stegun, for either sign."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _parts(tokens: Column) -> Column:
    """Parts without separators of the tokens that have separators."""
    inside = F.filter(tokens, lambda t: t.token.rlike(_SEPARATOR))
    mixed = lambda p: p.rlike("[0-9]") & p.rlike("[A-Za-z]")
    return F.flatten(
        F.transform(inside, lambda t: F.transform(_spans(t.token, "random", _PART, _PART, mixed), lambda p: F.struct((p.start + t.start).alias("start"), (p.end + t.start).alias("end"), p.kind.alias("kind"), p.token.alias("token"))))
    )


def _letter_costs() -> list[float]:
    """-ln of the frequency of each letter where letters follow each other as in `_PAIRS`."""
    follow = [[math.exp(-(ord(_PAIRS[row * 26 + k]) - 48) / 8) for k in range(26)] for row in range(1, 27)]
    share = [1 / 26] * 26
    for _ in range(60):
        share = [sum(share[a] * follow[a][b] for a in range(26)) for b in range(26)]
        share = [x / sum(share) for x in share]
    return [-math.log(x) for x in share]


def _tests(c: Column, before: Column, size: Column) -> Column:
    """What a symbol after another adds to the log likelihood ratios of the three tests, ordinary text over uniform symbols; k is the class (letter, capital, digit, other), l the letter (0: none)."""
    row = F.when((before.k == c.k) | ((before.k == 1) & (c.k == 0)), before.l).otherwise(0)
    pair = (F.ascii(F.substring(F.lit(_PAIRS), row * 26 + c.l, F.lit(1))) - 48) / 8.0
    alone = F.element_at(F.array(*[F.lit(x) for x in _letter_costs()]), F.greatest(c.l, F.lit(1)))
    # of each class a third, letters or digits in it, against the alphabet; staying in a class or leaving it, against a third each
    symbol = math.log(3) + F.when(c.k == 2, math.log(10)).otherwise(alone) - F.log(size)
    change = F.when(before.k == 3, 0.0).when(before.k == c.k, -math.log(1 - ORDINARY_CHANGES) - math.log(3)).otherwise(-math.log(ORDINARY_CHANGES / 2) - math.log(3))
    none = F.lit(0.0)
    return F.struct(F.when(c.k == 3, none).otherwise(symbol).alias("uniformity"), F.when(c.k == 3, none).otherwise(change).alias("runs"), F.when(c.k >= 2, none).otherwise(pair - alone).alias("serial"))


def _stages(tokens: Column) -> Column:
    """Adds to each token of an array the three log likelihood ratios, p_uniform (classical tests against uniform symbols) and p (the battery's, against ordinary text)."""
    bare = lambda x: F.regexp_replace(x.token, _SEPARATOR, "")
    sized = F.transform(
        tokens,
        lambda x: F.struct(
            x.start.alias("start"),
            x.end.alias("end"),
            x.token.alias("raw"),
            F.when(bare(x).rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(bare(x).rlike("^([A-Z2-7]+|[a-z2-7]+)$"), 32).when(bare(x).rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).otherwise(64).cast("double").alias("size"),
        ),
    )
    sized = F.transform(
        sized,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("start", "end", "raw", "size")],
            F.when(x.size == 64, F.translate(x.raw, "-_", "+/")).when(x.size == 32, F.upper(F.regexp_replace(x.raw, _SEPARATOR, ""))).otherwise(F.lower(F.regexp_replace(x.raw, _SEPARATOR, ""))).alias("token"),
        ),
    )
    alphabet = lambda size: F.when(size == 16, F.lit("0123456789abcdef")).when(size == 32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).when(size == 36, F.lit("abcdefghijklmnopqrstuvwxyz0123456789")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    # values of the symbols, and of the token as it stands the class and letter of each
    valued = F.transform(
        sized,
        lambda x: F.struct(
            x.start.alias("start"),
            x.end.alias("end"),
            x.size.alias("size"),
            F.length(x.token).cast("double").alias("n"),
            F.transform(F.split(x.token, ""), lambda c: (F.call_function("instr", alphabet(x.size), c) - 1).cast("double")).alias("v"),
            F.transform(
                F.split(x.raw, ""), lambda c: F.struct(F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3).alias("k"), F.call_function("instr", F.lit("abcdefghijklmnopqrstuvwxyz"), F.lower(c)).alias("l"))
            ).alias("c"),
        ),
    )
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, y: s + y)
    neighbours = lambda x, f: F.zip_with(F.slice(x.v, 1, F.size(x.v) - 1), F.slice(x.v, 2, F.size(x.v) - 1), f)
    start = F.struct(F.lit(3).alias("k"), F.lit(0).alias("l"))
    parts = ("uniformity", "runs", "serial")
    counted = F.transform(
        valued,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("start", "end", "size", "n")],
            total(F.transform(F.array_distinct(x.v), lambda q: F.pow(F.size(F.filter(x.v, lambda y: y == q)).cast("double"), F.lit(2.0)))).alias("squares"),
            F.size(F.filter(x.v, lambda y: y * 2 >= x.size)).cast("double").alias("high"),
            (1 + F.size(F.filter(neighbours(x, lambda a, b: (a * 2 >= x.size) != (b * 2 >= x.size)), lambda d: d))).cast("double").alias("changes"),
            (total(x.v) / x.n).alias("mean"),
            x.v.alias("v"),
            F.aggregate(
                F.zip_with(x.c, F.concat(F.array(start), F.slice(x.c, 1, F.size(x.c) - 1)), lambda c, before: _tests(c, before, x.size)),
                F.struct(*[F.lit(0.0).alias(c) for c in parts]),
                lambda s, y: F.struct(*[(s[c] + y[c]).alias(c) for c in parts]),
            ).alias("ratios"),
        ),
    )
    expected = lambda x: 2 * x.high * (x.n - x.high) / x.n
    tested = F.transform(
        counted,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("start", "end", "n", "ratios")],
            # Wilson and Hilferty's normal form of chi-squared over all symbols of the alphabet
            ((F.pow(F.greatest(x.squares * x.size / x.n - x.n, F.lit(0.0)) / (x.size - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (x.size - 1)))) / F.sqrt(2 / (9 * (x.size - 1)))).alias("z_chi"),
            F.when((x.high == 0) | (x.high == x.n), F.lit(37.0)).otherwise((x.changes - 1 - expected(x)) / F.sqrt(F.greatest(F.lit(1e-9), expected(x) * (expected(x) - 1) / (x.n - 1)))).alias("z_runs"),
            (F.coalesce(F.try_divide(total(neighbours(x, lambda a, b: (a - x.mean) * (b - x.mean))), total(F.transform(x.v, lambda y: (y - x.mean) * (y - x.mean)))), F.lit(1.0)) * F.sqrt(x.n) + 1 / F.sqrt(x.n)).alias("z_serial"),
        ),
    )
    judged = F.transform(
        tested,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("start", "end", "n")],
            *[x.ratios[c].alias(c) for c in parts],
            F.least(F.lit(1.0), 3 * F.least(normal_tail(x.z_chi), 2 * normal_tail(F.abs(x.z_runs)), 2 * normal_tail(F.abs(x.z_serial)))).alias("p_uniform"),
        ),
    )
    against = lambda x: F.least(F.lit(1.0), F.greatest(ENCODINGS * F.exp(-F.least(x.uniformity + x.runs + x.serial, F.lit(250.0))), F.lit(1e-99)))
    return F.transform(judged, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "n", *parts, "p_uniform")], F.when(x.p_uniform < COMPATIBLE, F.lit(1.0)).otherwise(against(x)).alias("p")))


def _tested(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """The columns `keep`, base spans of each text, and the tested tokens and parts of tokens."""
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = _spans(whole, "random", _TOKEN, _TOKEN_MAYBE, lambda p: p.rlike("[0-9]") & p.rlike("[A-Za-z]"))
    found = docs.select(*keep, base_spans(whole).alias("_secret_base"), tokens.alias("_secret_tokens"))
    found = found.withColumn("_secret_tokens", _untouched(F.col("_secret_tokens"), F.col("_secret_base")))
    found = found.withColumn("_secret_tokens", F.concat("_secret_tokens", _parts(F.col("_secret_tokens"))))
    return found.select(*keep, _narrow(F.col("_secret_base")).alias("_secret_base"), _stages(F.col("_secret_tokens")).alias("_secret_tested"))


def _weighted(p: Column, n: Column, mean: float) -> Column:
    return F.least(F.lit(1.0), p * mean / n)


def cut_of(tested: DataFrame) -> tuple[float, float]:
    """The mean length, and the greatest weighted p-value to be reported, of a table of (p, n): the procedure on a histogram whose bins are a twentieth of a decade wide, each counted at its upper edge."""
    mean = tested.agg(F.avg("n")).first()[0]
    if mean is None:
        return 1.0, -1.0
    bins = tested.groupBy(F.least(F.floor(-20 * F.log10(_weighted(F.col("p"), F.col("n"), mean))), F.lit(BINS)).alias("bin")).count().orderBy(F.desc("bin")).collect()
    m, so_far, cut = sum(r["count"] for r in bins), 0, -1.0
    for r in bins:  # at most BINS + 1 of them
        so_far += r["count"]
        edge = 10 ** (-r["bin"] / 20)
        if edge <= FDR * so_far / m:
            cut = edge
    return mean, cut


def _chosen(tested: Column, mean: float, cut: float) -> Column:
    """Spans of the tokens below the cut, without parts of reported tokens: of spans by start, the longer first, those that end after all before."""
    hits = F.filter(tested, lambda t: _weighted(t.p, t.n, mean) <= cut)
    sorted_ = F.array_sort(F.transform(hits, lambda t: F.struct(t.start.alias("start"), (-t.end).alias("back"))))

    def whole(all_: Column) -> Column:
        ended = _before(_running(F.transform(all_, lambda t: -t.back), F.greatest, F.lit(-1)), F.lit(-1))
        new = F.zip_with(all_, ended, lambda t, e: F.struct(t.start.alias("start"), (-t.back).alias("end"), (e < -t.back).alias("new")))
        return F.transform(F.filter(new, lambda t: t.new), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), F.lit("random").alias("kind")))

    return F.when(F.size(hits) > 0, _let(sorted_, whole)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def _in_order(base: Column, chosen: Column) -> Column:
    ranked = F.transform(F.concat(base, chosen), lambda s: F.struct(s.start.alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "random")]), s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def _narrow(base: Column) -> Column:
    return F.transform(base, lambda b: F.struct(b.start.alias("start"), b.end.alias("end"), b.kind.alias("kind")))


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` and `spans`: array of (start, end, kind) ordered by start, then kind as listed, `random` last.

    One pass over the texts finds base spans and candidates with their p-values
    and goes to a shared table; the cut is set from a histogram of that table.
    """
    found = materialize(_tested(docs, keep, text), "secrets")
    mean, cut = cut_of(found.select(F.explode("_secret_tested").alias("t")).select("t.p", "t.n"))
    return found.select(*keep, _in_order(F.col("_secret_base"), _chosen(F.col("_secret_tested"), mean, cut)).alias("spans"))


def _is(kind: str):
    return lambda s: s.kind == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return detect(docs).select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s.kind != "random")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with every found span replaced by its kind in brackets; of overlapping spans the earliest names the gap, which covers them all.

    Texts without a span, null ones among them, stay as they are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # the texts go along, as the cut is known only after all of them
    tested = materialize(_tested(docs, tuple(docs.columns), text), "secrets")
    mean, cut = cut_of(tested.select(F.explode("_secret_tested").alias("t")).select("t.p", "t.n"))

    def gaps(spans: Column) -> Column:
        """Spans that begin after all before have ended, each with the end of the last one that touches it."""
        ends = _running(F.transform(spans, lambda s: s.end), F.greatest, F.lit(0))
        return _let(
            F.zip_with(spans, _before(ends, F.lit(-1)), lambda s, e: F.struct(s.start.alias("start"), e.alias("after"), s.kind.alias("kind"), (s.start >= e).alias("new"))),
            lambda marked: _let(F.filter(marked, lambda s: s.new), lambda new: F.zip_with(new, F.concat(F.transform(F.slice(new, 2, F.greatest(F.size(new) - 1, F.lit(0))), lambda s: s.after), F.array(F.element_at(ends, -1))), lambda s, end: F.struct(s.start.alias("start"), end.alias("end"), s.kind.alias("kind")))),
        )

    def written(gap: Column) -> Column:
        """The text with the gaps named: cut into stretches of as many gaps as there are stretches, so that no gap is sought from the text's begin."""
        width = F.greatest(F.ceil(F.sqrt(F.size(gap))), F.lit(1)).cast("int")
        at = lambda k: F.when(k == 0, 0).otherwise(F.element_at(gap, F.greatest(k, F.lit(1))).end)
        stretches = F.transform(F.sequence(F.lit(0), (F.ceil(F.size(gap) / width) - 1).cast("int")), lambda b: F.struct(at(b * width).alias("from"), F.slice(gap, b * width + 1, width).alias("gaps")))
        stretch = lambda x: F.struct(x["from"].alias("from"), x.gaps.alias("gaps"), F.substring(whole, x["from"] + 1, F.element_at(x.gaps, -1).end - x["from"]).alias("piece"))
        before = lambda x: F.concat(F.array(x["from"]), F.transform(x.gaps, lambda g: g.end))
        named = lambda x: F.array_join(F.zip_with(x.gaps, F.slice(before(x), 1, F.size(x.gaps)), lambda g, e: F.concat(F.substring(x.piece, e - x["from"] + 1, g.start - e), F.lit("["), g.kind, F.lit("]"))), "")
        return F.concat(F.array_join(F.transform(F.transform(stretches, stretch), named), ""), F.substring(whole, F.element_at(gap, -1).end + 1, F.length(whole)))

    # one column after the other: the analyzer resolves nested functions a level a round
    found = tested.withColumn("_secret_chosen", _chosen(F.col("_secret_tested"), mean, cut)).withColumn("_secret_spans", _in_order(F.col("_secret_base"), F.col("_secret_chosen")))
    found = found.withColumn("_secret_gaps", F.when(F.size("_secret_spans") > 0, gaps(F.col("_secret_spans"))))
    new = F.when(F.size("_secret_spans") > 0, written(F.col("_secret_gaps"))).otherwise(F.col(text))
    return found.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
