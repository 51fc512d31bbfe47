"""Secrets in text: three fixed patterns, and a randomness test battery for what they miss; DataFrame functions only.

Positions are code points.  ``split`` and ``regexp_extract_all`` walk the same leftmost matches, so the
running sum of the lengths of gaps and matches gives every start and end without leaving the row.

Added spans come from runs of 20 or more letters, digits and ``+/_-``:

* the alphabet of the run (hex, base32, base36, base62, base64) is inferred from its characters;
* chi-squared uniformity over that alphabet, a runs test about its middle and the lag-one serial
  correlation each give a p-value for "drawn uniformly"; a run whose smallest p-value times three is
  below ``RANDOM_P`` is not random and leaves;
* against "ordinary text" the run's likelihood under the inferred alphabet is compared with its largest
  one as text: letters as frequent as in prose, digits and signs even, and changes between digits, lower
  case, upper case and signs with a chance of at most ``CHANGE_P``.  A ratio of likelihoods is above 1/p
  with a chance of at most p, so its inverse, times the number of alphabets, is a valid p-value; runs of
  one case count by their letters alone;
* Benjamini-Hochberg over all runs of the corpus, weighted by length (mean weight 1), holds the share
  of false discoveries at ``FDR``.  It needs one histogram of the weighted p-values, of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import unused
from tidewatch.llm.rules import bind
from tidewatch.session import stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is taken whole or not at all, so asking for the length in the pattern finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: fixed values: encodings and their alphabets, first match wins
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)

#: fixed values: letters of prose, A to Z in thousandths, roughly the mean of four languages
LETTERS = (80, 15, 31, 43, 140, 14, 17, 37, 73, 4, 10, 46, 27, 77, 58, 23, 6, 67, 70, 75, 41, 12, 14, 4, 11, 5)
SIGNS = "+/_-"

CHANGE_P = 0.12
RANDOM_P = 0.001
FDR = 0.01
#: Bins of the p-value histogram: eighths of a decade.
PER_DECADE, BINS = 8, 1024
#: No weight can lift a p-value above this past the largest BH threshold, so the battery is not run there.
HOPELESS = 1.4
GROUP = 256


def running(values: Column, step, start: Column) -> Column:
    """Inclusive running ``step`` over an array, in groups of 256, so appending stays cheap for long arrays."""
    def within(a: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(a, empty, lambda acc, v: F.array_append(acc, step(F.coalesce(F.get(acc, F.size(acc) - 1), start), v)))

    def whole(a: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / GROUP).cast("int")), lambda k: within(F.slice(a, k * GROUP + 1, GROUP)))
        return bind(groups, lambda g: bind(
            F.concat(F.array(start), within(F.transform(g, lambda x: F.element_at(x, -1)))),
            lambda base: F.flatten(F.zip_with(g, F.slice(base, 1, F.size(g)), lambda x, b: F.transform(x, lambda v: step(v, b)))),
        ))

    return bind(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(whole(a)))


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches in order: struct(start, end, found), and part for a group.  Texts without a match cost one search."""
    names = ["start", "end", "found"] + (["part"] if group is not None else [])
    kinds = "array<struct<start:int,end:int,found:string" + (",part:string>>" if group is not None else ">>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))

    def spans(f: Column) -> Column:
        sizes = F.flatten(F.zip_with(F.split(text, pattern, -1), f, lambda gap, m: F.array(F.length(gap), F.coalesce(F.length(m), F.lit(0)))))
        made = lambda at, p: F.transform(f, lambda m, i: F.struct(
            F.get(at, 2 * i).alias(names[0]), F.get(at, 2 * i + 1).alias(names[1]), m.alias("found"),
            *([F.get(p, i).alias("part")] if group is not None else []),
        ))
        return bind(running(sizes, lambda a, b: a + b, F.lit(0)), lambda at: bind(parts, lambda p: made(at, p)))

    return F.when(text.rlike(pattern), bind(found, spans)).otherwise(F.array().cast(kinds))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, absolute error below 1e-7."""
    #: fixed values: the rational approximation's coefficients
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def battery(run: Column, alphabet: Column) -> Column:
    """Smallest of three p-values times three for "drawn uniformly from the alphabet"."""
    k = F.length(alphabet)
    codes = F.transform(F.split(F.rtrim(run, F.lit("=")), ""), lambda c: F.position(c, alphabet) - 1)

    def tests(x: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(
            F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.size(F.filter(x, lambda v: v == s)).cast("double")),
            F.lit(0.0), lambda a, c: a + c * c,
        )
        df = (k - 1).cast("double")
        spread = 2.0 / (9.0 * df)
        z_uniform = (F.pow((k * squares / n - n) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        p_uniform = F.when(z_uniform < 0, 1 - normal_tail(-z_uniform)).otherwise(normal_tail(z_uniform))

        high = F.size(F.filter(x, lambda v: 2 * v >= k)).cast("double")
        changes = F.size(F.filter(x, lambda v, i: (i > 0) & ((2 * v >= k) != (2 * F.get(x, F.greatest(i - 1, F.lit(0))) >= k)))).cast("double")
        expected = 2 * high * (n - high) / n
        variance = expected * (expected - 1) / (n - 1)
        p_runs = F.when(variance <= 0, F.pow(F.lit(2.0), 1 - n)).otherwise(2 * normal_tail(F.abs(changes - expected) / F.sqrt(variance)))

        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        around = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) - n * mean * mean
        pairs = F.aggregate(F.transform(x, lambda v, i: (v - mean) * (F.coalesce(F.get(x, i + 1).cast("double"), mean) - mean)), F.lit(0.0), lambda a, v: a + v)
        p_serial = F.when(around <= 0, F.pow(F.lit(2.0), 1 - n)).otherwise(2 * normal_tail(F.abs(pairs / around + 1 / n) * F.sqrt(n)))
        return 3 * F.least(p_uniform, p_runs, p_serial)

    return bind(codes, tests)


def text_decades(run: Column, k: Column) -> Column:
    """Decades of the p-value for "ordinary text" of a run that may be drawn from ``k`` characters; 0 if text is likelier."""
    body = F.rtrim(run, F.lit("="))
    n = F.length(body).cast("double")
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[+/_-]+", "-")
    changes = (F.length(squeezed) - 1).cast("double")
    x = F.least(changes / (n - 1), F.lit(CHANGE_P))
    log = lambda v: F.ln(F.greatest(v, F.lit(1e-12)))
    costs = F.array(*[F.lit(-math.log(v / 1000)) for v in LETTERS], *[F.lit(math.log(10))] * 10, *[F.lit(math.log(len(SIGNS)))] * len(SIGNS))
    place = F.lit("abcdefghijklmnopqrstuvwxyz0123456789" + SIGNS)
    letters = bind(costs, lambda cost: F.aggregate(F.split(F.lower(body), ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(cost, F.position(c, place) - 1), F.lit(0.0))))
    nats = letters - changes * log(x) - (n - 1 - changes) * log(1 - x) - n * F.ln(k.cast("double")) - math.log(len(ALPHABETS))
    return F.greatest(F.lit(0.0), nats / math.log(10))


def _candidate(c: Column) -> Column:
    run, n = c["found"], F.length(c["found"]).cast("double")
    alphabet = F.lit(ALPHABETS[-1][2])
    for _, pattern, letters in reversed(ALPHABETS[:-1]):
        alphabet = F.when(run.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    weight = F.least(n, F.lit(64.0)) / 32.0

    def made(letters: Column) -> Column:
        return bind(text_decades(run, F.length(letters)), lambda decades: F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.when(F.when(decades < HOPELESS, F.lit(False)).otherwise(battery(run, letters) >= RANDOM_P), decades).otherwise(0.0).alias("decades"),
            weight.alias("weight"),
        ))

    return bind(alphabet, made)


def bh_bin(counts: dict[int, int], total: int, fdr: float = FDR) -> int:
    """The lowest bin b with total * 10 ** (-b / PER_DECADE) <= fdr * (runs in bins b and above); BINS if there is none."""
    above, best = 0, BINS
    for b in range(BINS - 1, -1, -1):
        above += counts.get(b, 0)
        if above and total * 10.0 ** (-b / PER_DECADE) <= fdr * above:
            best = b
    return best


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",), into: str = "spans") -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``into``: all secrets of the text, in order of start, then of kind.

    A span is struct(start, kind_no, end); kind_no counts KINDS.  Added spans never overlap base ones.
    Null and empty texts have no spans; every row is scanned on its own, only the threshold of the
    added spans depends on the whole table (equal for equal tables).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = lambda no, keep=None: lambda s: F.transform(
        s if keep is None else F.filter(s, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"))
    )
    base = F.concat(
        kind(0, lambda x: F.length(x["part"]) >= 6)(located(text, ASSIGN, 2)), kind(1)(located(text, ACCESS)), kind(2)(located(text, HEX))
    )
    free = lambda runs, spans: F.filter(runs, lambda r: ~F.exists(spans, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in carry], F.array_sort(base).alias("base"), located(text, RUN).alias("runs"))
    rows = rows.select(*[f"_{c}" for c in carry], "base", F.transform(free(F.col("runs"), F.col("base")), _candidate).alias("runs"))
    rows = stage(rows, "secret_rows")
    runs = rows.select(F.explode("runs").alias("r")).select("r.*")
    mean = runs.agg(F.avg("weight")).first()[0] or 1.0
    bin_ = lambda r: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((r["decades"] + F.log10(r["weight"] / mean)) * PER_DECADE))).cast("int")
    counts = {r[0]: r[1] for r in runs.withColumn("r", F.struct("decades", "weight")).groupBy(bin_(F.col("r"))).count().collect()}
    least = bh_bin(counts, sum(counts.values()))
    added = kind(3)(F.filter("runs", lambda r: (r["decades"] > 0) & (bin_(r) >= least)))
    return rows.select(*[F.col(f"_{c}").alias(c) for c in carry], F.array_sort(F.concat("base", added)).alias(into))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as text."""
    of = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``marker`` (overlapping spans by one); n_chars, if there, follows."""
    spans, clean = unused(docs.columns, "_spans"), unused(docs.columns, "_clean")
    found = scan(docs, docs.columns, spans)
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))

    def cut(at: Column) -> Column:
        before = lambda i: F.coalesce(F.get(at, i - 1), F.lit(0))
        return F.concat(
            F.array_join(F.transform(spans, lambda s, i: F.when(
                (i > 0) & (s["start"] < before(i)), F.lit("")
            ).otherwise(F.concat(F.substring("text", before(i) + 1, s["start"] - before(i)), F.lit(marker)))), ""),
            F.substring("text", F.element_at(at, -1) + 1, F.length("text")),
        )

    out = found.withColumn(clean, F.when(F.size(spans) > 0, bind(ends, cut)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length(clean).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(clean)).select(*docs.columns)
