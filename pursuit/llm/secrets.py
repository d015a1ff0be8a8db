"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

DataFrame functions only. Besides the patterns' matches, strings that look like keys are tested
against the alphabet of their inferred encoding: chi-squared uniformity, runs about the middle of
the alphabet, and serial correlation. The null hypothesis of each test is "drawn uniformly"; in
each stratum of encoding and length the Benjamini-Hochberg rule rejects strings that aren't random
(ordinary identifiers, paths, repeated filler), and what it can't reject is reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Fixed patterns, by kind in the order of the listing: (kind, pattern, group to measure, least length).
KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A test of whether a text can have a match that passes, run before the matches are listed.
HINTS = {"assign": KINDS[0][1][:-2] + r"{8})", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Strings that the battery tests: runs of key characters with letters and digits both; one may begin right after "=".
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}"
CANDIDATE_HINT = r"[A-Za-z0-9+/_-]{24}"
#: Alphabets by encoding: (name, pattern of the whole string, size).
ENCODINGS = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16), ("base32", r"^[A-Z2-7]+=*$", 32), ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36), ("base64", r"^[A-Za-z0-9+/_-]+=*$", 64))
RATE = 0.05
#: p-values are kept in steps of a tenth of a power of ten, down to this power.
STEPS, DEEPEST = 10, 30
#: The shortest string of each stratum can be told from words only if its own characters number so many.
LEAST = {"hex": 32, "base32": 32, "base36": 28, "base64": 24}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans (start, kind, end; in code points, end exclusive) of the leftmost matches that pass.

    What lies between matches is what split() returns, so running lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.zip_with(whole, measured, lambda w, m: F.struct(F.length(w).alias("w"), F.length(m).alias("m"))), F.slice(gaps, 1, F.size(whole)), lambda x, g: F.struct(x["w"].alias("w"), x["m"].alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["g"] + x["w"]
        span = F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(x["m"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    found = []
    for kind, (name, pattern, group, least) in enumerate(KINDS):
        exact = pattern if name == "assign" else re.sub(r"\+$", "{%d,}" % (least - 4 if name == "access" else least), pattern)  # runs are maximal, so these are the matches that pass
        found.append(F.when(text.rlike(HINTS[name]), matches(text, exact, kind, group, least)).otherwise(none))
    return F.array_sort(F.concat(*found))


def listing(spans: Column, names: tuple[str, ...] = ("assign", "access", "hex", "random")) -> Column:
    """kind:start:end, comma-joined."""
    named = F.array(*[F.lit(n) for n in names])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


# ---------------------------------------------------------------- the battery


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) for a standard normal Z (Zelen and Severo's approximation, absolute error under 1e-7; the leading term beyond 6)."""

    def tail(t: Column, a: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * F.when(a > 6, 1 / a).otherwise(poly)

    def of(z: Column) -> Column:
        return let(F.abs(z), lambda a: let(let(1 / (1 + 0.2316419 * a), lambda t: tail(t, a)), lambda p: F.when(z >= 0, p).otherwise(1 - p)))

    return let(z, of)


def encoding_of(s: Column) -> Column:
    """Index into ENCODINGS of the smallest alphabet that has the string."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(s.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(out)
    return out


ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def symbols(s: Column, enc: Column) -> Column:
    """The places (from 1) of the string's characters in its alphabet, without padding."""
    own = F.rtrim(s, F.lit("="))
    folded = F.when((enc == 0) | (enc == 2), F.lower(own)).otherwise(F.translate(own, "-_", "+/"))
    alphabet = F.element_at(F.array(*[F.lit(a) for a in ALPHABETS]), enc + 1)
    return F.transform(F.split(folded, ""), lambda c: F.call_function("locate", c, alphabet).cast("double"))


def tests(a: Column) -> Column:
    """p of the three tests on a struct (x: places, n, size), Bonferroni-combined."""
    x, n, size = a["x"], a["n"], a["size"]
    counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda u: u == v)).cast("double"))
    chi = let(total(F.transform(counts, lambda c: c * c)) * size / n - n, lambda c: (c - size + 1) / F.sqrt(2 * (size - 1) * (1 - 1 / n)))
    pairs = lambda y, f: F.zip_with(F.slice(y, 1, F.size(y) - 1), F.slice(y, 2, F.size(y) - 1), f)

    def runs(high: Column) -> Column:
        seen = 1 + total(pairs(high, lambda u, v: F.abs(u - v)))
        mean = let(total(high), lambda n1: 2 * n1 * (n - n1) / n + 1)
        z = lambda m: let((m - 1) * (m - 2) / (n - 1), lambda var: F.when(var > 0, F.abs(seen - m) / F.sqrt(var)).otherwise(F.sqrt(n)))
        return let(mean, z)

    def serial(y: Column) -> Column:
        z = lambda square: F.when(square > 0, F.abs(total(pairs(y, lambda u, v: u * v)) / square + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return let(total(F.transform(y, lambda v: v * v)), z)

    z_runs = let(F.transform(x, lambda v: (v > size / 2).cast("double")), runs)
    z_serial = let(let(total(x) / n, lambda mean: F.transform(x, lambda v: v - mean)), serial)
    return F.least(F.lit(1.0), 3 * F.least(upper_tail(chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial)))


def battery(s: Column) -> Column:
    """(encoding, n, p) of a string."""
    sizes = F.array(*[F.lit(float(e[2])) for e in ENCODINGS])

    def of(enc: Column) -> Column:
        facts = let(symbols(s, enc), lambda x: F.struct(x.alias("x"), F.size(x).cast("double").alias("n"), F.element_at(sizes, enc + 1).alias("size")))
        return let(facts, lambda a: F.struct(enc.alias("encoding"), a["n"].cast("int").alias("n"), tests(a).alias("p")))

    return let(encoding_of(s), of)


def candidates(text: Column) -> Column:
    """Spans with what the battery says of each; kind 3."""
    none = F.array().cast("array<struct<start:int,end:int,encoding:int,n:int,p:double>>")
    whole = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    spans = matches(text, CANDIDATE, 3, 0, 1)

    def tested(span: Column, s: Column) -> Column:
        return let(battery(s), lambda x: F.struct(span["start"].alias("start"), span["end"].alias("end"), x["encoding"].alias("encoding"), x["n"].alias("n"), x["p"].alias("p")))

    found = F.zip_with(spans, whole, tested)
    least = F.array(*[F.lit(LEAST[e[0]]) for e in ENCODINGS])
    long = F.filter(found, lambda x: x["n"] >= F.element_at(least, x["encoding"] + 1))
    return F.when(text.rlike(CANDIDATE_HINT), long).otherwise(none)


def stratum(x: Column) -> Column:
    """Encoding and length: lengths within a factor of two stand together."""
    return x["encoding"] * 100 + F.floor(F.log2(x["n"])).cast("int")


def step_of(p: Column) -> Column:
    """Steps of a tenth of a power of ten below 1."""
    return F.least(F.lit(STEPS * DEEPEST), F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DEEPEST))) * STEPS)).cast("int")


def rejections(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each stratum of ``found`` (candidates arrays in column "found") the first step that is rejected.

    Benjamini-Hochberg over all candidates of the corpus: the strata's counts by p-value step are
    aggregated, and at most 4 x 31 thresholds are collected.
    """
    x = found.select(F.explode("found").alias("x")).select(stratum(F.col("x")).alias("stratum"), step_of(F.col("x")["p"]).alias("step"))
    counts = x.groupBy("stratum", "step").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("stratum").orderBy(F.col("step").desc()))
    all_ = F.sum("k").over(Window.partitionBy("stratum"))
    hit = counts.withColumn("upto", upto).withColumn("all", all_).where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("upto") / F.col("all"))
    return {s: k for s, k in hit.groupBy("stratum").agg(F.min("step")).collect()}


def random_spans(found: Column, base: Column, rejected: dict[int, int]) -> Column:
    """Candidates that aren't rejected and don't touch a base span."""
    never = F.lit(STEPS * DEEPEST + 1)
    table = F.create_map(*[F.lit(v) for pair in sorted(rejected.items()) for v in pair]) if rejected else None

    def stays(x: Column) -> Column:
        limit = never if table is None else F.coalesce(F.element_at(table, stratum(x)), never)
        return (step_of(x["p"]) < limit) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    return F.transform(F.filter(found, stays), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))).cast(SPAN)


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with columns base_spans and secret_spans (arrays of start, kind, end; kind 3 is the battery's).

    Null texts count as empty. Two passes over the texts: one gathers the strata of all candidates,
    one decides, so no row needs a key and nothing but the strata's thresholds leaves the rows. Whole
    texts are read. Other columns stay; columns that have the added names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rejected = rejections(docs.select(candidates(text).alias("found")), rate)
    out = docs.withColumn("base_spans", base_spans(text))
    return out.withColumn("secret_spans", F.array_sort(F.concat("base_spans", random_spans(candidates(text), F.col("base_spans"), rejected))))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
