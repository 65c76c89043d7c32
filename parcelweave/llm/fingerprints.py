"""Document fingerprints by consistent weighted sampling.

A document is a bag of words, each weighted by its count.  For each of ``SAMPLES`` draws every word w of
weight x has, by hash, r and c from Gamma(2, 1) and b from Uniform(0, 1); with t = floor(ln x / r + b) the
draw is the word with the least ln c - r (t + 1 - b).  Two documents draw the same (word, t) with
probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima.

The work is one shuffle of the texts.  Ids are cut at quantiles into ranges of about ``RANGE_ROWS`` rows;
within a range a window finds each document's successor, and the words, draws and minima follow in the
same stage.  The first document of each range also goes to the range before, as successor of its last.
Minima are kept as doubles in a hash aggregate, ``GROUP`` draws to a row, so generated code stays small
enough to be compiled.

Defined results: a null text is an empty one; texts without words have a fingerprint of zeros, like one
another and unlike all others; the order is by id, then text digest; equal rows follow one another; a
table of one row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, text_or_empty

#: draws, and how many of them one aggregate row holds
SAMPLES, GROUP = 32, 8
#: rows of a range, and the most ranges
RANGE_ROWS, MOST_RANGES = 250, 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def _word_weights(text: Column) -> tuple[Column, ...]:
    """The steps from a text to its array of (word hash, count); each needs the one before as a column."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    s = F.col("__s")
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    at = F.col("__at")
    ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s)))
    return hashes, F.when(F.size(s) > 0, starts).otherwise(F.array().cast("array<int>")), F.zip_with(at, ends, lambda a, b: F.struct(F.get(s, a).alias("h"), (b - a).alias("x")))


def _draw(k: Column) -> Column:
    """The value whose minimum over the words of a document is its draw k."""
    unit = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1) + F.lit(0.5)) / F.lit(float(1 << bits))
    h1 = F.xxhash64("h", k)
    h2 = F.xxhash64("h", k, F.lit(1))
    r, b = -F.ln(unit(h1, 43, 21) * unit(h1, 22, 21)), unit(h1, 0, 22)
    c = -F.ln(unit(h2, 32, 32) * unit(h2, 0, 32))
    return F.ln(c) - r * (F.floor(F.col("lnx") / r + b) + 1 - b)


def _minima(rows: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """``key`` and, for each named text, its array of draws (null without words)."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(t).alias("text")) for n, t in enumerate(texts)]))
    r = rows.select(*key, sides.alias("one")).select(*key, "one.side", "one.text")
    hashes, at, terms = _word_weights(F.col("text"))
    r = r.select(*key, "side", hashes.alias("__s")).select(*key, "side", "__s", at.alias("__at")).select(*key, "side", terms.alias("__t"))
    r = r.select(*key, "side", F.inline_outer("__t")).select(*key, "side", "h", F.ln(F.col("x")).alias("lnx"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))).alias("g"))
    r = r.groupBy(*key, "side", "g").agg(*[F.min(_draw(F.col("g") * GROUP + j)).alias(f"m{j}") for j in range(GROUP)])
    parts = F.collect_list(F.struct("side", "g", F.array(*[f"m{j}" for j in range(GROUP)]).alias("m")))
    r = r.groupBy(*key).agg(F.sort_array(parts).alias("__p"))
    pick = lambda n: F.flatten(F.transform(F.filter("__p", lambda p: p["side"] == n), lambda p: p["m"]))
    return r.select(*key, *[pick(n).alias(t) for n, t in enumerate(texts)])


def _signature(draws: Column) -> Column:
    """One word of eight hexadecimal digits for each draw; zeros without words."""
    return F.transform(draws, lambda x: F.when(x.isNull(), "0" * 8).otherwise(F.lower(F.right(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lit(8)))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal draws of two signatures."""
    return F.reduce(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SAMPLES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = identified(docs, "doc_id", text_or_empty().alias("text"))
    n = docs.where(F.col("doc_id").isNotNull()).count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = [k / ranges for k in range(ranges)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * ranges)).alias("b"), F.min("doc_id").alias("low")).first() if n else (None, None)
    bounds = sorted({bounds[1], *bounds[0]}) if n else [0]
    # a bound is an id, and the first of its range; two levels keep the search short
    wide = int(len(bounds) ** 0.5) + 1
    tables = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, t)) for t in tables)), ";"), lambda t: F.split(t, ",").cast("array<bigint>"))
    rows = rows.withColumn("__top", F.size(F.filter(array([t[0] for t in tables]), lambda x: x <= F.col("doc_id"))) - 1)
    rows = rows.withColumn("__own", F.get(nested, F.col("__top"))).withColumn("__low", F.size(F.filter("__own", lambda x: x <= F.col("doc_id"))) - 1)
    rows = rows.withColumn("__b", (F.col("__top") * wide + F.col("__low")).cast("long")).withColumn("__first", F.get("__own", F.col("__low")) == F.col("doc_id"))
    before = F.when(F.col("__b") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("__b") - 1).cast("long")
    places = F.concat(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("ghost"))), F.when(F.col("__first"), F.array(F.struct(before.alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array().cast("array<struct<b:bigint,ghost:int>>")))
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.b", "p.ghost", "doc_id", "text")
    order = Window.partitionBy("b").orderBy("ghost", "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.when(F.col("ghost") == 0, F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next", F.lit("")), half))).otherwise("")
    rows = rows.select("b", "i", "ghost", "doc_id", "n_chars", "text", edited.alias("edited")).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    found = _minima(rows, ["b", "i", "ghost", "doc_id", "n_chars", "sha"], ["text", "edited"])
    found = found.select("b", "i", "ghost", "doc_id", "n_chars", "sha", _signature(F.col("text")).alias("own"), _signature(F.col("edited")).alias("edited"))
    found = found.withColumn("next", F.lead("own").over(Window.partitionBy("b").orderBy("i"))).where("ghost = 0")
    return found.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.array_join("own", "").alias("fingerprint"), F.array_join("edited", "").alias("edited_fingerprint"),
                        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
