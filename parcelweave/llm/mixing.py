"""Mixing sources to target weights.

Every document gets a key that is random by hash; within its source the documents stand in key order,
and the source's exact budget is cut from the distributed prefix sums of their sizes.  A budget above
the source's size repeats the whole source (an epoch) and cuts the rest.

Prefix sums without a large window: keys are uniform, so a source of n rows is dealt into key ranges
("blocks") of about sqrt(N) rows, N being all rows; one window adds up within a block, a second one over
the block totals of a source.  Both hold about sqrt(N) rows at most, whatever a source's share.

Defined results: size is the number of words, 0 for a null or empty text; a null source is a source of
its own, the last one; equal ids are told apart by size; rows equal in id and size are interchangeable;
an empty table gives an empty result; a source without words gets target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified, text_or_empty, word_count

#: weights of the sources in code point order, repeating
WEIGHTS = (5.0, 2.0, 1.0)
#: a source is repeated so many times at most
MOST_EPOCHS = 3
KEY_BITS = 60


def hash_key(doc_id: Column) -> Column:
    """60 random bits, the same at every run."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares of all sizes by weight, capped, the excess shared again.

    Each round is one aggregate over the sources; sources that reach their cap leave, and the round
    after the last such one has the final share of a unit of weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source: a table of names, not of documents
    cap = F.col("source_size").cast("double") * most_epochs
    ranked = stage(sources.select("source", "source_size", "n_rows", (F.row_number().over(order) - 1).alias("rank"))
                   .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        full = F.col("weight") * share >= cap
        row = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if row[2] == capped or not row[1]:
            break
        share, capped = (total - row[0]) / row[1], row[2]
    return ranked.select("source", "source_size", "n_rows", F.least(F.col("weight") * share, cap).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every document."""
    sized = stage(identified(docs, "doc_id", "source", word_count(text_or_empty()).alias("size")).withColumn("key", hash_key(F.col("doc_id"))), "mix-sizes")
    targets = stage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, most_epochs), "mix-targets")
    n = sized.count()
    per_block = max(128, int(n ** 0.5))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rows = sized.join(targets, same(sized, targets)).select(sized["*"], "source_size", "target", "n_rows")
    blocks = F.ceil(F.col("n_rows") / per_block)
    rows = rows.withColumn("block", F.least(F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * blocks), blocks - 1).cast("long"))
    before = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (sized.join(targets, same(sized, targets)).select(sized["source"], "size", "key", "n_rows")
              .withColumn("block", F.least(F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * blocks), blocks - 1).cast("long"))
              .groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))))
    totals = totals.select(F.col("source").alias("s"), F.col("block").alias("b"), "offset")
    rows = rows.join(totals, rows["source"].eqNullSafe(totals["s"]) & (rows["block"] == totals["b"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("within")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: one row for each whole repeat, and one cut after its last taken word.

    All columns stay; ``n_chars``, where present, follows a cut text.  A document without words is not taken.
    """
    number = F.xxhash64("doc_id", "source", "size")
    wanted = mix(docs).where("taken > 0").groupBy(number.alias("__key")).agg(F.sort_array(F.collect_list("taken")).alias("__takes"))
    own = docs.where(F.col("doc_id").isNotNull()).withColumn("__size", word_count(text_or_empty()))
    own = own.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), "source", "__size"))
    own = own.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text"))))
    both = own.join(wanted, "__key").withColumn("__take", F.get("__takes", F.col("__nth") - 1)).where(F.col("__take").isNotNull())
    whole, rest = (F.col("__take") / F.col("__size")).cast("int"), F.col("__take") % F.col("__size")
    both = both.withColumn("__words", F.explode(F.concat(F.array_repeat(F.col("__size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    spaces = "[\\x20\\x09-\\x0D]"
    lead = F.col("text").rlike("^" + spaces).cast("int")
    behind = F.element_at(F.split("text", spaces + "+", (F.col("__words") + 1 + lead).cast("int")), -1)
    text = F.regexp_replace(F.left("text", F.length("text") - F.length(behind)), spaces + "+$", "")
    both = both.withColumn("text", F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("__words") == F.col("__size"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)
