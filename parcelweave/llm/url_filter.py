"""URL filters by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys, level 1 one of the keys of the corpus that level 0 takes
wrongly, level 2 one of the listed keys that level 1 takes, and so on until a level takes nothing
wrongly.  A key of the corpus is listed exactly when the first level that refuses it is an odd one, so
membership is exact for the whole key universe the cascade was built on, and looking up needs no join:
the filters are scalar subqueries, one array of words each.

A filter's size follows the number of listed keys.  Up to ``MOST_BITS`` bits a level is one array that
every task holds; beyond it keys are dealt into shards of that size, and looked-up keys meet the
filters of their shard by a join.

Defined results: a null url, or one without "://", has empty host and path and takes the verdict of the
empty key; equal rows give equal results; an empty table gives an empty result; an empty list blocks
nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified

# fixed values: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: bits a key and hash functions, of level 0 and of the others
FIRST, LATER = (10, 4), (6, 3)
#: bits of one filter array (2 MB)
MOST_BITS = 1 << 24
#: hosts whose digest starts so are the stand-in for a block list
LIST_PREFIX = "0"


def candidate_keys(host: Column, path: Column, rules=RULES) -> Column:
    """All keys that a listed one could equal: the host's own and parent domains, with the path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(p) for _, p, _ in rules})
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    own = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name + ":"), x))
    return F.concat(tag("allow", own), tag("block", own), tag("list", hosts))


class Cascade:
    """The levels of a filter; each is a stored table of one row for each shard."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """``listed`` and ``universe`` have a column ``key``; every key looked up later must be in ``universe``."""
        self.spark = listed.sparkSession
        sets = [stage(listed.where("key IS NOT NULL").select("key").distinct(), "cascade-listed")]
        n = sets[0].count()
        self.shards = max(1, -(-n * FIRST[0] // MOST_BITS))
        self.levels: list[DataFrame] = []
        self._add(sets[0], n)
        taken = self._taken(universe.where("key IS NOT NULL").select("key"), 0).distinct()
        sets.append(stage(taken.join(sets[0], "key", "left_anti"), "cascade-false"))
        while n := sets[-1].count():
            self._add(sets[-1], n)
            sets.append(stage(self._taken(sets[-2], len(self.levels) - 1), "cascade-level"))

    def _add(self, keys: DataFrame, n: int) -> None:
        bits, hashes = LATER if self.levels else FIRST
        words = max(1, -(-n * bits // self.shards // 64))
        at = F.explode(F.array(*[self._position(F.col("key"), len(self.levels), j, F.lit(words)) for j in range(hashes)]))
        found = keys.select(self._shard(F.col("key")).alias("shard"), at.alias("at")).select("shard", F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bits"))
        zero = self.spark.range(self.shards * words).select(F.floor(F.col("id") / words).alias("shard"), (F.col("id") % words).alias("word"), F.lit(0).cast("long").alias("bits"))
        merged = found.unionByName(zero).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        rows = merged.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
        self.levels.append(stage(rows.select("shard", F.col("w.bits").alias("bits")), "cascade-filter"))

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("long")

    @staticmethod
    def _position(key: Column, level: int, j: int, words: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level * 16 + j)), words.cast("long") * 64)

    def _has(self, key: Column, level: int, bits: Column) -> Column:
        out = F.lit(True)
        for j in range((LATER if level else FIRST)[1]):
            at = self._position(key, level, j, F.size(bits))
            out = out & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def _taken(self, keys: DataFrame, level: int) -> DataFrame:
        """The keys that a level takes."""
        if self.shards == 1:
            return keys.where(self._has(F.col("key"), level, self._bits(level)))
        both = keys.withColumn("shard", self._shard(F.col("key"))).join(self.levels[level], "shard")
        return both.where(self._has(F.col("key"), level, F.col("bits"))).select("key")

    def _bits(self, level: int) -> Column:
        return self.levels[level].select("bits").scalar()

    def member(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``hit``: whether their ``key``, one of the universe, is listed."""
        bits = [self._bits(level) for level in range(len(self.levels))] if self.shards == 1 else [F.col(f"__bits{level}") for level in range(len(self.levels))]
        if self.shards > 1:
            rows = rows.withColumn("__shard", self._shard(F.col("key")))
            for level, table in enumerate(self.levels):
                rows = rows.join(table.select(F.col("shard").alias("__shard"), F.col("bits").alias(f"__bits{level}")), "__shard")
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._has(F.col("key"), level, bits[level]), F.lit(level % 2 == 1)).otherwise(out)
        return rows.withColumn("hit", out).drop("__shard", *[f"__bits{level}" for level in range(len(self.levels))])


def judge(pages: DataFrame, listed_hosts: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every url.

    The longest rule that fits decides; without one, a url is blocked when its host or a parent domain is
    in ``listed_hosts`` (a column ``host``), by default the hosts of the corpus whose digest starts with
    ``LIST_PREFIX``.
    """
    url = identified(pages, "page_id", "url").withColumn("url", F.coalesce("url", F.lit("")))
    rest = url.withColumn("rest", F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END"))
    parts = rest.select("page_id", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
                        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    if listed_hosts is None:
        listed_hosts = parts.select("host").where((F.col("host") != "") & F.md5("host").startswith(LIST_PREFIX)).distinct()
    fixed = [(f"{v}:{h}{p}",) for h, p, v in rules]
    listed = listed_hosts.select(F.concat(F.lit("list:"), "host").alias("key")).unionByName(pages.sparkSession.createDataFrame(fixed, "key string"))
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    cascade = Cascade(listed, parts.select(F.explode(keys).alias("key")))
    rows = parts.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.posexplode(keys).alias("pos", "key"))
    rows = cascade.member(rows)
    is_list = F.col("key").startswith("list:")
    code = F.when(F.col("hit") & ~is_list, F.length("key").cast("long") * (1 << 20) + F.col("pos"))
    found = rows.groupBy("row", "page_id", "host", "path").agg(F.max(code).alias("code"), F.max(F.col("hit") & is_list).alias("listed"))
    best = F.get(candidate_keys(F.col("host"), F.col("path"), rules), (F.col("code") % (1 << 20)).cast("int"))
    found = found.select("page_id", "host", "path", "listed", best.alias("best"))
    return found.select("page_id", "host", "path", F.expr("substring(best, 7)").alias("rule"),
                        F.when(F.col("best").isNotNull(), F.left("best", F.lit(5))).when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "listed")
