"""URL filters, embeddings, components, the registered SQL and the pipeline."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from parcelweave.llm import embedding_dedup, language_id, mixing, ngram_join, packing, secret_scan, url_filter
from parcelweave.llm import queries as llm
from parcelweave.llm.components import components

SF = "/root/testdata/sf0.001"


def judged(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = max(((len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    parents = host.split(".")
    blocked = any(".".join(parents[k:]) in listed for k in range(len(parents)))
    return host, path, fits and fits[1], fits[2] if fits else "block" if blocked else "allow"


def urls(n=300):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(("a", "B", "shop", "example", "x1")) for _ in range(rng.randrange(1, 4))) + rng.choice((".com", ".org", ".net", ".example.org", ""))
    out = [f"{rng.choice(('http', 'HTTPS'))}://{host()}{rng.choice(('', '/', '/fr/1', '/de/', '/es/x', '/en/12', '/en/2'))}{rng.choice(('', '?q=/es/', '#top'))}" for _ in range(n)]
    return list(enumerate(out + [None, "", "no scheme", "://", "x://?y", "a://b://c", out[0], "https://example.org", "https://badexample.org/es/", "http://org/es/"])) + [(0, out[0])]


@pytest.mark.parametrize("bits", [1 << 24, 256])
def test_url_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "MOST_BITS", bits)
    rows = urls()
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))
    seen = {judged(u, set())[0] for _, u in rows} - {""}
    listed = {h for h in seen if hashlib.md5(h.encode()).hexdigest()[0] in "0123"}
    hosts = spark.createDataFrame([(h,) for h in [*listed, None]] + [("never.seen",)], "host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(df, hosts).collect()))
    assert got == sorted((i, h, p, r or "", v) for i, u in rows for h, p, r, v in [judged(u, listed)])


def test_url_filter_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(universe.where("key % 10 = 3"), universe)
    assert len(cascade.levels) > 2
    assert cascade.member(universe).where("hit <> (key % 10 = 3)").count() == 0


def vectors():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16))
    rows = []
    for k in range(300):
        v = centers[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((k * 2, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 16, 1), (1004, [1.0, None], 1), (1005, [float("nan")] * 16, 1), (1006, [float("inf")] * 16, 1), (1007, rows[0][1], None),
             (1008, rows[0][1], 0), (1009, rows[0][1], 0), (1010, [x * 2 for x in rows[0][1]], 0), (1011, rows[0][1][:8], 0), (1012, rows[0][1], 1)]
    return rows + [rows[3], rows[3]]


def linked(rows):
    good = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    at = {k: n for n, k in enumerate(range(len(good)))}
    links = collections.Counter()
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in at:
        for b in at:
            (i, v, x), (j, w, y) = good[a], good[b]
            if a != b and x == y and len(v) == len(w) and np.dot(v, w) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(w, w)) >= 0.98:
                links[a] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    out = [(i, links[k], find(i), i == find(i)) for k, (i, _, _) in enumerate(good)]
    kept = collections.Counter(i for i, *_ in good)
    return sorted(out + [(i, 0, i, True) for i, v, lab in rows if not kept[i]])


@pytest.mark.parametrize("block", [1024, 5])
def test_embeddings_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("copies", F.lit(1))
    assert sorted(tuple(r) for r in embedding_dedup.link(df).collect()) == linked(rows)


@pytest.mark.parametrize("block, asks, slice_", [(5, 7, 3), (1024, 10, 256), (7, 16384, 2)])
def test_embeddings_lose_no_link_between_parts(spark, monkeypatch, block, asks, slice_):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", asks)
    monkeypatch.setattr(embedding_dedup, "SLICE_ROWS", slice_)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.link(df).collect()) == linked(rows)


def test_embedding_groups_are_bounded(spark):
    """A list that a whole table falls into: every member meets every query once, in groups of bounded size."""
    n = 40_000
    placed = spark.range(n).selectExpr("1L AS label", "2 AS dim", "X'00' AS v", "id", "1L AS copies", "0 AS list", "X'00' AS codes", "0D AS error", "array(0) AS probes")
    groups = embedding_dedup._dealt(placed).groupBy("label", "dim", "list", "block", "asks").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q")).collect()
    assert sum(g.m * g.q for g in groups) == n * n
    assert max(g.m for g in groups) < 1.3 * embedding_dedup.BLOCK_ROWS and max(g.q for g in groups) < 1.3 * embedding_dedup.QUERY_ROWS


def test_embeddings_empty(spark):
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 205), (205, 203)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 101: 100, 205: 200, 203: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    cursor = con.execute(llm.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages(spark):
    """Each stage on the rows before it, by its operator's tested result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mix", "pack"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    a = corpus_pipeline.language(spark, docs, SF)
    assert ids(a) == ids(language_id.predict(docs).where("lang_pred <> 'und'")) and a.columns == docs.columns
    b = corpus_pipeline.near_duplicates(spark, a, SF)
    assert ids(b) == ids(ngram_join.join(a).where("doc_id = component_id")) and 0 < b.count() < a.count()
    c = corpus_pipeline.secrets(spark, b, SF)
    assert ids(c) == ids(b) and secret_scan.scan(c).where("n_access + n_hex > 0").count() == 0
    d = corpus_pipeline.mix(spark, c, SF)
    assert d.columns == docs.columns
    words = d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == mixing.mix(c).agg(F.sum("taken")).first()[0]
    e = corpus_pipeline.pack(spark, d, SF)
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, packing.pack(d).collect()))
    assert corpus_pipeline.run(spark, SF).count() == e.count()
