"""Token files against the library, the perfect hash, torn files, and small shards."""

import collections
import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelweave.llm import perfect_hash, token_files, word_ids
from parcelweave.llm.token_counts import default_path, load_tokenizer

AWKWARD = ["a", "B", "'s", "'", "<|endoftext|>", "<|", "|>", "<", "é", "É", "×", "÷", "ß", "́", "̸", "Σ", "ς", "1", "٣", " ", "\n", "\t", "\x0b", " ", "　", "!", "&", "—", "東", "İ", "'re", "\x00", "\x85"]


@functools.cache
def tokenizer():
    return load_tokenizer(default_path())


def library(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def plain(rows):
    """(start, n_tokens, crc) by id, as a list of those that share it; rows without an id come last."""
    out, start, ids = collections.defaultdict(list), 0, {}
    by_id = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        by_id[doc_id].append(text)
    for doc_id in sorted(by_id, key=lambda k: (k is None, k)):
        for text in by_id[doc_id]:
            ids.setdefault(text, [*library(text), token_files.END_ID])
        out[doc_id] = collections.Counter((len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for t in by_id[doc_id])
    return out, ids


def check(rows, got):
    want, ids = plain(rows)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for k, *_ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # gapless, ascending, the right ids for each row
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is None, k or 0))
    found = collections.defaultdict(collections.Counter)
    for r in got:
        found[r.doc_id][r.n_tokens, r.ids_crc32] += 1
    assert found == want


def test_word_ids_are_the_librarys():
    rng = random.Random(1)
    texts = ["".join(rng.choice(AWKWARD) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    ids, at, terms, terms_at = word_ids.WordIds(default_path()).encode(pa.array([*texts, None, ""]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in texts] + [[], []]
    assert len(terms) == terms_at[-1] and len(terms_at) == len(texts) + 3


def test_word_ids_store_is_bounded(monkeypatch):
    monkeypatch.setattr(word_ids, "STORE_WORDS", 5)
    assert word_ids.WordIds(default_path()).most == 5
    monkeypatch.setattr(word_ids, "LEARN_WORDS", 3)
    coder = word_ids.WordIds(default_path())
    for text in ("one two three four five six seven", "eight one two", "", "nine"):
        ids, _, terms, _ = coder.encode(pa.array([text, text.upper()]))
        assert ids.tolist() == library(text) * 2 and terms[: len(terms) // 2].tolist() == terms[len(terms) // 2 :].tolist()
    assert len(coder.store) <= 5 + 7


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = word_ids.WordIds(path)
    assert not coder.by_word
    other = load_tokenizer(path)
    texts = ["two words, one text", "", " x"]
    ids, at, _, _ = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("shard, keys", [(8 << 20, 1 << 15), (3000, 20)])
def test_files_hold_what_the_library_gives(spark, docs, rows, monkeypatch, shard, keys):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard)
    monkeypatch.setattr(token_files, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(token_files, "BUCKET_KEYS", keys)
    monkeypatch.setattr(token_files, "COPY_BLOCK", 2)
    check([*rows, (None, "no id")], token_files.written(docs).collect())


def test_files_read_by_key(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 4000)
    files = token_files.TokenFiles.write(docs)
    asked = spark.createDataFrame([(rows[0][0], 0), (rows[0][0], 2), (rows[0][0], 3), (1000, 0), (1003, 0), (999_999, 0), (None, 0)], "doc_id long, copy long")
    got = {(r.doc_id, r.copy): r.ids for r in files.read(asked).collect()}
    ids = library(rows[0][1]) + [token_files.END_ID]
    assert got == {(rows[0][0], 0): ids, (rows[0][0], 2): ids, (1000, 0): [token_files.END_ID], (1003, 0): [*library("one"), token_files.END_ID]}
    assert files.shards().count() > 5


def test_raw_ids_lead_the_file(spark, rows, tmp_path):
    """The payload can be mapped from the file's first byte."""
    one = spark.createDataFrame([rows[0][:2]], "doc_id long, text string")
    token_files.TokenFiles.write(one, str(tmp_path / "files"))
    (file,) = [p for p in (tmp_path / "files" / "ids").glob("part-*") if p.stat().st_size]
    ids = [*library(rows[0][1]), token_files.END_ID]
    assert np.fromfile(file, "<u2", len(ids)).tolist() == ids
    with pytest.raises(ValueError, match="torn"):
        token_files.open_shard(file.read_bytes()[:-1])


def test_files_of_nothing(spark, nothing):
    assert token_files.written(nothing).collect() == []


def test_wide_ids(spark):
    got = token_files.written(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), end_id=70_000).collect()
    ids = [*library("a b"), 70_000]
    assert sorted(map(tuple, got)) == [(1, 0, 3, zlib.crc32(np.array(ids, "<u4").tobytes())), (2, 3, 1, zlib.crc32(np.array([70_000], "<u4").tobytes()))]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    copies = rng.integers(0, 3, len(ids))
    index = perfect_hash.Index(perfect_hash.build(ids, copies, [np.arange(len(ids), dtype=np.uint64)]))
    assert sorted(index.numbers(ids, copies).tolist()) == list(range(len(ids)))  # minimal and perfect
    here, value = index.find(ids, copies)
    assert here.all() and value.tolist() == list(range(len(ids)))
    foreign, _ = index.find(ids + 1, copies)
    assert foreign.sum() <= 1  # one in four billion
    if n == 40_000:
        assert len(perfect_hash.build(ids, copies, [])) / len(ids) < 5.2  # bytes to a key, four of them its fingerprint


def test_perfect_hash_lists_what_collides(monkeypatch):
    monkeypatch.setattr(perfect_hash, "hashed", lambda ids, copies: np.asarray(ids).astype(np.uint64) // np.uint64(4))
    ids, copies = np.arange(40), np.zeros(40, np.int64)
    here, value = perfect_hash.Index(perfect_hash.build(ids, copies, [np.arange(40, dtype=np.uint64)])).find(ids, copies)
    assert here.all() and value.tolist() == list(range(40))
