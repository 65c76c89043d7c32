"""Cases on which earlier versions took more memory or work than needed."""

import tracemalloc

import numpy as np
import pyarrow as pa
from parcelweave.llm import common, ngram_join, word_ids
from parcelweave.llm.common import joined_bytes
from parcelweave.llm.token_counts import default_path


def test_cutting_words_holds_no_number_for_each_byte():
    data, offsets = joined_bytes(pa.array(["plain words and, some marks; " * 20_000, "", None, " ", " x"]))
    tracemalloc.start()
    words, at = word_ids.cut_words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 140_001 and at.tolist() == [0, 140_000, 140_000, 140_000, 140_000, 140_001]
    assert words[:7].to_pylist() == ["plain", "words", "and", ",", "some", "marks", ";"] and words[140_000].as_py() == "x"
    assert peak < 20 * len(data)


def test_words_have_names_without_a_second_store():
    coder = word_ids.WordIds(default_path())
    _, _, names, at = coder.encode(pa.array(["One one ONE two", "TWO <|x|>", ""]))
    assert at.tolist()[0] == 0 and at.tolist()[-1] == len(names)
    assert len(set(names[:3].tolist())) == 1 and names[3] == names[4] != names[0] and names.dtype == np.int64
    assert [name for name, kept in vars(coder).items() if isinstance(kept, dict)] == ["store"]


def test_plain_words_are_told_apart_without_places():
    """New words of letters alone need no offsets from the library; ids stay its own for all others."""
    coder = word_ids.WordIds(default_path())
    slow, encode = [], coder.tokenizer.encode

    class Watched:
        encode_batch_fast = coder.tokenizer.encode_batch_fast

        def encode(self, text, **more):
            slow.append(text)
            return encode(text, **more)

    texts = ["plain words älso größer", "İstanbul ẞ Ω ª 中文 Σςσ", "a1 don't '' x²! ①", "<|endoftext|> \x01 a\x01b \x0b \x1c"]
    coder.tokenizer, library = Watched(), coder.tokenizer
    ids, at, _, _ = coder.encode(pa.array(texts[:1]))
    assert slow == []
    ids, at, _, _ = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_gives_freed_memory_back_after_its_last_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c"])], ["text"])
    for step in common.steps(iter([batch, batch.slice(0, 0)]), "text", 2):
        assert step.num_rows == 1 and not given
    assert given == [True]


def test_finer_vectors_leave_links_and_drop_what_the_coarse_ones_keep():
    """Sets that share three quarters of their shingles stay under the count vectors, so their texts moved; the finer vectors tell them apart."""
    shingles = np.unique(np.random.default_rng(3).integers(0, 2**63, 4000, dtype=np.uint64))
    first, most, link = shingles[:1000], shingles[250:1250], shingles[100:1100]
    fine = lambda s: ngram_join.count_vector(s, ngram_join.FINE_SIZE, ngram_join.FINE_GROUPS)
    assert not ngram_join.linked(first, most) and ngram_join.linked(first, link)
    assert ngram_join.may_link(ngram_join.count_vector(first), ngram_join.count_vector(most), 1000, 1000)
    assert not ngram_join.may_link(fine(first), fine(most), 1000, 1000)
    assert ngram_join.may_link(fine(first), fine(link), 1000, 1000)
