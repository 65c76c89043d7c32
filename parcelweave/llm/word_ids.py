"""Token ids of texts, word by word, from a bounded store; the library encodes only words not seen before.

The vocabulary cuts a text into runs of letters, single digits and runs of marks, and drops white space, so
no token crosses white space, and none crosses the place between a letter and an ASCII mark behind it.
Texts are cut there as whole byte arrays; the distinct words of a step are looked up once.  Special
strings hold such a place in front of their ``|>``, where no word is cut.

Another vocabulary, whose rules are not these, encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .common import joined_bytes, kept
from .token_counts import load_tokenizer

#: words a worker keeps at most; beyond it those met in several steps stay, half as many at most
STORE_WORDS = 250_000
#: new words that the library encodes as one text
LEARN_WORDS = 256
# fixed value: the rule by which the vocabulary cuts texts
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# fixed value: how names of tokens end that end a part
LAST = "</w>"

_SPACE, _LETTER, _MARK, _LATIN = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_KIND[0xC3] = _LATIN  # leads the letters from U+00C0 to U+00FF


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and the n+1 places where each text's words begin."""
    kind = _KIND[data]
    solid = kind != _SPACE
    begin = np.empty(len(data), bool)
    if len(data):
        begin[0] = True
        letter = kind[:-1] == _LETTER
        follows = np.flatnonzero(kind == _LATIN) + 1  # the second byte of a letter; two signs among them are none
        follows = follows[follows < len(data) - 1]
        letter[follows] = (data[follows] != 0x97) & (data[follows] != 0xB7)
        part = letter & (kind[1:] == _MARK)
        part &= ~((data[1:] == ord("|")) & (np.append(data[2:], 0) == ord(">")))
        begin[1:] = ~solid[:-1] | part
        inner = offsets[1:-1]
        begin[inner[inner < len(data)]] = True
        begin &= solid
    at = np.flatnonzero(begin)
    # solid bytes from one begin to the next, without a number for each byte
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(solid, at, dtype=np.int64))]) if len(at) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    return words, np.searchsorted(at, offsets)


def parts_words(path: str) -> bool:
    """Whether the vocabulary's rules are those that make the cuts safe."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"]) and t["content"].endswith("|>") and t["content"][2:-2].isalpha() for t in rules["added_tokens"])
    return plain and rules["post_processor"] is None and parts[0].get("pattern", {}).get("Regex") == PARTS and parts[0].get("behavior") == "Removed"


class WordIds:
    """Ids of texts by a store of words; with ``terms`` the words have 64-bit names, case folded."""

    def __init__(self, path: str, terms: bool = True, most: int | None = None):
        self.terms, self.most = terms, most or STORE_WORDS
        self.tokenizer = load_tokenizer(path)
        self.by_word = parts_words(path)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        if sum(len(t) == 1 + len(LAST) and t.endswith(LAST) for t in names) >= 256:  # one for each byte, so every part has a last token
            self.last[[i for t, i in names.items() if t.endswith(LAST)]] = True
        self.clear()

    def clear(self) -> None:
        self.store: dict[str, int] = {}
        self.flat, self.at, self.term = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Leaves the words met in most steps."""
        least = 2
        while (kept := np.flatnonzero(self.met >= least)).size > self.most // 2:
            least *= 2
        names = list(self.store)
        size = np.diff(self.at)[kept]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.at[kept] - ends[:-1], size) + np.arange(ends[-1])]
        met = self.met[kept] // 2
        self.clear()
        words = [names[k] for k in kept.tolist()]
        self._stored(words, flat, ends)
        self.met = met

    def _stored(self, words: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        self.store.update(zip(words, range(len(self.store), len(self.store) + len(words))))
        terms = [hash(w if "<|" in w else w.lower()) for w in words] if self.terms else [0] * len(words)
        self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + ends[1:]])
        self.term, self.met = np.concatenate([self.term, np.array(terms, np.int64)]), np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, many as one text."""
        words = sorted(words, key=str.isalpha)
        rest = sum(not w.isalpha() for w in words)
        flat, sizes = [], [np.zeros(1, np.int64)]
        for some in (words[:rest], words[rest:]):
            for k in range(0, len(some), LEARN_WORDS):
                ids, size = self._encoded(some[k : k + LEARN_WORDS])
                flat.append(ids)
                sizes.append(size)
        self._stored(words, np.concatenate(flat), np.cumsum(np.concatenate(sizes)))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of each word's."""
        text = " ".join(words)
        if words[0].isalpha():
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.last[ids])
            if len(last) == len(words):  # a word has one part at least, so each has one
                return ids, np.diff(last, prepend=-1)
        found = self.tokenizer.encode(text, add_special_tokens=False)  # a token belongs to the word it starts in
        ends = np.cumsum([len(w) + 1 for w in words])
        of = np.searchsorted(ends, np.fromiter((a for a, _ in found.offsets), np.int64, len(found)), "right")
        return np.array(found.ids, np.uint32), np.bincount(of, minlength=len(words))

    def numbers(self, words: pa.Array) -> np.ndarray:
        if len(self.store) > self.most:
            self._thin()
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.store.get, names))
        if None in found:
            self._learn([w for w, n in zip(names, found) if n is None])
            found = list(map(self.store.__getitem__, names))
        found = np.array(found, np.int64)
        self.met[found] += 1
        return found[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their n+1 offsets, and the same of the names of their words."""
        if not self.by_word:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            offsets = np.cumsum([0, *map(len, found)])
            ids = np.concatenate([np.zeros(0, np.uint32), *found])
            return ids, offsets, ids.astype(np.int64), offsets
        words, at = cut_words(*joined_bytes(texts))
        if not len(words):
            return np.zeros(0, np.uint32), at, np.zeros(0, np.int64), at
        number = self.numbers(words)
        size = self.at[number + 1] - self.at[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1])
        place += np.repeat(self.at[number] - ends[:-1], size)
        return self.flat[place], ends[at], self.term[number], at


def word_ids(path: str, terms: bool = True, most: int | None = None) -> WordIds:
    """The store of this worker, which outlives a task."""
    return kept(f"words {terms} {path}", lambda: WordIds(path, terms, most))
