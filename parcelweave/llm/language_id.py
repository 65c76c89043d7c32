"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1.  A trigram's vector binds (multiplies) its letters'
vectors, the first permuted twice, the second once; a document bundles (adds) the vectors of all its
trigrams; a language's prototype bundles its learning documents, each scaled to length one.  A document
goes to the prototype with the largest cosine.

Letters outside a-z share ``HASHED_LETTERS`` symbols by hash and everything else is one symbol, so the
table of trigram vectors has a fixed size (``SYMBOLS``^3 x ``DIMENSIONS`` bytes) for any script.

Learning is two steps: every task adds up its documents by language (one row for each language and
task), and one aggregate adds the rows.  Prototypes are as many as languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing can be learned; equal texts get equal results; of languages with equal cosine the first in
order wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import identified, kept, steps

DIMENSIONS = 512
HASHED_LETTERS = 21
SYMBOLS = 1 + 26 + HASHED_LETTERS
#: one document of so many is held out, by crc32 of its id
FOLDS = 5
UNKNOWN = "und"
SEED = 20_17


def _symbols() -> np.ndarray:
    """Code point -> symbol; 0 is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) - 96 if "a" <= low <= "z" and len(low) == 1 else 27 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % HASHED_LETTERS
    return table


def _trigrams() -> np.ndarray:
    """The bound vector of every trigram of symbols, as int8."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    pairs = (first[:, None, :] * second[None, :, :]).reshape(SYMBOLS**2, 1, DIMENSIONS)
    return (pairs * letters[None, :, :]).reshape(SYMBOLS**3, DIMENSIONS)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    return kept("language", lambda: (_symbols(), _trigrams()))


def profile(text: str | None) -> np.ndarray | None:
    """The bundled vector of a text, scaled to length one; None without a letter."""
    if not text:
        return None
    symbols, trigrams = _tables()
    s = symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return None
    s = s[(s != 0) | (np.append(0, s[:-1]) != 0)]  # a run of other characters is one border
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    if len(codes) > SYMBOLS**3:
        counts = np.bincount(codes, minlength=SYMBOLS**3)
        ids = np.flatnonzero(counts)
        counts = counts[ids]
    else:
        ids, counts = np.unique(codes, return_counts=True)
    out = np.zeros(DIMENSIONS, np.float32)
    for k in range(0, len(ids), 4096):
        out += counts[k : k + 4096].astype(np.float32) @ trigrams[ids[k : k + 4096]].astype(np.float32)
    length = float(np.linalg.norm(out))
    return out / length if length else None


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> prototype of length one, from the labelled documents that are not held out."""
    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for step in steps(batches, "text"):
            for text, lang in zip(step.column(0).to_pylist(), step.column(1).to_pylist()):
                p = profile(text)
                if p is not None:
                    sums[lang] = sums.get(lang, 0) + p.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = identified(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    parts = rows.select("text", "lang").mapInArrow(add, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, at, x in summed.collect():  # languages x dimensions, whatever the corpus
        found.setdefault(lang, np.zeros(DIMENSIONS))[at] = round(x, 6)
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v)}


def _with_language(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], lang: str, score: str) -> DataFrame:
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS)
    at = keep.index("text")

    def run(batches):
        for step in steps(batches, "text"):
            found = []
            for text in step.column(at).to_pylist():
                p = profile(text) if names else None
                cosines = None if p is None else matrix @ p
                best = None if p is None else int(np.argmax(cosines))
                found.append((UNKNOWN, 0.0) if p is None else (names[best], float(min(1.0, max(0.0, cosines[best])))))
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*step.columns, *more], [*step.schema.names, lang, score])

    df = docs.select(*keep)
    schema = StructType([*df.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return df.mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only its text decides."""
    rows = identified(docs, "doc_id", "text")
    out = _with_language(rows, learn(docs), ["doc_id", "text"], "lang_pred", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The documents whose language is known, with all their columns; ``und`` ones go."""
    out = _with_language(docs, learn(docs), docs.columns, "__lang_pred", "__score")
    return out.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least_score)).select(*docs.columns)
