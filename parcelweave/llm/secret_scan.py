"""Secret scans over a trigram inverted index.

Every rule is a regular expression.  From its syntax tree a Boolean query over trigrams is derived:
each run of fixed characters must occur, so all its trigrams must; alternatives are or-ed.  Within a
task each step of documents gets an inverted index (trigram -> documents) restricted to the trigrams
that some rule asks for, the queries intersect and unite its postings, and only candidates are
verified with the expression itself.  A rule without a mandatory trigram scans every text.

Defined results: a null text is an empty text; an empty text has no spans and the digest of the empty
string; equal rows give equal results; positions are code points of the whole text, however long.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, joined_bytes, steps

# fixed values: base rules in their listed order (kind, expression, group that is measured, least length)
BASE_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the same spans as [0-9a-f]+ of 16 and more: both are whole runs
)
# fixed values: further rules, formats of well-known credentials
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
)
RULES = BASE_RULES + MORE_RULES
#: strings that one run of fixed characters may stand for before it is given up as "anything"
MOST_STRINGS = 64

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_other long, base_sha256 string, spans string"


def _strings(item) -> set[str] | None:
    """All lower-case strings that a node of the syntax tree stands for, or None when there are too many."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 6 else None
    if op is sre.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        part = _strings(item)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a, b in itertools.product(out, part)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """Conjunction of disjunctions of trigram sets; an empty conjunction holds for every text."""
    flat, todo = [], list(_parser.parse(pattern))
    while todo:  # groups that are no alternation by themselves are opened
        item = todo.pop(0)
        if item[0] is sre.SUBPATTERN and _strings(item) is None:
            todo = list(item[1][3]) + todo
        else:
            flat.append(item)
    runs, run = [], {""}
    for item in [*flat, None]:
        part = None if item is None else _strings(item)
        if part is None or len(run) * len(part) > MOST_STRINGS:
            runs.append(run)
            run = {""} if part is None else part
        else:
            run = {a + b for a, b in itertools.product(run, part)}
    runs.append(run)
    query = []
    for strings in runs:
        if all(len(s) >= 3 and s.isascii() for s in strings):
            sets = {frozenset(s[i : i + 3].encode() for i in range(len(s) - 2)) for s in strings}
            query.append([s for s in sets if not any(t < s for t in sets)])
    return query


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Scanner:
    """The rules, compiled once for each task."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for *_, query in self.rules:
            for sets in query:
                for trigrams in sets:
                    self.wanted[[_code(t) for t in trigrams]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """Trigram -> ascending document numbers, for the trigrams that the rules ask for."""
        data, offsets = joined_bytes(texts)
        if len(data) < 3:
            return {}
        low = self.lower[data].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[codes])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | doc[inside])
        trigram = pairs >> 32
        cuts = np.flatnonzero(np.diff(trigram)) + 1
        return {int(part[0] >> 32): part & 0xFFFFFFFF for part in np.split(pairs, cuts) if len(part)}

    def candidates(self, query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        docs, none = np.arange(n), np.zeros(0, np.int64)
        for sets in query:
            found = none
            for trigrams in sets:
                both = None
                for t in trigrams:
                    p = index.get(_code(t), none)
                    both = p if both is None else np.intersect1d(both, p, assume_unique=True)
                found = np.union1d(found, both)
            docs = np.intersect1d(docs, found, assume_unique=True)
        return docs

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), in order."""
        index, strings = self.postings(texts), texts.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
        for number, (_, expression, group, least, query) in enumerate(self.rules):
            for k in self.candidates(query, index, len(strings)):
                if strings[k]:
                    out[k] += [(m.start(), number, m.end()) for m in expression.finditer(strings[k]) if m.end(group) - m.start(group) >= least]
        for found in out:
            found.sort()
        return out


def _listed(found, rules=RULES) -> str:
    return ",".join(f"{rules[number][0]}:{start}:{end}" for start, number, end in found)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    def run(batches):
        scanner = Scanner()
        for step in steps(batches, "text"):
            rows = []
            for doc_id, found in zip(step.column(0).to_pylist(), scanner.spans(step.column(1))):
                base = [x for x in found if x[1] < len(BASE_RULES)]
                counts = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((doc_id, *counts, len(found) - len(base), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "n_other", "base_sha256", "spans"])

    return identified(docs, "doc_id", "text").mapInArrow(run, RESULT)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of a secret replaced by ``<kind>``; spans that overlap become one.

    All columns stay; ``n_chars``, where present, is counted anew for texts that changed.
    """
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        scanner = Scanner()
        for step in steps(batches, "text"):
            texts, columns = step.column(at).to_pylist(), list(step.columns)
            sizes = columns[size].to_pylist() if size is not None else None
            for k, found in enumerate(scanner.spans(step.column(at))):
                if not found:
                    continue
                parts, done = [], 0
                for start, number, end in found:
                    if start >= done:
                        parts += [texts[k][done:start], f"<{RULES[number][0]}>"]
                    done = max(done, end)
                texts[k] = "".join([*parts, texts[k][done:]])
                if sizes is not None:
                    sizes[k] = len(texts[k])
            columns[at] = pa.array(texts, step.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, step.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=step.schema)

    return docs.mapInArrow(run, docs.schema)
