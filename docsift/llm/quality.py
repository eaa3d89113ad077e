"""Quality rules as a short-circuit cascade.

Every rule is a test on whole texts that rejects some of them. A document is kept
if no rule rejects it, so the order of the rules changes the work and never the
result. Each task measures, on the first ``SAMPLE_DOCS`` documents it meets, what
every rule costs and whom it rejects. It then orders the rules greedily by
rejections per second among the documents that the rules before have left, and
runs the rest of its input through that order: a document that a rule has rejected
is not shown to the next rule. The estimate needs no pass of its own, no collect,
and is made anew by any task that is run again.

Null and empty texts have no words and are rejected by ``few_words``. Repeated rows
are judged one by one. Columns other than the text are carried along unread.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, Words, batch_map, mix, slices, with_bytes
from .tokens import release

SAMPLE_DOCS = 256

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True


class Facts:
    """Statistics of a slice of documents, each computed when a rule first asks."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.words = Words(texts)
        self._known: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = _FACTS[name](self)
        return self._known[name]

    def bytes_per_doc(self, flags: np.ndarray) -> np.ndarray:
        offsets = np.frombuffer(self.texts.buffers()[1], np.int32)[self.texts.offset : self.texts.offset + len(self.texts) + 1]
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[offsets - offsets[0]])

    def words_per_doc(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.words.first])


def _word_chars(f: Facts) -> np.ndarray:
    starts_char = (f.words.data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(starts_char)])
    inside = np.concatenate([[0], np.cumsum(sums[f.words.end] - sums[f.words.start])])
    return np.diff(inside[f.words.first])


def _lines(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    lines, repeated = [], []
    for text in f.texts.to_pylist():
        text = (text or b"") if isinstance(text, bytes) else (text or "").encode()
        filled = [line for line in text.split(b"\n") if line.strip()]
        lines.append(len(filled))
        repeated.append(len(filled) - len(set(filled)))
    return np.array(lines, np.int64), np.array(repeated, np.int64)


def _repeat_words(f: Facts) -> np.ndarray:
    """Words covered by a 3-word window that is found twice or more in their text."""
    code, owner = f.words.code, f.words.owner
    covered = np.zeros(len(code), bool)
    if len(code) >= 3:
        key = code[:-2] * np.uint64(0x9E3779B97F4A7C13) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        key = mix(key[whole] + mix(owner[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = whole[twice]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    return f.words_per_doc(covered)


def _lettered(f: Facts) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_LETTER[f.words.data])])
    return f.words_per_doc(sums[f.words.end] > sums[f.words.start])


_FACTS: dict[str, Callable[[Facts], np.ndarray]] = {
    "n_words": lambda f: np.diff(f.words.first),
    "word_chars": _word_chars,
    "n_symbols": lambda f: f.bytes_per_doc(_SYMBOL[f.words.data]),
    "n_upper": lambda f: f.bytes_per_doc(_UPPER[f.words.data]),
    "n_letters": lambda f: f.bytes_per_doc(_LETTER[f.words.data] & ((f.words.data & 0xC0) != 0x80)),
    "n_lettered": _lettered,
    "lines": _lines,
    "n_lines": lambda f: f.lines[0],
    "n_dup_lines": lambda f: f.lines[1],
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], np.ndarray]


#: The first two are the base of the contract; the others are the method's own.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repetition", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 15 * f.n_words)),
    Rule("capitals", lambda f: 2 * f.n_upper > f.n_letters),
    Rule("no_letters", lambda f: 10 * f.n_lettered < 7 * f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
)
BASE = ("few_words", "repetition")


class Cascade:
    """The rules with their order, learnt from the first documents."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS):
        self.rules, self.sample_docs = rules, sample_docs
        self.order: list[Rule] | None = None
        self._seconds = np.zeros(len(rules))
        self._rejected: list[np.ndarray] = []

    def kept(self, texts: pa.Array) -> np.ndarray:
        """Whether each text passes all rules."""
        out = np.ones(len(texts), bool)
        done = 0
        if self.order is None:
            done = min(len(texts), self.sample_docs - sum(map(len, self._rejected)))
            out[:done] = self._sampled(texts.slice(0, done))
        alive = np.arange(done, len(texts))
        facts = Facts(texts.slice(done)) if len(alive) else None
        for rule in self.order or ():
            if not len(alive):
                break
            bad = rule.rejects(facts)
            out[alive[bad]] = False
            if bad.any():  # the next rule sees only what is left, and what it needs is computed for that alone
                alive = alive[~bad]
                facts = Facts(texts.take(pa.array(alive)))
        return out

    def _sampled(self, texts: pa.Array) -> np.ndarray:
        """All rules on a part of the sample, each timed with all that it needs."""
        verdicts = []
        for i, rule in enumerate(self.rules):
            began = time.perf_counter()
            verdicts.append(rule.rejects(Facts(texts)))
            self._seconds[i] += time.perf_counter() - began
        self._rejected.append(np.array(verdicts).T.reshape(len(texts), len(self.rules)))
        if sum(map(len, self._rejected)) >= self.sample_docs:
            found = by_rejection_per_cost(np.concatenate(self._rejected), self._seconds)
            self.order = [self.rules[i] for i in found]
        return ~self._rejected[-1].any(axis=1)


def by_rejection_per_cost(rejected: np.ndarray, seconds: np.ndarray) -> list[int]:
    """Order of rules: again and again the one that rejects most of what is left per second.

    ``rejected`` has a row for each sampled document and a column for each rule.
    Rules that reject nothing more come last, the cheapest first.
    """
    left, order, open_ = np.ones(len(rejected), bool), [], list(range(rejected.shape[1]))
    while open_:
        gain = rejected[left][:, open_].sum(axis=0) / np.maximum(seconds[open_], 1e-9)
        best = max(range(len(open_)), key=lambda i: (gain[i], -seconds[open_[i]]))
        order.append(open_.pop(best))
        left &= ~rejected[:, order[-1]]
    return order


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cascade = Cascade(rules)
        for batch in batches:
            for part in slices(batch, text, WORD_BYTES):
                yield part.filter(pa.array(cascade.kept(part.column(text))))

    return batch_map(docs, run, docs.schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each document its statistics, whether a base rule rejects it, and whether the cascade keeps it.

    The statistics are wanted for every document here, so only the verdict of the
    other rules is short-circuited.
    """
    others = tuple(r for r in rules if r.name not in BASE)
    base = tuple(r for r in rules if r.name in BASE)
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(others)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                facts = Facts(texts)
                failed = np.zeros(len(texts), bool)
                for rule in base:
                    failed |= rule.rejects(facts)
                kept = ~failed
                left = np.flatnonzero(kept)
                kept[left] = cascade.kept(texts.take(pa.array(left)))
                columns = [part.column("doc_id").cast(pa.int64())] + [pa.array(getattr(facts, n).astype(np.int64)) for n in numbers]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(failed), pa.array(kept)],
                    names=["doc_id", *numbers, "base_failed", "kept"],
                )

    return with_bytes(docs, "doc_id").mapInArrow(run, schema)


