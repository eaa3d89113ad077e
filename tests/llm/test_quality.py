import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docsift.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_report_matches_brute_force(docs, rows):
    want = sorted((-1 if i is None else i, *expected(t)) for i, t in rows)
    got = quality.quality_report(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_short_circuit_keeps_what_all_rules_keep(rows):
    texts = pa.array([(t or "").encode() for _, t in rows] * 8)
    alone = ~np.array([r.rejects(quality.Facts(texts)) for r in quality.RULES]).any(axis=0)
    for size in (0, 1, 17, 10_000):
        cascade = quality.Cascade(sample_docs=size)
        parts = [cascade.kept(texts.slice(i, 50)) for i in range(0, len(texts), 50)]
        assert (np.concatenate(parts) == alone).all()


def test_order_is_by_rejection_per_cost():
    rejected = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert quality.by_rejection_per_cost(rejected, np.array([1.0, 0.1, 1.0])) == [1, 0, 2]
    assert quality.by_rejection_per_cost(rejected[:0], np.array([3.0, 1.0, 2.0])) == [1, 2, 0]


def test_keep_good_returns_all_columns(docs, rows, empty):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    texts = {t for _, t in rows if t and not expected(t)[-1]}
    assert {r["text"] for r in kept.collect()} <= texts
    assert quality.keep_good(empty).count() == 0 and quality.quality_report(empty).count() == 0
