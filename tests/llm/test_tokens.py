import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docsift.llm import coder, common, lattice, packing, prefix_counts, token_files
from docsift.llm.tokens import WordEncoder, load_tokenizer, tokenizer_path

ALPHABET = list("aA éÉßµªº²½'sTré\x1c\x85\xa0 \u0301\u2003é Ω漢İſΑΣ  \t\n12 ...\ufb01\xad\u212b") + ["<|endoftext|>", "'ll ", "don't", "the ", "ing "]


def strings(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "x" * 3000, " " * 300 + "a"]


def test_word_encoder_equals_library():
    path = tokenizer_path("word_bpe_49k.json")
    encoder, library = WordEncoder(path), load_tokenizer(path)
    for text in strings(3000):
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_every_prefix_has_its_exact_count():
    path = tokenizer_path("byte_bpe_50k.json")
    counter, library = prefix_counts.PrefixCounter(path), load_tokenizer(path)
    for text in strings(300):
        steps = counter.steps(text)
        assert len(steps) == len(text)
        count = np.cumsum(steps)
        for i in range(1, min(len(text), 80) + 1):
            assert count[i - 1] == len(library.encode(text[:i], add_special_tokens=False).ids), repr(text[:i])
        if text:
            fits = prefix_counts.fitting_prefix(steps.tobytes(), 5)
            assert fits == max([i + 1 for i in range(len(text)) if count[i] <= 5], default=0)


def test_pre_tokens_of_many_texts_are_counted_together():
    path = tokenizer_path("byte_bpe_50k.json")
    counter, library = prefix_counts.PrefixCounter(path), load_tokenizer(path)
    texts = strings(1500, 9) + ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a  b\n\n c ", "\n a", " ", "", "don't we've  we'll 're", "é" * 19 + "z" * 3, "漢" * 14]
    found = counter.steps_of(texts)
    for text, steps in zip(texts, found):
        assert len(steps) == len(text) and (steps == counter.steps(text)).all(), repr(text)
        assert steps.sum() == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    raw = sorted({p.encode() for t in strings(800, 10) for p in counter.PATTERN.findall(t[:60])})
    assert counter.changes(raw).tolist() == [n for t in raw for n in np.diff(counter.prefix(t)).tolist()]
    assert counter.changes([]).tolist() == [] and counter.steps_of([]) == []


def test_lookup_of_keys_that_share_a_place():
    keys = np.concatenate([np.arange(3000, dtype=np.uint64), np.uint64(2**63) + np.arange(3000, dtype=np.uint64)])
    found = common.Lookup(keys, np.arange(6000))
    assert (found.get(keys) == np.arange(6000)).all() and (found.get(keys + np.uint64(10_000)) == -1).all()
    assert (common.Lookup(keys[:0], np.arange(0)).get(keys) == -1).all()


def test_token_counts(docs, rows, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    library = load_tokenizer(path)
    got = prefix_counts.token_counts(docs, path, keep_steps=True).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) and prefix_counts.tokens_before(r["steps"], r["fits"]) <= 512 for r in got)
    assert prefix_counts.token_counts(empty, path).count() == 0


def lengths(counts):
    plan = packing.Plan(counts)
    filled = {}
    for length, _, n, sequence, each, offset in plan.steps:
        for j in range(n):
            filled.setdefault(sequence + j // each, []).append((offset + j % each * length, length))
    placed = Counter(length for own in filled.values() for _, length in own)
    assert placed == Counter({k: v for k, v in counts.items() if v}) and len(filled) == plan.sequences
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 2049, 400).tolist())
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert lengths(counts) <= least * 1.08 + 2


def test_plan_of_few_lengths():
    assert lengths({}) == 0 and lengths({1: 3}) == 1 and lengths({1024: 10}) == 5 and lengths({700: 100}) == 50
    assert lengths({683: 4, 682: 8}) <= 5 and lengths({2048: 7, 2047: 3, 1: 3}) == 10


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 2049, 2000).tolist())
    few, many = packing.Plan(counts), packing.Plan({k: v * 10**6 for k, v in counts.items()})
    assert len(many.steps) < 3 * len(few.steps)


def test_packing(docs, rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    library = load_tokenizer(path)
    got = packing.pack_documents(docs, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(-1 if i is None else i, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[2048 * k : 2048 * k + 2048]]]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 2
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_more_partitions_than_files(spark):
    many = 6 * spark.sparkContext.defaultParallelism + 150
    docs = spark.range(4 * many, numPartitions=many).selectExpr("id as doc_id", "repeat('stone ', cast(id % 5 as int)) as text")
    got = packing.pack_documents(docs, capacity=64).collect()
    assert len(got) == 4 * many and sum(r["length"] for r in got) > 4 * many
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 600, 3000):
        for ids in (rng.integers(0, 49408, n), rng.integers(0, 2**32, n), np.zeros(n), rng.integers(0, 3, n)):
            ids = ids.astype(np.uint32)
            assert (coder.unpack_ids(coder.pack_ids(ids), n) == ids).all()
    skewed = np.minimum(rng.geometric(0.05, 200_000), 40_000).astype(np.uint32)
    assert len(coder.pack_ids(skewed)) * 8 < 8 * len(skewed)
    block = coder.write_block([None, 5], [2, 3], np.arange(5, dtype=np.uint32), 7)
    assert coder.read_block(block)[0] == [None, 5]
    for at in (0, 20, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.read_block(bytes(broken))


def test_token_files(docs, rows, empty):
    library = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    got = token_files.through_files(docs).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert known == sorted(known) and token_files.through_files(empty).count() == 0


def test_lattice_is_lossless_and_keyed(docs, rows, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    vocab = lattice.vocabulary(path)
    texts = strings(500) + ["▁", " ▁ ", "🙂▁漢"]
    keys = np.arange(len(texts)).astype(np.uint64)
    found = lattice.sample(texts, keys, vocab, 1)
    assert [vocab.decode(f.tolist()).decode() for f in found] == texts
    again = lattice.sample(texts[7:9], keys[7:9], vocab, 1)
    assert all((a == b).all() for a, b in zip(found[7:9], again))
    got = lattice.encode(docs, path)
    assert all(r["lossless"] for r in got.collect())
    back = lattice.decode(got, path).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows)
    assert lattice.encode(empty, path).count() == 0


def test_lattice_draws_by_weight():
    path = tokenizer_path("piece_bpe_32k.model")
    vocab, n = lattice.vocabulary(path), 20_000
    weight = {vocab.raw[i]: np.exp(w) for i, w in zip(vocab.piece.tolist(), vocab.weight.tolist()) if i >= 0}

    def cuts(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in weight for rest in cuts(s[k:])]

    ways = [(tuple(c), np.prod([weight[p] for p in c])) for c in cuts(b" thing")]
    total = sum(w for _, w in ways)
    drawn = Counter(tuple(vocab.raw[i] for i in f) for f in lattice.sample(["thing"] * n, np.arange(n).astype(np.uint64), vocab, 5))
    for way, w in ways:
        assert abs(drawn[way] - n * w / total) < 5 * (n * w / total) ** 0.5 + 5


def test_lattice_lies_by_layers():
    vocab = lattice.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    words = ["▁the", "▁", "▁stone", "▁漢a", "▁thing"]
    length = np.array([len(w) for w in words])
    code = np.array([ord(c) for w in words for c in w], np.uint64)
    own = lattice.Lattice(vocab, code, np.cumsum(length) - length, length)
    assert own.layer[:3].tolist() == [0, 5, 10] and len(own.first) == int((length + 1).sum()) + 1
    entered = np.diff(own.first)
    assert (entered[:5] == 0).all() and (entered[5:] > 0).all() and (np.diff(own.bar) >= 0).all()
    for w, word in enumerate(words):
        for p in range(1, len(word) + 1):
            node = own.layer[p] + own.rank[w]
            starts = own.layer[:p] + own.rank[w]
            assert set(own.source[own.first[node] : own.first[node + 1]].tolist()) <= set(starts.tolist())
            assert own.bar[own.first[node + 1] - 1] == node + 1
    texts = strings(60, 6)
    keys = np.arange(len(texts)).astype(np.uint64)
    together = lattice.sample(texts, keys, vocab, 3)
    assert all((lattice.sample([t], keys[i : i + 1], vocab, 3)[0] == together[i]).all() for i, t in enumerate(texts))
