import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from docsift.llm import alignment, bpe_stream
from docsift.llm.tokens import Kept, byte_letters, load_tokenizer, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
LETTERS = list("aA éÉßµªº²½'sTré\x1c\x85\xa0   Ω漢İſΑΣ  \t\n12 ...ﬁ\xadÅ") + ["<|endoftext|>", "<|end", "'ll ", "don't", "the ", "ing ", "<s>", "</s>", "    ", "----", "\x00", "🙂"]


def strings(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(most))) for _ in range(n)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


LONG = ["x" * 5000, " " * 3000 + "a", "-" * 4000, "ab" * 3000, "漢" * 2000, "\n" * 999, "the" * 4000, "a" + " \n" * 2000 + "b", "ThisIsCamel" * 900, "...." * 1000 + "'re", "1" * 3000 + "é"]


@pytest.mark.parametrize("window, merge_window", [(bpe_stream.WINDOW, bpe_stream.MERGE_WINDOW), (8, 8)])
def test_transducer_equals_library(monkeypatch, window, merge_window):
    monkeypatch.setattr(bpe_stream, "MERGE_WINDOW", merge_window)
    path = tokenizer_path(A)
    own, library = bpe_stream.Encoder(path), load_tokenizer(path)
    own.window = window
    for text in [*strings(2500, 5, 120), *LONG]:
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_parts_of_any_size_give_the_same_ids():
    path = tokenizer_path(A)
    own, rng = bpe_stream.Encoder(path), random.Random(2)
    own.window = 16
    for text in [*strings(300, 8, 200), *LONG]:
        whole, parts, at = own.encode(text), [], 0
        while at < len(text):
            n = rng.choice([1, 2, 7, 100, 1000])
            parts.append(own.feed(text[at : at + n]))
            at += n
            assert len(own.rest) <= 16 + 1000 and (own.open is None or len(own.open.held) <= own.open.window + 4000)
        assert b"".join(parts) + own.finish() == whole


def test_specials_as_text():
    path = tokenizer_path(A)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    own = bpe_stream.Encoder(path, specials=False)
    for text in strings(800, 6):
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_words_of_many_texts_are_encoded_together():
    own = alignment.Aligner(tokenizer_path(A), tokenizer_path(B))
    texts = [None, "", *strings(1500, 7), "a ▁ b", "fine words then \x00 a\u2581b", "end ", " begin", "two  spaces", "line\n\n next", "\n", "x" * 3000 + " y", "plain words only"]
    assert own.tokens_of(texts) == [own.tokens(t) for t in texts]
    assert own.tokens_of([]) == [] and own.tokens_of([None]) == [(b"", b"")]
    calls = []
    own.sides[0].ids = calls.append
    own.tokens_of(["plain words only", "words only, plain"])
    assert not calls


def test_lookahead_of_small_lists():
    assert bpe_stream.lookahead([]) == 0
    assert bpe_stream.lookahead([("a", "b")]) == 1
    # bc takes b from ab, which leaves a for xa
    assert bpe_stream.lookahead([("b", "c"), ("a", "b"), ("x", "a")]) == 3
    with pytest.raises(ValueError):
        bpe_stream.lookahead([("ab", "c")])
    with pytest.raises(ValueError):
        bpe_stream.lookahead([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def merged(text, ranks):
    """Merges in order of rank, each from left to right."""
    out = list(text)
    for a, b in ranks:
        i = 0
        while i < len(out) - 1:
            if (out[i], out[i + 1]) == (a, b):
                out[i : i + 2] = [a + b]
            i += 1
    return out


def test_tokens_before_the_lookahead_never_change():
    rng = random.Random(12)
    for _ in range(60):
        ranks, made = [], list("abc")
        for _ in range(12):
            a, b = rng.choice(made), rng.choice(made)
            if a + b not in made:
                ranks.append((a, b))
                made.append(a + b)
        ahead = bpe_stream.lookahead(ranks)
        for _ in range(60):
            begin = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            ends = lambda tokens: {sum(map(len, tokens[:i])) for i in range(1, len(tokens) + 1)}
            stable = {e for e in ends(merged(begin, ranks)) if e <= len(begin) - ahead}
            for _ in range(4):
                more = begin + "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
                assert stable == {e for e in ends(merged(more, ranks)) if e <= len(begin) - ahead}


def test_decoder_equals_library():
    path = tokenizer_path(A)
    own, library, rng = bpe_stream.Decoder(path), load_tokenizer(path), random.Random(4)
    for _ in range(600):
        ids = [rng.randrange(50300) for _ in range(rng.randrange(30))]
        assert own.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)
        assert "".join(own.feed(packed([i])) for i in ids) + own.finish() == library.decode(ids, skip_special_tokens=False)


def test_round_trip(docs, rows, empty):
    path = tokenizer_path(A)
    library, digest = load_tokenizer(path), lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), digest(packed(ids)), digest(library.decode(ids, skip_special_tokens=False).encode())))
    got = bpe_stream.round_trip(docs, path).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert bpe_stream.round_trip(empty, path).count() == 0
    tokens = bpe_stream.encode(docs, path)
    assert sorted(r["text"] for r in bpe_stream.decode(tokens, path).collect()) == sorted(t or "" for _, t in rows)


def test_kept_is_bounded_and_keeps_frequent_keys():
    made = Counter()
    kept = Kept(lambda k: made.update([k]) or k.encode(), limit=20_000)
    for i in range(5000):
        assert kept[f"rare{i}"] == f"rare{i}".encode() and kept["often"] == b"often"
        assert len(kept) <= 100 and len(kept.older) <= 100
    assert made["often"] == 1
    assert kept["x" * 5000] == b"x" * 5000 and "x" * 5000 not in kept


def brute(texts):
    library = Tokenizer.from_file(tokenizer_path(A))
    library.encode_special_tokens = True
    model = alignment.PieceTokens(tokenizer_path(B)).model
    letter = {c: b for b, c in byte_letters().items()}
    own, held = [], []
    for t in texts:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        raw_a = [bytes(letter[c] for c in library.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            own.append(None)
            held.append(Counter())
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if last < e <= cut], [i for i, e in zip(b, ends_b) if last < e <= cut]))
            last = cut
        own.append((len(a), len(b), groups))
        held.append(Counter((x, y) for ga, gb in groups for x in ga for y in gb))
    n, top = Counter(p for c in held for p in c), {}
    for (x, _), k in n.items():
        top[x] = max(top.get(x, 0), k)
    out = []
    for o, c in zip(own, held):
        written = o and ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in o[2])
        best, total = sum(k for p, k in c.items() if n[p] == top[p[0]]), sum(k * n[p] for p, k in c.items())
        out.append((o[0], o[1], len(o[2]), sum(c.values()), best, total, hashlib.sha256(written.encode()).hexdigest()) if o else (0,) * 6 + ("",))
    return out


def test_groups_and_pairs_of_a_slice(monkeypatch):
    texts = [*strings(300, 5), None, "", " ", "  ", "a▁b", "x" * 700, " " * 50, "\n"]
    own = alignment.aligner(tokenizer_path(A), tokenizer_path(B))
    groups, want = own.align(texts), brute(texts)
    totals = groups.totals()
    got = list(zip(*(totals[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), groups.digests()))
    assert got == [(*w[:4], w[6]) for w in want]
    whole = groups.pairs()
    monkeypatch.setattr(alignment, "EXPAND", 50)
    assert all((x == y).all() for x, y in zip(whole, own.align(texts).pairs()))
    assert whole[2].sum() == sum(w[3] for w in want)


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 500])
def test_align(spark, docs, rows, empty, chunk_bytes):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    extra = [(20_000 + i, t) for i, t in enumerate([*strings(60, 9), "a▁b"])]
    more = docs.select("doc_id", "text", "length", "node").union(spark.createDataFrame([(i, t, 1, 1) for i, t in extra], "doc_id long, text string, length long, node long"))
    more = more.withColumnRenamed("length", "pair").withColumnRenamed("node", "chunk")
    got = alignment.align(more, tokenizer_path(A), tokenizer_path(B), chunk_bytes).collect()
    every = [*rows, *extra]
    want = [(-1 if i is None else i, *w) for (i, _), w in zip(every, brute([t for _, t in every]))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in got) == sorted(want)
    assert alignment.align(empty, tokenizer_path(A), tokenizer_path(B)).count() == 0
