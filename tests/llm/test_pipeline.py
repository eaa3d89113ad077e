import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import coder, minhash, pii, substrings
from docsift.llm.common import free, stored
from docsift.llm.tokens import load_tokenizer, tokenizer_path

from test_documents import alike, base_spans, removed, roots, shingles
from test_quality import WORD, expected

#: Names that the operators use for themselves, and those of the fixture.
NAMES = "_of long, _spans string, _base string, _email string, row string, spans long, node long, length long"


def good(text):
    """The rules of the first stage, one text at a time."""
    n, chars, symbols, repeated, _, failed = expected(text)
    if failed:
        return False
    found = WORD.findall(text)
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    letters, upper = sum(map(letter, text)), len(re.findall("[A-Z]", text))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    lettered = sum(any(map(letter, w)) for w in found)
    return not (10 * symbols > n or not 2 * n <= chars <= 15 * n or 2 * upper > letters or 10 * lettered < 7 * n or 2 * repeated > len(lines))


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "green", "walks", "over", "quiet", "hills"]) + rng.choice("abcdefghij") * rng.randrange(4) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    passage, template = prose(rng, 70), prose(rng, 160).split()
    texts = [prose(rng, rng.randrange(30, 220)) for _ in range(40)]
    texts += [prose(rng, 60) + "\n" + passage + "  " + prose(rng, 30) for _ in range(6)]
    for i in range(12):
        copy = list(template)
        for _ in range(i):
            copy[rng.randrange(160)] = "edited" + str(rng.randrange(9))
        texts.append(" ".join(copy))
    texts += ["word " * 90, "### " * 90 + prose(rng, 60), "ABC " + prose(rng, 55).upper(), "12 34 " * 40 + prose(rng, 20), "same line here\n" * 60, "", None, None]
    texts += [prose(rng, 70) + " mail jo.doe@mail.example.com or +1 (509) 555-6973, host 10.0.0.1 " + prose(rng, 10), prose(rng, 3000)]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, out[3], (None, prose(rng, 90))]


@pytest.fixture(scope="module")
def frame(spark, corpus):
    many = 6 * spark.sparkContext.defaultParallelism + 20
    full = [(i, t, "en", None, None, 5, "s", "b", "e", "r", 7, -1, 1) for i, t in corpus]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + NAMES
    return spark.createDataFrame(full, schema).repartition(many)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()), key=repr)


def test_every_stage_equals_brute_force(spark, corpus, frame):
    """Each stage on what the one before has written."""
    stages, out = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    got = frame
    for name, stage in list(stages.items())[:-1]:
        got = stored(stage(spark, got, ""), name, coalesce=False)
        assert got.columns == frame.columns
        assert all((r["_of"], r["_spans"], r["_base"], r["_email"], r["row"], r["spans"]) == (5, "s", "b", "e", "r", 7) for r in got.collect())
        out[name] = pairs(got)
    assert out["quality_rules"] == sorted(((i, t) for i, t in corpus if good(t)), key=repr)
    assert 50 < len(out["quality_rules"]) < len(corpus) - 6

    sets = {i: shingles(t) for i, t in out["quality_rules"] if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b], 80)]
    root = roots(sorted(sets), linked)
    want = {(i, t) for i, t in out["quality_rules"] if i is None or root[i] == i}
    assert out["minhash_near_dedup"] == sorted(want, key=repr) and len(want) < len(out["quality_rules"])

    before = out["minhash_near_dedup"]
    gone = removed([(i, t) for i, t in before if i is not None], 50)
    after = dict(out["substring_dedup"])
    for i, t in before:
        found, flags = gone.get(i, (t.encode().split(), [False] * len(t.split())))
        assert after[i].encode().split() == [w for w, g in zip(found, flags) if not g]
        assert any(flags) or after[i] == t
    assert sum(map(sum, (flags for _, flags in gone.values()))) >= 70

    redacted = dict(out["pii"])
    for i, t in out["substring_dedup"]:
        if not base_spans(t):
            continue
        assert "jo.doe" not in redacted[i] and "555-6973" not in redacted[i] and "10.0.0.1" not in redacted[i]
        assert "<EMAIL>" in redacted[i] and "<PHONE>" in redacted[i] and "<IP>" in redacted[i]
    assert sum(t != redacted[i] for i, t in out["substring_dedup"]) == sum(bool(base_spans(t)) for _, t in out["substring_dedup"])

    packed = stages["best_fit_packing"](spark, got, "").collect()
    library = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, t in out["pii"]:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == want


def test_run(spark, corpus, frame, tmp_path):
    """run() reads its table, and gives what the stages give one after the other."""
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name, coalesce=False)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, docs.collect())) and len(got) > 40


def test_empty_table(spark, empty):
    got = empty
    for _, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, got, ""), "stage")
    assert got.count() == 0


def test_joins_take_the_place_of_broadcasts(spark, corpus, frame, monkeypatch):
    near = sorted(map(tuple, minhash.near_duplicates(frame, 80).collect()), key=repr)
    cut = sorted(map(tuple, substrings.dedup_report(frame).collect()), key=repr)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1)
    monkeypatch.setattr(substrings, "BROADCAST_ENTRIES", 1)
    assert sorted(map(tuple, minhash.near_duplicates(frame, 80).collect()), key=repr) == near
    assert sorted(map(tuple, substrings.dedup_report(frame).collect()), key=repr) == cut


def test_only_what_is_compared_is_shuffled(spark, monkeypatch):
    """Texts, signatures and sets of documents without a partner, and contexts of anchors in one document, stay where they are."""
    rng = np.random.default_rng(31)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    template, passage = text(150), text(70)
    rows = [(i, text(120)) for i in range(60)] + [(i, f"{template} {text(3)}") for i in range(60, 66)]
    rows += [(i, f"{text(60)} {passage} {text(60)}") for i in range(66, 70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tables = {}

    def watched(module):
        def put(df, name, coalesce=True, plain=module.stored):
            tables.setdefault(name, []).append(out := plain(df, name, coalesce))
            return out

        monkeypatch.setattr(module, "stored", put)

    watched(minhash)
    watched(substrings)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.deduplicated(frame)
        assert sorted(r["doc_id"] for r in out.collect()) == [*range(61), *range(66, 70)]
        assert "Exchange hashpartitioning(doc_id" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["node"] for r in tables["marks"][0].collect()} == set(range(60, 66)) and tables["nodes"][0].count() == 70
        tables.clear()
        spans = {r["doc_id"] for r in substrings.repeated_spans(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spans == {*range(61, 66), *range(67, 70)}
    assert tables["contexts"][0].where("first_id < 60").isEmpty() and not tables["occurrences"][0].where("doc_id < 60").isEmpty()


def test_free_names():
    assert free("_of", ["a"]) == "_of" and free("_of", ["_OF", "__of"]) == "___of"


def test_full_block_of_skewed_ids():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, coder.BLOCK_IDS), 49_407).astype(np.uint32)
    payload = coder.write_block([1, 2], [len(ids) - 5, 5], ids, 17)
    names, counts, back, before = coder.read_block(payload)
    assert list(names) == [1, 2] and list(counts) == [len(ids) - 5, 5] and (back == ids).all() and before == 17
