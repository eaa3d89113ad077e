import hashlib
import re

import numpy as np
import pytest

from docsift.llm import components, minhash, pii, substrings, topk, urls
from pyspark.sql import functions as F


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def alike(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b], percent)])
    got = minhash.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])


def test_deduplicated(docs, rows, empty):
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and len(set(ids) - {None}) == len(ids) - 2
    assert minhash.deduplicated(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 150), (200, 150), (None, 3)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = {n for p in pairs if None not in p and p[0] != p[1] for n in p}
    want = roots(nodes, [p for p in pairs if None not in p])
    assert {r["node"]: r["component"] for r in components.components(frame).collect()} == want
    assert components.components(frame.where("a < 0")).count() == 0


def test_pivots_find_every_link_of_a_dense_group(spark):
    """Copies with ever more edits, many of them just short of a link with the original."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        own = list(base)
        for at in rng.choice(120, i % 9, replace=False):
            own[at] = f"e{rng.integers(12)}"
        texts.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in texts}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b], 85)])
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def removed(rows, window):
    owner, out = {}, {}
    texts = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    split = [(i, t.encode().split()) for i, t in texts]
    for i, found in split:
        for s in range(len(found) - window + 1):
            owner.setdefault(tuple(found[s : s + window]), i)
    for i, found in split:
        gone = [False] * len(found)
        for s in range(len(found) - window + 1):
            if owner[tuple(found[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = found, gone
    return out


@pytest.mark.parametrize("window, hot", [(50, 500), (50, 1), (12, 3), (5, 500)])
def test_substrings(docs, rows, window, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    want = removed(rows, window)
    got = substrings.dedup_report(docs, window).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        found, gone = want.get(r["doc_id"], ([], []))
        kept = b" ".join(w for w, g in zip(found, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(found), sum(gone), hashlib.sha256(kept).hexdigest())


def test_shards_of_pairs_grow_with_their_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 60)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    rng = np.random.default_rng(12)
    line = " ".join(f"line{i}" for i in range(12))
    other = lambda: " ".join(f"w{x}" for x in rng.integers(0, 30, 18))
    ends = [other() for _ in range(40)]
    rows = [(i, f"{ends[rng.integers(40)]} {line} {ends[rng.integers(40)]}") for i in range(400)]
    seen, in_shards = [], substrings._in_shards

    def watched(references, window):
        total = references.selectExpr("sum(length(words)) / 8 as words", "max(shard) as last", "count(distinct shard, anchor) as n", "count(distinct anchor) as anchors")
        seen.append(total.first())
        return in_shards(references, window)

    monkeypatch.setattr(substrings, "_in_shards", watched)
    want = removed(rows, 20)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_report(frame, 20).collect()} == {i: sum(g) for i, (_, g) in want.items()}
    pairs = seen[-1]
    assert len(seen) == 2 and pairs["words"] > 50 * 100 and pairs["anchors"] > 20 and pairs["n"] == pairs["anchors"]
    assert pairs["last"] >= substrings.LEAST_SHARDS


def test_cut_texts_keep_other_columns(docs, rows, empty):
    cut = substrings.without_repeats(docs)
    assert cut.schema == docs.schema
    want = removed(rows, 50)
    for r in cut.collect():
        if r["doc_id"] in want:
            found, gone = want[r["doc_id"]]
            assert r["text"].encode().split() == [w for w, g in zip(found, gone) if not g]
    assert substrings.without_repeats(empty).count() == 0 and substrings.dedup_report(empty).count() == 0


def test_automaton_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(20):
        known = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(3)]
        automaton = substrings.Automaton()
        for k in known:
            automaton.add(k)
        text = rng.integers(0, 4, 40).tolist()
        parts = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
        want = [max([n for n in range(i + 2) if not n or tuple(text[i + 1 - n : i + 1]) in parts]) for i in range(len(text))]
        assert automaton.matching(text) == want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0}
            good |= {"card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}
            if good[kind]:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(6)
    parts = ["a", "b.", "@", "1", "23", ".", " ", "-", "+", "(", ")", "_", "é", "🙂", "4111111111111111", "10.0.0.1", "%", "x@y.z", "0", "4111-1111-1111-1111"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)]
    texts += ["a@b" + ".c" * 20000, "1 " * 20000, "1" * 50000, "a" * 50000, "1.2.3.4" * 500, "+" + "1-" * 20000, "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in pii.pii_report(frame, pii.Model()).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i]["spans"] == ",".join(want) and got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]


def test_texts_of_separated_digits_are_tried(spark):
    one = "4111111111111111"
    texts = ["-".join(one), "see " + " ".join(one) + " there", "10 . 0 . 0 . 1", "fe80:::1:2", "a:::", "5 0 9 5 5 5 6 9 7 3", "--".join(one), ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_report(frame, pii.Model()).collect()}
    assert [got[i]["spans"] for i in range(len(texts))] == [",".join(base_spans(t)) for t in texts]
    assert got[0]["n_card"] == got[1]["n_card"] == 1
    assert [r["text"] for r in pii.redacted(frame, pii.Model()).orderBy("doc_id").collect()][:2] == ["<CARD>", "see <CARD> there"]
    proposed = pii.with_proposals(pii.with_base(frame)).select("doc_id", F.expr("transform(_proposed, s -> s.kind)").alias("kinds"))
    kinds = {r["doc_id"]: set(r["kinds"]) for r in proposed.collect()}
    assert 1 in kinds[2] and 1 in kinds[3] and 1 in kinds[4] and 3 in kinds[5] and 2 in kinds[6] and not kinds[7]


def test_trees_add_respelt_data_and_keep_base(spark):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(900):
        number = "".join(map(str, rng.integers(0, 10, 15)))
        card = next(number + str(c) for c in range(10) if luhn(number + str(c)))
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        phone = f"+1 ({rng.integers(100, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        ip = ".".join(map(str, rng.integers(1, 255, 4)))
        texts.append(f"some words {i} then jo{i}.doe@mail{i % 7}.example.com and {phone}, from {ip} with {card} but order no {wrong} of v1.{i}.300.999")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = pii.fit(frame)
    assert model.trees
    new = [(0, "mail me: ann.lee (at) example (dot) org today"), (1, "just some plain words"), (2, "call jo@x.org"), (3, None)]
    new = spark.createDataFrame(new, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(new, model).collect()}
    assert got[0].startswith("email:9:") and got[1] == "" and got[2] == "email:5:13" and got[3] == ""
    assert [r["text"] for r in pii.redacted(new, model).orderBy("doc_id").collect()][1:] == ["just some plain words", "call <EMAIL>", None]
    held_out = pii.training_rows(frame).where("held_out and label = 1")
    judged = held_out.select("kind", model.accepts(F.col("kind"), model.probability(F.col("values"))).alias("ok"))
    assert judged.agg(F.avg(F.col("ok").cast("double")).alias("a")).first()["a"] > 0.9


def test_pii_edge_cases(docs, rows, empty):
    got = pii.pii_report(docs).collect()
    assert sorted(r["base_sha256"] for r in got) == sorted(hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for _, t in rows)
    assert pii.redacted(docs, pii.Model()).columns == docs.columns
    assert pii.pii_report(empty).count() == 0 and pii.redacted(empty).count() == 0


def test_url_rules_and_reputation(spark):
    pages = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "https://b.example.net/de"), (3, "http://x.example.com/de/1"), (4, "http://good.example.com"), (5, None), (6, "no scheme"), (7, "http://bad.example.com/#a"), (8, "http://new.other.co.uk/p?x://y"), (8, "http://new.other.co.uk/p?x://y"), (9, "://")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, host int")
    seen = [("http://bad.example.com/", 1)] * 30 + [("http://good.example.com/", 0)] * 60 + [("http://once.example.com/", 1)] + [(None, 1), ("x", None)]
    labelled = spark.createDataFrame(seen, "url string, bad int")
    rules = (urls.UrlRule("net", "/", "block"), urls.UrlRule("example.net", "/en/", "allow"), urls.UrlRule("example.com", "/de/", "block"))
    got = {r["page_id"]: r for r in urls.judge(frame, labelled, rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block") and got[3]["rule"] == "example.com/de/"
    assert (got[4]["verdict"], got[4]["path"], got[7]["verdict"]) == ("allow", "", "block")
    assert (got[5]["host"], got[5]["path"]) == ("", "") == (got[6]["host"], got[6]["path"]) == (got[9]["host"], got[9]["path"])
    assert got[8]["host"] == "new.other.co.uk" and urls.judge(frame, labelled, rules).count() == len(pages)
    once = urls.judge(spark.createDataFrame([(1, "http://once.example.com/a")], "page_id long, url string"), labelled)
    assert once.first()["verdict"] == "allow"  # one page is not enough
    assert urls.judge(frame.limit(0), labelled.limit(0), rules).count() == 0
    assert urls.judge(frame, labelled.limit(0), rules).count() == len(pages)


def test_rarest_shingles_of_linked_sets_meet(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = []
    for i in range(120):
        own = set(base[rng.random(60) > 0.06 * (i % 4)].tolist()) | set(rng.integers(-(2**62), 2**62, int(rng.integers(0, 9))).tolist())
        sets.append((i, sorted(own)))
    frame = spark.createDataFrame(sets, "node long, set array<long>")
    for percent in (80, 85):
        common, _ = minhash.linkable(frame, percent)
        own = {r["node"]: (set(r["probe"]), set(r["index"])) for r in minhash.rarest(frame, common, frame.select("node"), percent).collect()}
        linked = met = 0
        for a, x in sets:
            for b, y in sets:
                if (len(x), a) <= (len(y), b):
                    continue
                meet = bool(own[a][0] & own[b][1])
                met += meet
                if alike(set(x), set(y), percent):
                    linked += 1
                    assert meet
        assert 100 < linked <= met < 120 * 119 // 2


def test_a_pair_is_formed_in_one_bucket(spark):
    """Ten nodes share four buckets: each pair that may be linked is formed once, in the first of them, not in each."""
    members = [(key, node) for key in (1, 2, 3, 4) for node in range(10) if (key, node) != (1, 0)]
    keys = {node: sorted(k for k, m in members if m == node) for node in range(10)}
    rows = [(k, n, n, 10, 10, [7, n], [7, n], keys[n], len([1 for q, _ in members if q == k])) for k, n in members]
    open_ = spark.createDataFrame(rows, "key long, node long, component long, size int, shared int, probe array<int>, index array<int>, keys array<long>, n int")
    pivots = open_.select(
        "key", F.col("node").alias("pivot"), F.col("component").alias("own"), F.col("size").alias("its_size"), F.col("shared").alias("its_shared"),
        F.col("probe").alias("its_probe"), F.col("index").alias("its_index"), F.col("keys").alias("its_keys"),
    )
    got = [(r.a, r.b) for r in minhash.drawn_pairs(open_, pivots, F.lit(True), F.lit(True)).collect()]
    assert sorted(got) == [(a, b) for a in range(10) for b in range(a + 1, 10)]
    few = pivots.where("pivot = 3")  # a draw of one node: its pairs, once each
    got = [(r.a, r.b) for r in minhash.drawn_pairs(open_, few, F.lit(True), F.col("node") == 3).collect()]
    assert sorted(got) == sorted((min(3, n), max(3, n)) for n in range(10) if n != 3)


def test_words_of_an_earlier_job_are_given_up(spark):
    from docsift.llm import tokens

    path = tokens.tokenizer_path("word_bpe_49k.json")
    tokens.word_encoder(path).encode("some words")
    tokens.release()
    assert tokens.word_encoder.cache_info().currsize == 0 and tokens.load_tokenizer.cache_info().currsize == 0


_TASK = """
import numpy as np
import pyarrow as pa
from docsift.llm import quality

class Frame:
    schema = None
    mapInArrow = staticmethod(lambda run, schema: run)

def held():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) >> 10

def hungry(facts):
    arrays = [np.ones(1024) for _ in range(10_000)]
    kept.append(bytearray(9000))  # lies behind them
    return np.zeros(len(facts.texts), bool)

run = quality.keep_good(Frame, (quality.Rule("hungry", hungry),))
batch = pa.RecordBatch.from_pydict({"text": ["some words"] * 5})
before, kept = held(), []
assert sum(b.num_rows for b in run(iter([batch]))) == 5
print(held() - before)
"""


def test_tasks_give_back_the_memory_that_they_have_freed():
    """80 MB that a task has freed are not kept by a worker that waits for the next one."""
    import ctypes
    import subprocess
    import sys

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("only glibc can be asked for it")
    done = subprocess.run([sys.executable, "-c", _TASK], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 16, done.stdout
