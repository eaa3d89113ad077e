"""Lazy extraction from contents, and exchange through payload files."""

import json
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from docsift.plans.predict import exchange_folder
from docsift.plans.score_rule import LinearRule
from docsift.sources.extract import Chain, extract, extract_new, plain_text, strict_text
from docsift.sources.payloads import PENDING, PayloadReader, PayloadWriter, parse_payload, read_payloads, write_payloads

LONG = "word " * 20


def counting(folder, name, answer):
    """An extractor that leaves a file for each content it is called with."""

    def make():
        def read(content):
            with open(os.path.join(folder, f"{name}-{content.decode()}"), "a") as file:
                file.write("x")
            return answer(content.decode())

        return read

    return name, make


def test_later_extractors_see_failing_rows_only(spark, tmp_path):
    def first(text):
        if text.startswith("bad"):
            raise ValueError("broken")
        return LONG if text.startswith("good") else "too short" if text.startswith("short") else None

    names = ["good1", "good2", "short1", "short2", "none1", "bad1", "bad2"]
    rows = spark.createDataFrame([(i, n.encode(), "x") for i, n in enumerate(names)] + [(9, None, "x")], "doc_id bigint, content binary, kind string")
    folder = str(tmp_path)
    chain = [counting(folder, "first", first), counting(folder, "second", lambda text: text.upper())]
    got = {r.doc_id: r for r in extract(rows.repartition(3), chain).collect()}
    assert [(got[i].extractor, got[i].text) for i in range(7)] == [
        ("first", LONG), ("first", LONG), ("second", "SHORT1"), ("second", "SHORT2"), ("second", "NONE1"), ("first", ""), ("first", ""),
    ]
    assert got[5].error == "ValueError: broken" and got[0].error is None and got[0].kind == "x" and got[9].text == ""
    called = {n: os.path.getsize(tmp_path / n) for n in os.listdir(tmp_path)}
    assert set(called) == {f"first-{n}" for n in [*names, ""]} | {f"second-{n}" for n in ["short1", "short2", "none1", ""]}
    assert set(called.values()) == {1}
    other = {r.doc_id: r for r in extract(rows, chain, on_error="next").collect()}
    assert other[5].text == "BAD1" and other[5].error is None and other[0].text == LONG
    assert extract(rows.limit(0), chain).count() == 0
    with pytest.raises(ValueError):
        extract(rows.withColumn("text", F.lit("")), chain)


def test_factories_run_once_and_only_if_needed():
    made = []

    def factory(name, answer):
        def make():
            made.append(name)
            return lambda content: answer

        return name, make

    chain = Chain([factory("a", LONG), factory("b", "never")], 50, "stop")
    assert [chain(b"1")[0], chain(b"2")[0]] == ["a", "a"] and made == ["a"]

    def broken():
        raise RuntimeError("no model")

    failing = Chain([("a", broken)], 50, "stop")
    assert failing(b"1") == ("a", "", "RuntimeError: no model")


def test_encodings_in_a_chain(spark):
    text = "Größe und Öl, dazu ein langer Satz mit genug Zeichen für alle.\r\nEnde"
    contents = [(0, text.encode("utf-8")), (1, text.encode("utf-16")), (2, text.encode("latin-1")), (3, b"\xff\xfe\x00")]
    rows = spark.createDataFrame(contents, "doc_id bigint, content binary")
    chain = [("utf8", strict_text("utf-8")), ("utf16", strict_text("utf-16")), ("plain", plain_text)]
    got = {r.doc_id: (r.extractor, r.text) for r in extract(rows.filter("doc_id < 2"), chain, on_error="next").collect()}
    assert got == {0: ("utf8", text.replace("\r\n", "\n")), 1: ("utf16", text.replace("\r\n", "\n"))}
    latin = extract(rows, [("plain", plain_text)]).filter("doc_id = 2").first()
    assert latin.text == text.replace("\r\n", "\n")


def test_cached_texts_are_not_extracted(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"one"), (2, b"two"), (3, b"three"), (4, b"")], "doc_id bigint, content binary")
    cache = spark.createDataFrame([(1, "cached"), (1, "cached"), (2, " \n"), (8, "other")], "doc_id bigint, text string")
    every, new = extract_new(rows, cache, [counting(str(tmp_path), "only", str)])
    assert {r.doc_id: r.text for r in every.collect()} == {1: "cached", 2: "two", 3: "three", 4: ""}
    assert {r.doc_id: r.text for r in new.collect()} == {2: "two", 3: "three"}
    assert set(os.listdir(tmp_path)) == {"only-two", "only-three", "only-"}
    assert all(os.path.getsize(tmp_path / n) == 1 for n in os.listdir(tmp_path))


GOOD = [{"id": "b2", "content": "second"}, {"id": "a1", "content": "zwei\nZeilen ü"}, {"id": "b2", "content": ""}]
BAD = {
    "object": "{}", "broken": "[{", "number": '[{"id": 1, "content": "x"}]', "dash": '[{"id": "a-b", "content": "x"}]',
    "missing": '[{"id": "a"}]', "mixed": '[{"id": "a", "content": "x"}, 5]', "deep": "[" * 100_000, "empty": "", "bytes": None,
}


def test_payload_rules():
    assert parse_payload(json.dumps(GOOD)) == GOOD and parse_payload("[]") == []
    for name, text in BAD.items():
        if text is not None:
            with pytest.raises((ValueError, RecursionError)):
                parse_payload(text)


def test_read_payloads(spark, tmp_path):
    for name, text in {"one": json.dumps(GOOD), "none": "[]", "note.txt": "x", **BAD}.items():
        (tmp_path / (name if "." in name else f"{name}.json")).write_bytes(b"\xff\xfe[" if text is None else text.encode())
    for size in (1, 1 << 20):
        rows = read_payloads(spark, str(tmp_path), task_bytes=size)
        got = rows.collect()
        assert {r.name for r in got if r.rejected} == set(BAD)
        assert [(r.pos, r.id, r.content) for r in sorted((r for r in got if not r.rejected), key=lambda r: r.pos)] == [(i, x["id"], x["content"]) for i, x in enumerate(GOOD)]
    assert len(PayloadReader({"path": str(tmp_path), "taskbytes": "1"}).partitions()) == 11
    with pytest.raises(Exception, match="invalid payload"):
        read_payloads(spark, str(tmp_path), mode="strict").collect()
    with pytest.raises(Exception):
        read_payloads(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "void").mkdir()
    assert read_payloads(spark, str(tmp_path / "void")).count() == 0


def test_write_payloads(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(str(i), json.dumps([{"id": f"x{i}", "content": "c" * i}])) for i in range(20)] + [("null", None)]
    write_payloads(spark.createDataFrame(rows, "name string, payload string").repartition(4), out)
    assert sorted(os.listdir(out)) == sorted([f"{n}.json" for n, _ in rows] + [PENDING])
    assert {r.name: r.content for r in read_payloads(spark, out).collect()} == {str(i): "c" * i for i in range(20)}
    write_payloads(spark.createDataFrame([("3", "[]")], "name string, payload string"), out)
    assert read_payloads(spark, out).filter("name = '3'").count() == 0 and read_payloads(spark, out).count() == 19
    write_payloads(spark.createDataFrame([("new", json.dumps(GOOD))], "name string, payload string"), out, overwrite=True)
    assert {r.name for r in read_payloads(spark, out).collect()} == {"new"}
    for bad in ([("a", "[]"), ("a", "[]")], [("x/y", "[]")], [(None, "[]")]):
        with pytest.raises(Exception):
            write_payloads(spark.createDataFrame(bad, "name string, payload string").repartition(2), out)
    assert {r.name for r in read_payloads(spark, out).collect()} == {"new"} and os.listdir(f"{out}/{PENDING}") == []


def test_only_committed_attempts_are_moved(tmp_path):
    writer = PayloadWriter({"path": str(tmp_path)}, False)
    writer.write(iter([{"name": "a", "payload": '["lost attempt"]'}]))
    kept = writer.write(iter([{"name": "a", "payload": '["kept"]'}]))
    writer.commit([kept, None])
    assert (tmp_path / "a.json").read_text() == '["kept"]' and os.listdir(tmp_path / PENDING) == []
    other = PayloadWriter({"path": str(tmp_path)}, True)
    other.write(iter([{"name": "b", "payload": "[]"}]))
    other.abort([])
    assert sorted(os.listdir(tmp_path)) == [PENDING, "a.json"] and os.listdir(tmp_path / PENDING) == []


def test_exchange_folder(spark, tmp_path):
    from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer

    words = RegexTokenizer(inputCol="clean", outputCol="words", pattern=" ")
    counts = CountVectorizerModel.from_vocabulary(["zero", "yes", "no"], inputCol="words", outputCol="features")
    (tmp_path / "in").mkdir()
    items = [{"id": "p", "content": "no no no"}, {"id": "q", "content": " 12 "}, {"id": "r", "content": "yes"}, {"id": "p", "content": "yes yes"}]
    (tmp_path / "in" / "k1.json").write_text(json.dumps(items))
    (tmp_path / "in" / "k2.json").write_text("[1]")
    out = str(tmp_path / "out")
    rejected = exchange_folder(PipelineModel([words, counts, LinearRule()]), spark, str(tmp_path / "in"), out)
    assert [r.name for r in rejected.collect()] == ["k2"]
    answer = json.loads((tmp_path / "out" / "k1.json").read_text())
    assert len(answer) == 3 and answer[1] is None and set(answer[0]) == {"relevant", "score", "uncertain"}
    assert sorted(os.listdir(out)) == [PENDING, "k1.json"]


def test_listing_sees_empty_files_and_bad_folders(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from docsift.sources import listing

    sizes = {"a.txt": 0, "b.txt": 2048, "c.pdf": 5, "x/d.txt": 1, "x/y/e.txt": 0, "x/y/z/f.txt": 10, "w/g.TXT": 1}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    for shared in (1, 2, 3, 500):
        rows = listing.list_entries(spark, str(tmp_path), shared).collect()
        assert sorted((os.path.relpath(r.path, tmp_path), r.length, r.error) for r in rows) == sorted((n, s, None) for n, s in sizes.items())
    files, bad = listing.list_all_files(spark, str(tmp_path))
    got = files.collect()
    assert [r.filename for r in got] == ["a.txt", "b.txt", "d.txt", "e.txt", "f.txt"] and bad.count() == 0
    assert got[0].size_kb == 0 and got[1].size_kb == 2 and got[2].doc_id == "d"
    assert listing.list_all_files(spark, str(tmp_path), "pdf")[0].count() == 1
    with pytest.raises(Exception):
        listing.list_entries(spark, str(tmp_path / "nowhere")).collect()

    def unreadable(store, folder):
        return ([], "PermissionError: no") if folder.endswith("/y") else (store.get_file_info(fs.FileSelector(folder)), None)

    monkeypatch.setattr(listing, "_entries", unreadable)
    reader = listing.ListingReader({"path": str(tmp_path), "sharedfolders": "2"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(os.path.basename(p), e) for p, _, e in rows if e] == [("y", "PermissionError: no")]
    assert len(rows) == len(sizes) - 2 + 1
