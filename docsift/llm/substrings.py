"""Repeated passages: suffix automata of reference shards and matching statistics.

A word is removed if a window of ``WINDOW`` words that covers it also starts in a
document with a smaller id.

Two equal windows have the same anchor: the smallest hash among their runs of ``RUN``
words. A document is therefore a row of contexts, each being the words of the windows
that share an anchor occurrence, and equal windows always lie in contexts with equal
anchors. So the windows of a context need only be sought among the contexts of the
same anchor:

1. An anchor that occurs in one document only is done with, before anything else of its
   contexts is moved. Equal contexts are one reference, with the smallest id they occur in.
   A reference's own later copies are done with too: all their windows are in the first.
2. References are dealt to shards by anchor. A shard builds the suffix automaton of
   its references in the order of their ids; before a document's references are
   added, they are streamed through it, and where the matching statistic reaches
   ``WINDOW`` the window is in a smaller document. Shards hold about ``SHARD_WORDS`` words.
3. An anchor with more than ``HOT`` references (a line that very many documents
   share, in ever different surroundings) is not put into one shard. Its references are
   cut again, by the second smallest run of each window, and step 1 and 2 are done for
   the pairs of runs. What is hot even then is dealt out window by window, by a hash,
   with a merging aggregate for the smallest id.
4. Spans return to the documents, which are cut where they lie.

Sending every automaton to every task instead would stream all documents through all
shards, which grows with the square of the corpus. The words in steps 1 to 3 are
64-bit hashes, and so are runs of them.

Null and empty texts and those of fewer words lose nothing. Repeated rows are one
document. Rows with a null id are neither cut nor compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Phrases, Words, arrow_map, batch_map, free, mix, signed, slices, small, stored, with_bytes
from .tokens import release

WINDOW = 50
RUN = 8
SHARD_WORDS = 150_000
LEAST_SHARDS = 64
HOT = 500
#: Tables of contexts or spans by document go to all executors up to this many entries (about 50 MB); else they are joined.
BROADCAST_ENTRIES = 2_000_000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of every run of ``width``."""
    at = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def contexts(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, content) of every context; positions count from the document's first word."""
    code, first = words.code, words.first
    run = min(RUN, window)
    if len(code) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    phrases = Phrases(code)
    starts = np.arange(len(code) - run + 1)
    grams = phrases.of(starts, starts + run)
    anchor = sliding_argmin(grams, window - run + 1)
    owner = words.owner
    begin = np.arange(len(anchor))
    inside = owner[begin] == owner[begin + window - 1]
    begin, anchor = begin[inside], anchor[inside]
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    opens = np.ones(len(begin), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (owner[begin[1:]] != owner[begin[:-1]])
    at = np.flatnonzero(opens)
    count = np.diff(np.append(at, len(begin)))
    start, doc = begin[at], owner[begin[at]]
    content = phrases.of(start, start + count + window - 1)
    return doc, start - first[doc], count, signed(grams[anchor[at]]), signed(content)


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        release()
        for part in slices(batch, limit=WORD_BYTES):
            doc, start, count, anchor, content = contexts(Words(part.column("text")), window)
            ids = part.column("doc_id").take(pa.array(doc))
            yield {"doc_id": ids, "start": start, "windows": count, "anchor": anchor, "content": content}

    named = with_bytes(docs, "doc_id").where("doc_id is not null")
    return arrow_map(named, work, "doc_id long, start int, windows int, anchor long, content long")


class Automaton:
    """Suffix automaton of several sequences of words."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the suffixes that end a step after ``state``."""
        copy = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[int]) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            target = moves[last].get(word)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, word, target)
                continue
            new = self._state({}, 0, length[last] + 1)
            state = last
            while state >= 0 and word not in moves[state]:
                moves[state][word] = new
                state = link[state]
            if state >= 0:
                target = moves[state][word]
                link[new] = target if length[target] == length[state] + 1 else self._split(state, word, target)
            last = new

    def matching(self, words: list[int]) -> list[int]:
        """For each position, the length of the longest run that ends there and is in the automaton."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            target = moves[state].get(word)
            if target is not None:
                state, matched = target, matched + 1
            out.append(matched)
        return out


def spans_of(ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by windows that end at these positions."""
    if not len(ends):
        return []
    breaks = np.flatnonzero(np.diff(ends) > window) + 1
    return [(int(part[0]) - window + 1, int(part[-1]) + 1) for part in np.split(ends, breaks)]


def _in_shards(references: DataFrame, window: int) -> DataFrame:
    """``anchor, content, spans`` of references with windows in a smaller document of their shard."""
    schema = "anchor long, content long, spans array<struct<begin:int,stop:int>>"
    span = pa.struct([("begin", pa.int32()), ("stop", pa.int32())])
    target = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(span))])

    def work(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard.column("first_id").to_numpy(), kind="stable")
        shard = shard.take(pa.array(order)).combine_chunks()
        ids = shard.column("first_id").to_pylist()
        anchors, contents = shard.column("anchor").to_pylist(), shard.column("content").to_pylist()
        sequences = [np.frombuffer(x, np.int64).tolist() for x in shard.column("words").to_pylist()]
        automaton, found, at = Automaton(), [], 0
        while at < len(ids):
            stop = at
            while stop < len(ids) and ids[stop] == ids[at]:
                stop += 1
            new = []
            for i in range(at, stop):
                statistic = np.array(automaton.matching(sequences[i]))
                ends = np.flatnonzero(statistic >= window)
                if len(ends):
                    spans = [{"begin": a, "stop": b} for a, b in spans_of(ends, window)]
                    found.append({"anchor": anchors[i], "content": contents[i], "spans": spans})
                if len(ends) < len(sequences[i]) - window + 1:
                    new.append(sequences[i])
            for sequence in new:
                automaton.add(sequence)
            at = stop
        return pa.Table.from_pylist(found, schema=target)

    return references.groupBy("shard").applyInArrow(work, schema)


def _with_words(docs: DataFrame, references: DataFrame, window: int, shards: int) -> DataFrame:
    """References with their words, fetched from the document that has them first."""
    columns = ("start", "windows", "anchor", "content")
    wanted = references.groupBy("first_id").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    if references.count() <= BROADCAST_ENTRIES:
        wanted = F.broadcast(wanted)
    joined = with_bytes(docs, "doc_id").join(wanted, F.col("doc_id") == F.col("first_id")).select("doc_id", "text", "wanted")

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for part in slices(batch, limit=WORD_BYTES):
            words = Words(part.column("text"))
            code, first = signed(words.code), words.first.tolist()
            phrases = Phrases(words.code)
            out = {k: [] for k in ("shard", "first_id", "anchor", "content", "words")}
            for i, (doc_id, own) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("wanted").to_pylist())):
                for x in own:
                    a = first[i] + x["start"]
                    b = a + x["windows"] + window - 1
                    if b > first[i + 1] or signed(phrases.of(np.array([a]), np.array([b])))[0] != x["content"]:
                        continue  # another text under the same id
                    out["shard"].append(x["anchor"] % shards)
                    out["first_id"].append(doc_id)
                    out["anchor"].append(x["anchor"])
                    out["content"].append(x["content"])
                    out["words"].append(code[a:b].tobytes())
            yield out

    return arrow_map(joined, work, "shard long, first_id long, anchor long, content long, words binary")


def _spans_of(references: DataFrame, window: int, cut_again: bool = True) -> DataFrame:
    """``anchor, content, spans`` of references (``shard, first_id, anchor, content, words``) with windows in a smaller document."""
    counts = references.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = F.broadcast(stored(counts.where(F.col("n") > HOT).select("anchor"), "hot"))  # fewer than a HOTth of the references
    spans = _in_shards(references.join(hot, "anchor", "left_anti"), window)
    if hot.isEmpty():
        return spans
    rest = references.join(hot, "anchor", "left_semi")
    return spans.union(_by_pairs(rest, window) if cut_again else _singly(rest, window))


def _shards(references: DataFrame, window: int) -> int:
    """The number of shards for the references (``windows, n``) whose anchor has others: ``SHARD_WORDS`` words each."""
    size = references.where("n > 1").agg(F.sum(F.col("windows") + (window - 1)).alias("words")).first()["words"] or 0
    return max(LEAST_SHARDS, -(-size // SHARD_WORDS))


def _by_pairs(references: DataFrame, window: int) -> DataFrame:
    """The same as ``_in_shards`` for references of hot anchors, which are cut by the second smallest run of their windows."""
    run = min(RUN, window)

    def cut(batch: pa.RecordBatch) -> Iterable[dict]:
        out = {k: [] for k in ("first_id", "anchor", "content", "start", "windows", "key", "part", "words")}
        ids, anchors, contents, raws = (batch.column(c).to_pylist() for c in ("first_id", "anchor", "content", "words"))
        for first_id, anchor, content, raw in zip(ids, anchors, contents, raws):
            code = np.frombuffer(raw, np.uint64)
            phrases, starts = Phrases(code), np.arange(len(code) - run + 1)
            grams = phrases.of(starts, starts + run)
            smallest = int(grams[: window - run + 1].argmin())  # in the first window, and so in all
            others = grams.copy()
            others[smallest] = np.uint64(2**64 - 1)
            second = sliding_argmin(others, window - run + 1)
            at = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]]))
            count = np.diff(np.append(at, len(second)))
            apart = (second[at] - smallest + (1 << 20)).astype(np.uint64)
            key = mix(mix(grams[second[at]] + apart * np.uint64(0x9E3779B97F4A7C15)) ^ grams[smallest])
            part = phrases.of(at, at + count + window - 1)
            out["first_id"] += [first_id] * len(at)
            out["anchor"] += [anchor] * len(at)
            out["content"] += [content] * len(at)
            out["start"] += at.tolist()
            out["windows"] += count.tolist()
            out["key"] += signed(key).tolist()
            out["part"] += signed(part).tolist()
            out["words"] += [code[a : a + n + window - 1].tobytes() for a, n in zip(at.tolist(), count.tolist())]
        yield out

    schema = "first_id long, anchor long, content long, start int, windows int, key long, part long, words binary"
    parts = stored(arrow_map(references.select("first_id", "anchor", "content", "words"), cut, schema), "parts")
    by = parts.groupBy("key", "part").agg(F.min("first_id").alias("earliest"), F.max("first_id").alias("latest"), F.first("windows").alias("windows"))
    by = stored(by, "pairs")
    keys = by.groupBy("key").agg(F.min("earliest").alias("lo"), F.max("latest").alias("hi"), F.count("*").alias("n"))
    shared = stored(by.join(stored(keys.where("lo < hi").select("key", "n"), "keys"), "key"), "shared")
    shards = _shards(shared, window)
    shared = shared.drop("windows")
    firsts = parts.join(shared.where("n > 1").select("key", "part", "earliest"), ["key", "part"]).where("first_id = earliest")
    firsts = firsts.dropDuplicates(["key", "part"]).select(
        F.pmod("key", F.lit(shards)).alias("shard"), "first_id", F.col("key").alias("anchor"), F.col("part").alias("content"), "words"
    )
    spans = stored(_spans_of(stored(firsts, "references"), window, cut_again=False), "spans").toDF("key", "part", "spans")
    known = stored(shared.join(spans, ["key", "part"], "left").where("latest > earliest or spans is not null"), "known")
    joined = parts.drop("words").join(known, ["key", "part"]).where("first_id > earliest or spans is not null")
    return joined.select("anchor", "content", _moved("first_id", "earliest", window).alias("own")).groupBy("anchor", "content").agg(
        F.flatten(F.collect_list("own")).alias("spans")
    )


def _moved(doc: str, first: str, window: int):
    """Spans of an occurrence: all of it after the first document, else what its reference found; from the document's start."""
    whole = F.array(F.struct(F.lit(0).alias("begin"), (F.col("windows") + (window - 1)).alias("stop")))
    own = F.when(F.col(doc) > F.col(first), whole).otherwise(F.col("spans"))
    return F.transform(own, lambda s: F.struct((s["begin"] + F.col("start")).alias("begin"), (s["stop"] + F.col("start")).alias("stop")))


def _singly(references: DataFrame, window: int) -> DataFrame:
    """The same as ``_in_shards`` for references of hot anchors, window by window."""

    def cut(batch: pa.RecordBatch) -> Iterable[dict]:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            key, owner, place = [], [], []
            for r, raw in enumerate(part.column("words").to_pylist()):
                code = np.frombuffer(raw, np.uint64)
                at = np.arange(len(code) - window + 1)
                key.append(signed(Phrases(code).of(at, at + window)))
                owner.append(np.full(len(at), r))
                place.append(at)
            if key:
                rows = pa.array(np.concatenate(owner))
                out = {c: part.column(c).take(rows) for c in ("first_id", "anchor", "content")}
                yield out | {"key": np.concatenate(key), "place": np.concatenate(place)}

    windows = arrow_map(references, cut, "first_id long, anchor long, content long, key long, place int")
    windows = stored(windows, "windows")
    earliest = stored(windows.groupBy("key").agg(F.min("first_id").alias("earliest"), F.count("*").alias("n")).where("n > 1"), "earliest")
    found = windows.join(earliest, "key").where("earliest < first_id")
    one = F.struct(F.col("place").alias("begin"), (F.col("place") + window).alias("stop"))
    return found.groupBy("anchor", "content").agg(F.collect_list(one).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, spans``: words to remove, as [begin, stop) in each document that has any. Spans may overlap."""
    found = stored(occurrences(docs, window), "occurrences")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    shared = stored(shared.select("anchor"), "anchors")
    found = stored(found.join(small(shared, BROADCAST_ENTRIES), "anchor", "left_semi"), "repeated")
    by = found.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.min_by("start", "doc_id").alias("start"), F.first("windows").alias("windows"),
    )
    by = stored(by, "contexts")
    counts = stored(by.groupBy("anchor").agg(F.count("*").alias("n")), "counts")
    by = stored(by.join(small(counts, BROADCAST_ENTRIES), "anchor"), "shared")
    shards = _shards(by, window)
    references = stored(_with_words(docs, by.where("n > 1"), window, shards), "references")
    spans = stored(_spans_of(references, window), "spans")
    known = by.select("anchor", "content", "first_id", "last_id").join(spans, ["anchor", "content"], "left")
    known = stored(known.where("last_id > first_id or spans is not null"), "known")
    joined = found.join(known, ["anchor", "content"])
    rows = joined.where("doc_id > first_id or spans is not null").select("doc_id", _moved("doc_id", "first_id", window).alias("own"))
    return stored(_merged(rows.groupBy("doc_id").agg(F.flatten(F.collect_list("own")).alias("spans"))), "ranges")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a document as few, disjoint and in order."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        out = []
        for own in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for s in sorted(own, key=lambda s: s["begin"]):
                if merged and s["begin"] <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                else:
                    merged.append(s)
            out.append(merged)
        yield {"doc_id": batch.column("doc_id"), "spans": out}

    return arrow_map(spans, work, "doc_id long, spans array<struct<begin:int,stop:int>>")


def _marked(docs: DataFrame, spans: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns, ``text``, and last the spans, under a name that is free."""
    entries = spans.agg(F.sum(F.size("spans") + 1).alias("n")).first()["n"] or 0
    right = F.broadcast(spans) if entries <= BROADCAST_ENTRIES else spans
    own, of = docs.select(*columns, text), free("_of", [*columns, text])
    right = right.select(F.col("doc_id").alias(of), F.col("spans").alias(free("_spans", [*columns, text])))
    return own.join(right, own["doc_id"] == right[of], "left").drop(of)


def _gone(words: Words, spans: pa.Array) -> np.ndarray:
    """Flags of the words to remove; spans beyond a text are of another text under the same id."""
    change = np.zeros(len(words.start) + 1, np.int64)
    for i, own in enumerate(spans.to_pylist()):
        low, high = words.first[i], words.first[i + 1]
        for s in own or ():
            a, b = low + s["begin"], low + s["stop"]
            if b <= high:
                change[a] += 1
                change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def dedup_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space)."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for part in slices(batch, limit=WORD_BYTES):
            words = Words(part.column("text"))
            gone = _gone(words, part.column(part.num_columns - 1))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            digests = []
            for text, low, n in zip(part.column("text").to_pylist(), words.first.tolist(), removed.tolist()):
                kept = (text or b"").split()
                if n:
                    kept = [w for w, g in zip(kept, gone[low : low + len(kept)].tolist()) if not g]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield {"doc_id": part.column("doc_id"), "n_words": np.diff(words.first), "n_removed": removed, "kept_sha256": digests}

    marked = _marked(docs, repeated_spans(docs, window), "doc_id")
    marked = marked.withColumn("text", F.col("text").cast("binary"))
    return arrow_map(marked, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; other columns and what stands between kept words are as before."""
    names = docs.columns
    others = [c for c in names if c != "text"]
    marked = _marked(docs, repeated_spans(docs, window), *others)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=WORD_BYTES):
                words = Words(part.column("text"))
                gone = _gone(words, part.column(part.num_columns - 1))
                texts = part.column("text").to_pylist()
                data = words.data.tobytes()
                for i in np.unique(words.owner[gone]).tolist():
                    low, high = words.first[i], words.first[i + 1]
                    start, end, out = words.start[low:high], words.end[low:high], []
                    flags = np.diff(np.concatenate([[0], (~gone[low:high]).astype(int), [0]]))
                    for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist()):
                        out.append(data[start[a] : end[b - 1]])
                    texts[i] = b"\n".join(out).decode()
                columns = {c: part.column(c) for c in others} | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return batch_map(marked, run, docs.schema)
