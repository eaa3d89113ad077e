"""Alignment of two tokenizers' tokens of the same bytes, by interval coalescing.

Within a slice of documents the tokens of both are intervals of bytes. All are sorted by
where they begin; a running maximum of ends is kept, and a group begins where a token begins
at that maximum or after it. Inside a group every token of one is linked with every token of
the other: these are multiplied, not listed, and only a group's distinct ids are.

An id pair counts for each document that holds it linked. Documents stay where they are for that:
a chunk of about ``CHUNK_BYTES`` of documents has one dictionary of its pairs, with the number of its documents
that hold each, and only dictionaries are shuffled: their counts are added up by pair, the highest of
each first id is found, and counts go back to the dictionaries' entries. So a frequent pair is a
row for each chunk, not for each document, and is added up in part before it is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_stream import Encoder
from .common import SLICE_BYTES, arrow_map, ranges, slices, spaced, stored, with_bytes
from .tokens import Kept, packed

CHUNK_BYTES = 8 << 20
#: Linked id pairs of a slice that are expanded at a time.
EXPAND = 1 << 21
#: Words that a SentencePiece model gets in one piece.
TOGETHER = 64
#: Longer words are encoded with their text.
LONGEST = 1024
#: With a space before it, such a word is not independent of what stands before.
BOUND = re.compile(f"$|[{Encoder.SPACE}]")
_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteTokens:
    """Tokens of a byte-level vocabulary: ids and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, specials=False)
        self.piece = self.encoder.merges.pieces
        self.size = max(self.piece, default=-1) + 1

    def prepare(self, texts: list[str]) -> None:
        pass

    def ids(self, text: str) -> bytes:
        return self.encoder.encode(text)

    def of_words(self, words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, each behind a space, and where those of a word begin, and how many they are. ``length``: bytes of each id."""
        ids = np.frombuffer(self.encoder.merges.window("".join([" " + w for w in words])), "<u4").astype(np.int64)
        return ids, *_bounds(words, length[ids])


class PieceTokens:
    """Tokens of a SentencePiece model without special ids, of a text that begins with the space that the model adds.

    In a vocabulary without a piece that has a space after another character, a run of
    spaces with what follows it up to the next is independent of the rest, and each distinct one is encoded once.
    """

    WORD = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        code = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.piece = dict(enumerate(code))
        self.size = len(names)
        self.space = self.model.piece_to_id("▁")
        plain = [n for i, n in enumerate(names) if not self.model.is_control(i) and not self.model.is_byte(i)]
        self.apart = not any(re.search("[^▁]▁", n) for n in plain)
        self.words = Kept(self._word)

    def ids(self, text: str) -> bytes:
        """Ids of a text that begins with a space; none if their bytes are not those of the text."""
        if self.apart:
            found = list(map(self.words.__getitem__, self._words(text)))
            return b"".join(found) if all(found) else b""
        return self._sound(text, self.model.encode(text[1:], num_threads=1))

    def prepare(self, texts: list[str]) -> None:
        """Encodes what is new in these texts in one call."""
        if self.apart:
            known, older = self.words, self.words.older
            new = [w for w in set("".join(texts).split(" ")) if w and w not in known and w not in older]
            for word, ids in zip(new, self.model.encode(new, num_threads=1)):
                known.keep(word, self._sound(" " + word, ids))

    def of_words(self, words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as with bytes; a word whose bytes are not kept has none."""
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        flat, kept, sound = [], [], np.ones(len(words), bool)
        for i, (part, ids) in enumerate(zip(parts, self.model.encode([" ".join(p) for p in parts], num_threads=1))):
            if b"".join(map(self.piece.__getitem__, ids)) == (" " + " ".join(part)).encode():
                flat += ids
                kept += part
            else:
                sound[i * TOGETHER : (i + 1) * TOGETHER] = False
        ids = np.array(flat, np.int64)
        start, count = np.zeros((2, len(words)), np.int64)
        start[sound], count[sound] = _bounds(kept, length[ids])
        alone = [np.frombuffer(self.words[words[i]], "<u4").astype(np.int64) for i in np.flatnonzero(~sound).tolist()]
        count[~sound] = list(map(len, alone))
        start[~sound] = len(ids) + np.cumsum(count[~sound]) - count[~sound]
        return np.concatenate([ids, *alone]), start, count

    def _words(self, text: str) -> list[str]:
        spaced = text.split(" ")
        return self.WORD.findall(text) if "" in spaced[1:] else spaced[1:]

    def _word(self, word: str) -> bytes:
        """Of a word without the space before it, or a run of spaces with what follows."""
        bare = word[1:] if word[:1] == " " else word
        return self._sound(" " + bare, self.model.encode(bare, num_threads=1) if bare else [self.space])

    def _sound(self, text: str, ids: list[int]) -> bytes:
        return packed(ids) if b"".join(map(self.piece.__getitem__, ids)) == text.encode() else b""


def _bounds(words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's tokens begin, and how many they are, from the bytes of all tokens of words that follow a space each."""
    stop = np.searchsorted(np.cumsum(length), np.cumsum([1 + len(w.encode()) for w in words])) + 1
    count = np.diff(stop, prepend=0)
    return stop - count, count


class Aligner:
    """Groups and links of documents of two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = [(ByteTokens if p.endswith(".json") else PieceTokens)(p) for p in (path_a, path_b)]
        self.length = [np.array([len(s.piece.get(i, b"")) for i in range(s.size)], np.int64) for s in self.sides]
        a, b = (s.size for s in self.sides)
        #: The digits of each id and what stands after it: a comma, or at the end of a group's half the next sign.
        self.signs = [str(i) + "," for i in range(a)] + [str(i) + "|" for i in range(a)] + [str(i) + "," for i in range(b)] + [str(i) + ";" for i in range(b)]

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of space and text by both; none where a text is empty or its bytes are not kept."""
        if not text:
            return b"", b""
        both = [side.ids(" " + text) for side in self.sides]
        return (both[0], both[1]) if all(both) else (b"", b"")

    def align(self, texts: list[str | None]) -> Groups:
        return Groups(self, self.tokens_of(texts))

    def tokens_of(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """``tokens`` of each of some texts. Distinct words are encoded once, where every space of a text begins a word for both sides."""
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(texts)
        own = [i for i, t in enumerate(texts) if t]
        if not all(getattr(side, "apart", True) for side in self.sides):
            for i in own:
                out[i] = self.tokens(texts[i])
            return out
        if not own:
            return out
        words, place, first = spaced(pa.array([texts[i] for i in own], pa.string()))
        words = words.to_pylist()
        plain = np.array([not BOUND.match(w) and len(w) <= LONGEST for w in words], bool)
        whole = np.logical_and.reduceat(plain[place], first[:-1])
        chosen = [w for w, p in zip(words, plain.tolist()) if p]
        place = (np.cumsum(plain) - 1)[place[np.repeat(whole, np.diff(first))]]
        first = np.append(0, np.cumsum(np.diff(first)[whole]))
        raw, cuts, kept = [], [], np.ones(len(place), bool)
        for side, length in zip(self.sides, self.length):
            ids, start, count = side.of_words(chosen, length)
            kept &= count[place] > 0
            raw.append(ids[ranges(start[place], count[place])].astype("<u4").tobytes())
            cuts.append((4 * np.append(0, np.cumsum(count[place]))[first]).tolist())
        own = np.array(own)
        sound = np.logical_and.reduceat(kept, first[:-1]) if len(place) else kept
        for k, (i, good) in enumerate(zip(own[whole].tolist(), sound.tolist())):
            if good:
                out[i] = tuple(r[c[k] : c[k + 1]] for r, c in zip(raw, cuts))
        odd = own[~whole].tolist()
        for side in self.sides:
            side.prepare([" " + texts[i] for i in odd])
        for i in odd:
            out[i] = self.tokens(texts[i])
        return out


class Groups:
    """Groups of a slice of documents.

    Tokens of both sides stand in one order: by document and group, first those of a, then those of b.
    """

    def __init__(self, aligner: Aligner, ids: list[tuple[bytes, bytes]]):
        self.aligner = aligner
        own, documents, lengths, self.count = [], [], [], []
        for side in (0, 1):
            numbers = np.frombuffer(b"".join([i[side] for i in ids]), "<u4").astype(np.int64)
            count = np.array([len(i[side]) // 4 for i in ids], np.int64)
            own.append(numbers)
            self.count.append(count)
            documents.append(np.repeat(np.arange(len(ids)), count))
            lengths.append(aligner.length[side][numbers])
        # one line of bytes for all documents, as both sides of a document have the same number of bytes
        ends = [np.cumsum(n) for n in lengths]
        start = np.concatenate([e - n for e, n in zip(ends, lengths)])
        end = np.concatenate(ends)
        side = np.repeat(np.arange(2, dtype=np.int8), [len(n) for n in own])
        order = np.lexsort((side, start))
        highest = np.maximum.accumulate(end[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = start[order][1:] >= highest[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        self.n = int(breaks.sum())
        self.group = np.split(group, [len(own[0])])
        self.ids = own
        self.size = [np.bincount(g, minlength=self.n) for g in self.group]
        self.document = np.concatenate(documents)[order][breaks]
        self.documents = len(ids)

    def totals(self) -> dict[str, np.ndarray]:
        links = np.zeros(self.documents, np.int64)
        np.add.at(links, self.document, self.size[0] * self.size[1])
        return {"n_a": self.count[0], "n_b": self.count[1], "n_groups": np.bincount(self.document, minlength=self.documents), "n_links": links}

    def digests(self) -> list[str]:
        """Of each document's groups in their written form; empty without tokens."""
        na, nb = (s.size for s in self.aligner.sides)
        a, b = (i.copy() for i in self.ids)
        if self.n:
            a[np.cumsum(self.size[0]) - 1] += na
            b[np.cumsum(self.size[1]) - 1] += nb
        place = np.concatenate([np.arange(len(a)) + (np.cumsum(self.size[1]) - self.size[1])[self.group[0]], np.arange(len(b)) + np.cumsum(self.size[0])[self.group[1]]])
        line = np.empty(len(place), np.int64)
        line[place] = np.concatenate([a, b + 2 * na])
        signs, cuts = self.aligner.signs, np.concatenate([[0], np.cumsum(self.count[0] + self.count[1])]).tolist()
        line = line.tolist()
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            out.append(hashlib.sha256("".join(map(signs.__getitem__, line[lo:hi]))[:-1].encode()).hexdigest() if hi > lo else "")
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``document, pair, links``: for each document its distinct id pairs (a * size of b + b) and how many links they are."""
        width = self.aligner.sides[1].size
        halves = []
        for side in (0, 1):  # distinct ids of each group, with how often they are there
            top = self.aligner.sides[side].size
            key, times = np.unique(self.group[side] * top + self.ids[side], return_counts=True)
            group = key // top
            first = np.searchsorted(group, np.arange(self.n + 1))
            halves.append((key % top, times, first))
        (ids_a, times_a, first_a), (ids_b, times_b, first_b) = halves
        group_a = np.repeat(np.arange(self.n), np.diff(first_a))
        partners = np.diff(first_b)[group_a]
        reach = np.cumsum(partners)
        out = []
        at = 0
        while at < len(ids_a):  # a part of a's entries, so that its pairs are EXPAND at most, but for a single entry
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + EXPAND, "right")))
            n = partners[at:stop]
            which = np.repeat(np.arange(at, stop), n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = first_b[group_a[which]] + inside
            out.append(_summed(self.document[group_a[which]], ids_a[which] * width + ids_b[other], times_a[which] * times_b[other]))
            at = stop
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return out[0] if len(out) == 1 else _summed(*(np.concatenate(x) for x in zip(*out)))


def _summed(document: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, document))
    document, pair, links = document[order], pair[order], links[order]
    new = np.ones(len(order), bool)
    new[1:] = (document[1:] != document[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return document[at], pair[at], np.add.reduceat(links, at) if len(at) else links


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest takes."""
    most = int(numbers.max(initial=0))
    return numbers.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << (8 * w))).tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One in each Python worker."""
    return Aligner(path_a, path_b)


_CHUNK = f"chunk long, documents array<struct<{_DOCUMENT.replace(' long', ': long').replace(' string', ': string')}>>, held binary, entry binary, links binary, pair array<long>, holders array<int>"


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of documents: what is known of each, which of the chunk's pairs it holds, and the chunk's dictionary."""
    import uuid

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_CHUNK))

    def finished(rows: list[dict], held: list[np.ndarray], pairs: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
        pair, entry, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        held = np.concatenate(held).astype("<u4")
        row = {"chunk": uuid.uuid4().int >> 65, "documents": rows, "held": held.tobytes(), "entry": entry.astype("<u4").tobytes()}
        row |= {"links": narrow(np.concatenate(links))}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for c, v in (("pair", pair), ("holders", holders.astype(np.int32)))}
        return pa.RecordBatch.from_arrays([lists[f.name] if f.name in lists else pa.array([row[f.name]], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        rows, held, pairs, links, size = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES // 2):
                groups = own.align([t and t.decode() for t in part.column("text").to_pylist()])
                totals = groups.totals()
                columns = [part.column("doc_id").to_pylist(), *(totals[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), groups.digests()]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                document, pair, times = groups.pairs()
                rows += [dict(zip(names, r)) for r in zip(*columns)]
                held.append(np.bincount(document, minlength=part.num_rows))
                pairs.append(pair)
                links.append(times)
                size += part.column("text").nbytes
                if size >= chunk_bytes:
                    yield finished(rows, held, pairs, links)
                    rows, held, pairs, links, size = [], [], [], [], 0
        if rows:
            yield finished(rows, held, pairs, links)

    return with_bytes(docs, "doc_id").mapInArrow(run, _CHUNK)


def pair_counts(chunked: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: documents that hold each pair, and whether no other pair of its first id has more."""
    entries = chunked.select(F.explode(F.arrays_zip("pair", "holders")).alias("e")).select("e.pair", "e.holders")
    counts = entries.groupBy("pair").agg(F.sum("holders").cast("long").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {width}")), "pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair is held by as many documents as any pair of its first id,
    ``count_sum`` adds up the counts of all links. A null or empty text, and one whose tokens of either side don't give
    back its bytes, has no tokens: zeros and an empty digest. Repeated rows and rows with a null id are
    documents of their own, in counts too. Ties are all best. An empty table gives an empty one; other columns are not looked at.
    """
    chunked = stored(chunks(docs, path_a, path_b, chunk_bytes), "chunks", coalesce=False)
    counts = pair_counts(chunked, aligner(path_a, path_b).sides[1].size)
    entries = chunked.select("chunk", F.posexplode("pair").alias("place", "pair"))
    known = entries.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    both = chunked.select("chunk", "documents", "held", "entry", "links").join(known, "chunk", "left")

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for i in range(batch.num_rows):
            rows = batch.column("documents")[i].values
            columns = {f.name: rows.field(f.name) for f in rows.type}
            held, entry = (np.frombuffer(batch.column(c)[i].as_py(), "<u4") for c in ("held", "entry"))
            links = widened(batch.column("links")[i].as_py(), len(entry))
            known = batch.column("known")[i].values
            n, best = np.zeros((2, 0 if known is None else len(known)), np.int64)
            if known is not None:
                place = known.field("place").to_numpy()
                n[place], best[place] = known.field("n").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
            stop = np.cumsum(held)
            for name, value in (("n_best", best), ("count_sum", n)):
                total = np.concatenate([[0], np.cumsum(value[entry] * links)])
                columns[name] = total[stop] - total[stop - held]
            yield columns

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return arrow_map(both, work, out)
