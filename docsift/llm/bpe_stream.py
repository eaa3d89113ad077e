"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

How far to look ahead. Let two texts begin with the same n bytes, and follow the merges of
both in order of rank. Left of some place p, at first p = n, the symbols of both are the same. Only
a merge (u, v) whose u ends at p and whose v is the symbol that begins there in one of the two
moves p, and it moves it to where u begins. In both, the symbol that begins there later
has u at its left edge: it is u, or was made from u by merges to its right. So the next move takes a
merge of a later rank whose right part has u at its left edge. The most bytes that
such a chain can move p is found from the merge list, from the last merge to the first:

    reach(u, v) = len(u) + max(reach(m) for later merges m whose right part has u at its left edge)

The lookahead is the largest reach. Tokens that end so many bytes before the end of what has been
read are stable, whatever follows: they are emitted and forgotten. What follows a stable end is
encoded as if it began there. This needs merges whose parts are made by earlier ones, as
training makes them; other lists are refused.

Pre-tokens (words with their space, numbers, signs, runs of white space) end with what the
pattern sees at most three characters ahead. One that does not end within a window is passed to the
transducer piece by piece, so memory does not depend on its length.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, with_bytes
from .tokens import byte_letters, load_tokenizer, packed

#: Fixed value: the pattern of pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are looked at together, and bytes that the merge model gets at a time.
WINDOW = 1 << 14
MERGE_WINDOW = 2048


class Merges:
    """A merge list with its lookahead. Merging itself, of a window or of the bytes of one pre-token, is the library's."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        byte = {letter: b for b, letter in letters.items()}
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.lookahead = lookahead(pairs)
        self.longest = max((len(a) + len(b) for a, b in pairs), default=1)
        made = [*letters.values(), *(a + b for a, b in pairs)]
        order = [model["vocab"][p] for p in made]
        # the library calls a token by its rank; single bytes have no merge, and so any ranks before
        ranks = {bytes(byte[c] for c in p): rank for rank, p in enumerate(made)}
        self.to_id = np.array(order, np.uint32)
        self.pieces = dict(zip(order, ranks))
        self.model = tiktoken.Encoding(path, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=len(ranks))

    def window(self, text: str) -> bytes:
        """Ids of text that begins and ends where pre-tokens do."""
        return self.to_id[self.model.encode_to_numpy(text, disallowed_special=())].astype("<u4").tobytes() if text else b""

    def ids(self, raw: bytes) -> list[int]:
        """Ids of the bytes of one pre-token, or of a part of it."""
        return self.to_id[self.model._encode_single_piece(raw)].tolist()


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes beyond a token's end after which nothing changes it. Parts have a letter for each byte."""
    made: dict[str, int] = {}
    left: dict[str, str] = {}
    for rank, (a, b) in enumerate(merges):
        if any(len(p) > 1 and p not in made for p in (a, b)) or a + b in made:
            raise ValueError(f"merge {rank} uses a part that no earlier merge makes, or makes a token anew")
        made[a + b], left[a + b] = rank, a
    furthest: dict[str, int] = {}
    most = 0
    for a, b in reversed(merges):
        reach = len(a) + furthest.get(a, 0)
        most = max(most, reach)
        edge: str | None = b
        while edge is not None:
            if furthest.get(edge, 0) < reach:
                furthest[edge] = reach
            edge = left.get(edge)
    return most


class OpenPreToken:
    """The transducer for one pre-token of any length: bytes in, stable ids out."""

    def __init__(self, merges: Merges, window: int = MERGE_WINDOW):
        self.merges, self.window, self.held = merges, max(window, merges.longest) + merges.lookahead, b""

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        self.held += raw
        at = 0
        while len(self.held) - at > self.window:
            part = self.held[at : at + self.window]
            end = 0
            for i in self.merges.ids(part):
                size = len(self.merges.pieces[i])
                if end + size > len(part) - self.merges.lookahead:
                    break
                out.append(i)
                end += size
            at += end
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.ids(self.held) if self.held else [], b""
        return out


class Encoder:
    """Ids of texts that come in parts: ``feed`` any number of them, then ``finish``. Holds no more than a window.

    ``specials``: strings of the vocabulary's own tokens are these tokens, as the
    library's default has it; without it they are ordinary text.
    """

    #: Fixed value: what the pattern takes for white space.
    SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    CLASSES = (r"\p{L}", r"\p{N}", "[^S\\p{L}\\p{N}]", "[S]")
    PATTERN = regex.compile(PRE_TOKEN.replace(r"^\s", "^S").replace(r"\s", "[S]").replace(r"\S", "[^S]").replace("S", SPACE))
    #: A space before anything but white space begins a pre-token, whatever stands around it.
    CHUNK = re.compile(f"(?= [^{SPACE}])")
    AHEAD = 3

    def __init__(self, path: str, specials: bool = True, window: int = WINDOW):
        self.merges = Merges(path)
        self.window = max(window, 64)
        self.runs = [regex.compile(c.replace("S", self.SPACE) + "+") for c in self.CLASSES]
        added = load_tokenizer(path).get_added_tokens_decoder().items() if specials else ()
        self.specials = {t.content: packed([i]) for i, t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.longest_special = max(map(len, self.specials), default=0)
        self._start()

    def _start(self) -> None:
        self.tail = self.rest = ""  # not looked at yet: perhaps the begin of a special; plain text
        self.run = None  # the class of characters of an open long pre-token
        self.open: OpenPreToken | None = None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if len(text) <= self.window and not (self.cut and self.cut.search(text)):
            return self.merges.window(text)
        return b"".join([self.feed(text[at : at + self.window]) for at in range(0, len(text), self.window)]) + self.finish()

    def feed(self, part: str) -> bytes:
        """Ids that have become stable."""
        text, self.tail = self.tail + part, ""
        if not self.cut:
            return self._plain(text)
        out = []
        *closed, text = self.cut.split(text)
        for plain, special in zip(closed[::2], closed[1::2]):
            out += [self._plain(plain), self._close(), self.specials[special]]
        for n in range(min(len(text), self.longest_special - 1), 0, -1):
            if any(s.startswith(text[-n:]) for s in self.specials):
                text, self.tail = text[:-n], text[-n:]
                break
        return b"".join(out) + self._plain(text)

    def finish(self) -> bytes:
        out = self._plain(self.tail) + self._close()
        self._start()
        return out

    def _plain(self, part: str) -> bytes:
        text, out = self.rest + part, []
        while True:
            if self.run is not None:
                text, ids = self._through(text)
                out.append(ids)
                if self.run is not None:
                    break
            if len(text) <= self.window:
                break
            cut = self._last_cut(text)
            if cut:  # what stands before a cut does not depend on what follows
                out.append(self.merges.window(text[:cut]))
                text = text[cut:]
                continue
            at = 0
            for m in self.PATTERN.finditer(text):
                if m.end() > len(text) - self.AHEAD or m.end() - m.start() > self.window:
                    break
                out.append(self.merges.window(m[0]))
                at = m.end()
            text = text[at:]
            if len(text) > self.window:  # one pre-token fills the window
                first = self.PATTERN.match(text)[0]
                self.run = next(r for r in self.runs if r.fullmatch(first[-1]))
                self.open = OpenPreToken(self.merges)
                begun = first[: -self.AHEAD]
                out.append(self._stable(begun))
                text = text[len(begun) :]
        self.rest = text
        return b"".join(out)

    def _through(self, text: str) -> tuple[str, bytes]:
        """Passes what belongs to the open pre-token, and closes it where it is seen to end."""
        m = self.run.match(text)
        n = m.end() if m else 0
        if n == len(text):  # the last character may belong to a word after it
            keep = 1 if self.run is self.runs[3] else 0
            return text[max(0, n - keep) :], self._stable(text[: max(0, n - keep)])
        n -= 1 if self.run is self.runs[3] and n else 0
        ids = self._stable(text[:n]) + packed(self.open.finish())
        self.run = self.open = None
        return text[n:], ids

    def _stable(self, text: str) -> bytes:
        return packed(self.open.feed(text.encode()))

    def _close(self) -> bytes:
        """Ids of what is held, as the end of a text or a special token ends it."""
        text, out = self.rest, b""
        if self.run is not None:
            m = self.run.match(text)
            n = m.end() if m else 0
            out = self._stable(text[:n]) + packed(self.open.finish())
            text, self.run, self.open = text[n:], None, None
        self.rest = ""
        return out + self.merges.window(text)

    def _last_cut(self, text: str) -> int:
        """Where the last chunk that begins in the first window begins; 0 if none does."""
        at = text.rfind(" ", 1, self.window)
        while at > 0 and self.runs[3].match(text, at + 1):
            at = text.rfind(" ", 1, at)
        return max(at, 0)


class Decoder:
    """Text of ids that come in parts. Between parts it holds the bytes of one unfinished character, three at most.

    Bytes that are no UTF-8 become U+FFFD, one for each longest begin of a character; ids without an entry are passed over.
    """

    def __init__(self, path: str):
        byte = {letter: b for b, letter in byte_letters().items()}
        entries = {i: piece for piece, i in load_tokenizer(path).get_vocab(with_added_tokens=True).items()}
        plain = {i: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for i, p in entries.items()}
        self.pieces = [plain.get(i, b"") for i in range(max(plain, default=-1) + 1)]
        self._start()

    def _start(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        """Text that is certain after these little-endian unsigned 32-bit ids."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.pieces):
            numbers = numbers[numbers < len(self.pieces)]
        return self.state.decode(b"".join(map(self.pieces.__getitem__, numbers.tolist())))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self._start()
        return out

    def decode(self, ids: bytes) -> str:
        return "".join([self.feed(ids[at : at + 4 * WINDOW]) for at in range(0, len(ids), 4 * WINDOW)]) + self.finish()


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One in each Python worker."""
    return Encoder(path, specials)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, specials: bool = True, decoded: bool = False) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit), and with ``decoded`` the ``text`` these ids give.

    A null text is an empty one, with no ids. Repeated rows and null ids are encoded like others; an empty table gives
    an empty one; other columns are not looked at. Equal texts have equal ids.
    """

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        own = encoder(path, specials)
        for part in slices(batch):
            ids = [own.encode(t.decode()) if t else b"" for t in part.column("text").to_pylist()]
            columns = {"doc_id": part.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids}
            yield columns | ({"text": list(map(decoder(path).decode, ids))} if decoded else {})

    schema = "doc_id long, n_tokens long, ids binary" + (", text string" if decoded else "")
    return arrow_map(with_bytes(docs, "doc_id"), work, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Per row ``doc_id, text`` of ``tokens(doc_id, ids)``; null ids give a null text."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for part in slices(batch, "ids"):
            text = [None if i is None else decoder(path).decode(i) for i in part.column("ids").to_pylist()]
            yield {"doc_id": part.column("doc_id"), "text": text}

    return arrow_map(tokens.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the ids of a text and of the text they give back."""
    done = encode(docs, path, decoded=True)
    digest = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")]
    return done.select("doc_id", "n_tokens", *digest)
