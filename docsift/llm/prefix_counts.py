"""Exact token counts of every prefix of a text, by dynamic programming.

For byte-pair encoding by merge rank, a sequence of tokens is what the encoder makes
of their bytes if and only if every two neighbours are. So the encoding of a prefix
that ends at byte i is the encoding of the prefix that ends where its last token
begins, plus that token; there is one token for which the pair with the last token
before is such a pair. This gives ``count[i] = count[i - len(token)] + 1`` for every i in
one pass, and the count of the whole is that of its last prefix.

The pre-tokens of a text are independent, and each distinct one is done once in a slice of
documents: all of a slice together, prefixes of one byte first, then of two, and so on, and a prefix
that several of them share once. Tokens are found by a 64-bit hash of their bytes. A document keeps the difference of the count at each character to the one
before as a signed 32-bit number, so a cumulative sum answers: how many tokens has
the prefix of n characters, and where to cut for a budget of tokens, with no further
encoding.

A count is that of the prefix as a text of its own. Where cutting changes the
pre-tokens (inside a contraction, at the end of a run of white space before a word,
inside a special string), those of the prefix are used.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Lookup, arrow_map, byte_phrases, ranges, slices, spaced, with_bytes
from .tokens import Kept, byte_letters, load_tokenizer

#: Pairs of tokens whose compatibility a worker keeps; beyond that it starts anew.
KEPT_PAIRS = 500_000
#: Pre-tokens of more bytes are done one by one.
TOGETHER = 40


class PrefixCounter:
    """Prefix counts for a byte-level vocabulary with the usual pre-token pattern."""

    #: The pattern of byte-level vocabularies, and what it takes for white space.
    SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
    PATTERN = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", SPACE)
    )
    #: A space before anything but white space begins a pre-token, whatever stands around it.
    CHUNK = re.compile(f"(?= [^{SPACE}])")
    WIDE = re.compile(f" [{SPACE}]")
    #: Its last character belongs to the word after it, or stands alone.
    RUN = re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])")
    #: Cut by one character they are two pre-tokens.
    CONTRACTIONS = ("'re", "'ve", "'ll")
    WHITE = re.compile(f"[{SPACE}]")
    #: A chunk that may hold a run, or a part of one.
    NEAR_RUN = re.compile(f"[{SPACE}](?:[{SPACE}]|$)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = {letter: b for b, letter in byte_letters().items()}
        raw = {piece: bytes(byte[c] for c in piece) for piece in model["vocab"] if all(c in byte for c in piece)}
        self.token = {raw[p]: i for p, i in model["vocab"].items() if p in raw}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.token.values()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = model["vocab"][left + right]
            pair = model["vocab"][left], model["vocab"][right]
            self.merge[pair] = rank, whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self.longest = max(map(len, self.token))
        self.tokenizer = load_tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.pre_tokens = Kept(self._pre_token)
        self.chunks = Kept(self._chunk)
        self._arrays()

    def _arrays(self) -> None:
        """The vocabulary for whole arrays of tokens."""
        sizes = np.array([len(t) for t in self.token], np.int64)
        ends, ids = np.cumsum(sizes), np.array(list(self.token.values()), np.int64)
        self.by_hash = Lookup(byte_phrases(b"".join(self.token)).of(ends - sizes, ends), ids)
        self.ranks = np.full(max([*ids.tolist(), *self.rank], default=-1) + 1, -1, np.int64)
        self.ranks[list(self.rank)] = list(self.rank.values())
        self.left, self.right = np.zeros((2, len(self.ranks)), np.int64)
        if self.parts:
            self.left[list(self.parts)], self.right[list(self.parts)] = np.array(list(self.parts.values()), np.int64).T
        pairs = np.array(list(self.merge), np.uint64).reshape(-1, 2)
        self.across = Lookup(pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.array([r for r, _ in self.merge.values()], np.int64))
        self.sound = np.ones(len(self.ranks), bool)
        made = np.array(list(self.parts), np.int64)
        self.sound[made] = self.stay_pairs(self.left[made], self.right[made], self.ranks[made])

    def stays_pair(self, left: int, right: int) -> bool:
        """Whether the encoder leaves these two tokens side by side.

        Undoes the merges of both, the latest first. If at some time a merge across
        the seam would have come earlier than the one undone, it would have been made.
        """
        ok = self.stays_pair_under(left, right, len(self.merge))
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def prefix(self, text: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token, by its length in bytes, from 0.

        Exactly one begin of the last token is right, so they may be tried in any order: often the last token grows, or a new one starts.
        """
        count, last, begin = [0], [-1], [0]
        get, longest, pairs = self.token.get, self.longest, self.pairs
        for end in range(1, len(text) + 1):
            grown = begin[end - 1]
            for start in (grown, end - 1, *range(max(0, end - longest), end - 1)):
                own = get(text[start:end])
                if own is None:
                    continue
                if start:
                    good = pairs.get((last[start], own))
                    if good is None:
                        good = self.stays_pair(last[start], own)
                else:
                    good = self.whole(own)
                if good:
                    count.append(count[start] + 1)
                    last.append(own)
                    begin.append(start)
                    break
        return count

    def changes(self, texts: list[bytes]) -> np.ndarray:
        """What ``prefix`` says of sorted pre-tokens, as the change of the count at each byte of all of them, one after the other."""
        size = np.array([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        letters, runs, first = np.frombuffer(data, np.uint8), byte_phrases(data), np.cumsum(size) - size
        most = int(size.max(initial=0))
        at = first + np.arange(len(texts))
        prefix = np.zeros(len(data) + len(texts), np.int64)  # from ``at`` on, the numbers of a text's prefixes by length; 0 is the empty one
        count, last, begin = np.zeros((3, len(data) + 1), np.int64)
        made, who = 1, np.arange(len(texts))
        for end in range(1, most + 1):
            who = who[size[who] >= end]
            before, letter = prefix[at[who] + end - 1], letters[first[who] + end - 1]
            new = np.ones(len(who), bool)  # in order, texts with the same prefix are neighbours
            new[1:] = (before[1:] != before[:-1]) | (letter[1:] != letter[:-1])
            prefix[at[who] + end] = made - 1 + np.cumsum(new)
            own, grown = who[new], begin[before[new]]
            left = np.arange(len(own))
            for tried in range(3):
                if tried < 2:
                    which, start = left, np.full(len(left), end - 1) if tried else grown
                else:
                    which, start = np.repeat(left, end - 1), np.tile(np.arange(end - 1), len(left))
                low = first[own[which]]
                token = self.by_hash.get(runs.of(low + start, low + end))
                known = token >= 0
                which, start, token = which[known], start[known], token[known]
                head = prefix[at[own[which]] + start]
                good = self.sound[token]
                inner = np.flatnonzero(start)
                good[inner] = self.stay_pairs(last[head[inner]], token[inner], np.full(len(inner), len(self.merge)))
                right = made + which[good]
                count[right], last[right], begin[right] = count[head[good]] + 1, token[good], start[good]
                left = left[count[made + left] == 0]
                if not len(left):
                    break
            made += len(own)
        whole = np.arange(len(data)) + np.repeat(np.arange(len(texts)), size)
        return count[prefix[whole + 1]] - count[prefix[whole]]

    def stay_pairs(self, left: np.ndarray, right: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``stays_pair_under`` of whole arrays."""
        out, at = np.ones(len(left), bool), np.arange(len(left))
        while len(at):
            across = self.across.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
            merged = (across >= 0) & (across < before)
            out[at[merged]] = False
            a, b = self.ranks[left], self.ranks[right]
            on = np.flatnonzero(~merged & ((a >= 0) | (b >= 0)))
            at, a, b, left, right = at[on], a[on], b[on], left[on], right[on]
            first = a > b
            before = np.where(first, a, b + 1)
            left, right = np.where(first, self.right[left], left), np.where(first, right, self.left[right])
        return out

    def whole(self, token: int) -> bool:
        """Whether the encoder makes this token of its own bytes."""
        if token not in self.alone:
            parts = self.parts.get(token)
            self.alone[token] = parts is None or self.stays_pair_under(*parts, self.rank[token])
        return self.alone[token]

    def stays_pair_under(self, left: int, right: int, before: int) -> bool:
        """Whether both parts stand side by side when the merge of this rank comes."""
        while True:
            across = self.merge.get((left, right))
            if across is not None and across[0] < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # the left one's merge counts as earlier than an equal one on its right
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]

    def _pre_token(self, piece: str) -> bytes:
        raw = piece.encode()
        return self._changes(piece, raw, self.prefix(raw))

    def _changes(self, piece: str, raw: bytes, count: list[int]) -> bytes:
        """From each character to the next."""
        if piece in self.CONTRACTIONS:
            count = [*count[:2], 2, *count[3:]]
        if len(raw) != len(piece):  # counts where a character ends
            count = [n for n, b in zip(count, raw) if b & 0xC0 != 0x80] + [count[len(raw)]]
        return array("i", map(sub, count[1:], count)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.PATTERN.findall(chunk)))

    def steps(self, text: str) -> np.ndarray:
        """The change of the count at each character of a text; their cumulative sum is the count of each prefix."""
        parts = [text]
        for special in self.special:
            if special in text:
                parts = [q for p in parts for q in (re.split(f"({re.escape(special)})", p) if p not in self.special else [p])]
        if parts == [text] and text not in self.special:
            return self._plain(text)
        out, before = [], ""
        for part in parts:
            if part in self.special:  # ordinary text up to its last character, then one token
                count = np.cumsum(self._plain(before + part[:-1]))[len(before) :]
                whole = int(self._plain(before).sum())
                out.append(np.diff(np.concatenate([[whole], count, [whole + 1]])).astype("<i4"))
                before = ""
            else:
                out.append(self._plain(part))
                before = part
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        """The same for a text in which no special string is looked for."""
        if not text:
            return np.zeros(0, "<i4")
        return self._with_runs(text, np.frombuffer(b"".join(map(self.chunks.__getitem__, self.CHUNK.split(text))), "<i4"))

    def _with_runs(self, text: str, out: np.ndarray) -> np.ndarray:
        """A prefix that ends inside a run of white space has the run's own tokens up to there."""
        for i, run in enumerate(self.RUN.finditer(text)):
            out = out if i else out.copy()
            end = run.end() - 1
            alone = np.frombuffer(self.pre_tokens[run[0]], "<i4")
            more = int(alone[-1]) - int(out[end])
            out[end] += more
            out[end + 1] -= more
        return out

    def steps_of(self, texts: list[str]) -> list[np.ndarray]:
        """``steps`` of each of some texts, whose pre-tokens are done together."""
        out = [None if t and not any(s in t for s in self.special) else self.steps(t) for t in texts]
        plain = [i for i, steps in enumerate(out) if steps is None]
        if not plain:
            return out
        pieces, n, number, near, place, first = self._cut([texts[i] for i in plain])
        values, start, length = self._table(number)
        values = values[ranges(start[pieces], length[pieces])]
        ends = np.concatenate([[0], np.cumsum(length[pieces])])[np.cumsum(n)]
        length = np.diff(ends, prepend=0)
        values = values[ranges((ends - length)[place], length[place])]
        cuts = np.concatenate([[0], np.cumsum(length[place])])[first].tolist()
        runs = np.add.reduceat(near[place], first[:-1], dtype=np.int64).tolist()
        for i, a, b, some in zip(plain, cuts, cuts[1:], runs):
            out[i] = self._with_runs(texts[i], values[a:b]) if some else values[a:b]
        return out

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of all distinct chunks, how many each chunk has, these numbers, whether a chunk is near a run,
        the chunk at each place, and where a text's places begin."""
        words, place, first = spaced(pa.array(texts, pa.string()))
        heads = place[first[:-1]]
        place[first[:-1]] = len(words) + np.arange(len(texts))  # a text's first chunk has no space before it
        plain = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)
        spelt = words.filter(pa.array(~plain)).to_pylist()
        number = {" " + w: i for i, w in enumerate(words.filter(pa.array(plain)).to_pylist())}
        wide = np.zeros(len(words) + len(texts), bool)
        wide[np.flatnonzero(~plain)] = [not w or bool(self.WHITE.match(w)) for w in spelt]
        others = [" " + w for w in spelt] + words.take(pa.array(heads)).to_pylist()
        odd = np.flatnonzero(np.add.reduceat(wide[place], first[:-1], dtype=np.int64)).tolist()
        if odd:  # not every space of these begins a chunk
            places, more = np.split(place, first[1:-1]), {}
            for i in odd:
                places[i] = np.array([more.setdefault(c, len(wide) + len(more)) for c in self.CHUNK.split(texts[i])], np.int64)
            others += more
            place, first = np.concatenate(places), np.append(0, np.cumsum([len(p) for p in places]))
        known = np.append(plain, np.zeros(len(words) + len(others) - len(spelt) - len(plain), bool))
        n, near = np.ones(len(known), np.int64), np.zeros(len(known), bool)
        near[~known] = [bool(self.NEAR_RUN.search(c)) for c in others]
        cut = list(map(self.PATTERN.findall, others))
        n[~known] = list(map(len, cut))
        pieces, own = np.zeros(int(n.sum()), np.int64), np.repeat(known, n)
        pieces[own] = np.arange(len(number))
        pieces[~own] = [number.setdefault(p, len(number)) for c in cut for p in c]
        return pieces, n, number, near, place, first

    def _table(self, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Changes at the characters of all numbered pre-tokens, and where each one's begin, and how many they are."""
        pieces = list(number)
        raw = [p.encode() for p in pieces]
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        together = np.array(list(map(len, raw)), np.int64) <= TOGETHER
        together[[number[c] for c in self.CONTRACTIONS if c in number]] = False
        order, apart = order[together[order]], np.flatnonzero(~together)
        texts = list(map(raw.__getitem__, order.tolist()))
        begins = np.flatnonzero(np.frombuffer(b"".join(texts), np.uint8) & 0xC0 != 0x80)
        values = np.add.reduceat(self.changes(texts), begins) if texts else np.zeros(0, np.int64)
        length = np.array(list(map(len, pieces)), np.int64)
        start, order = np.zeros(len(pieces), np.int64), np.append(order, apart)
        start[order] = np.cumsum(length[order]) - length[order]
        own = [np.frombuffer(self._pre_token(pieces[i]), "<i4") for i in apart.tolist()]
        return np.concatenate([values.astype("<i4"), *own]), start, length


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One in each Python worker."""
    return PrefixCounter(path)


def tokens_before(steps: bytes, characters: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(steps, "<i4")[:characters].sum())


def fitting_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has no more than ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, "<i4")) <= budget)
    return int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0


def token_counts(docs: DataFrame, path: str, limit: int = 512, keep_steps: bool = False) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit, fits``: ``fits`` is the characters that ``limit`` tokens hold.

    ``keep_steps`` adds ``steps``, the table of prefix counts as differences, for
    ``tokens_before`` and ``fitting_prefix``. A null text is an empty one. Repeated
    rows and null ids are counted like others.
    """

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        counter = prefix_counter(path)
        for rows in slices(batch):
            part = [t.decode() if t else "" for t in rows.column("text").to_pylist()]
            steps = counter.steps_of(part)
            n = [int(s.sum()) for s in steps]
            fits = [len(t) if k <= limit else fitting_prefix(s.tobytes(), limit) for t, s, k in zip(part, steps, n)]
            columns = {"doc_id": rows.column("doc_id"), "n_bytes": [len(t.encode()) for t in part]}
            columns |= {"n_tokens": n, "over_limit": [k > limit for k in n], "fits": fits}
            yield columns | ({"steps": [s.tobytes() for s in steps]} if keep_steps else {})

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long" + (", steps binary" if keep_steps else "")
    return arrow_map(with_bytes(docs, "doc_id"), work, schema)
