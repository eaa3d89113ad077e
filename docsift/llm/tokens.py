"""Token ids by the public tokenizers, with the ids of words kept between documents.

Files of tokenizers are named by a path, read once in each Python worker.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from .common import trim

#: Bytes of words and their results that one cache of a worker keeps in each of its two generations.
KEPT_BYTES = 24 << 20
#: The same for the words of a vocabulary that drops white space.
KEPT_WORDS = 64 << 20
#: A single result above this is not kept.
KEPT_ENTRY = 1024


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Kept(dict):
    """What ``make`` returns for a key, remembered within a fixed number of bytes.

    There are two generations: once the younger one is full it becomes the older one, whose keys come
    back when they are asked for again. So frequent keys stay.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int = KEPT_BYTES):
        super().__init__()
        self.make, self.limit, self.size, self.older = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        cost = 200 + len(value) + 2 * len(key)
        if cost <= KEPT_ENTRY:
            self.size += cost
            if self.size > self.limit:
                self.older, self.size = dict(self), cost
                self.clear()
            self[key] = value


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies.

    Fixed by the format: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts for a vocabulary that drops white space and lower-cases.

    White space separates tokens there, so a text's ids are those of its words, one
    after the other. Each distinct word is encoded once. Words of printable
    Latin-1 letters only are cut by the vocabulary's own pattern and their pieces
    go straight to its merge model; all others go through the library as they are.
    """

    #: The pattern of word_bpe_49k.json.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
    #: A byte that no UTF-8 holds; it stands for the end of a word.
    END = b"\xff"
    #: str.split() takes these for white space, the vocabulary does not.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.words, self.pieces = Kept(self._word, KEPT_WORDS), Kept(self._piece)
        self.merges, self.ids = end_marked_merges(path, self.END)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and len(word) < KEPT_ENTRY:  # one piece
            return self._piece(word) if word.islower() else self.pieces[word.lower()]
        if self.PLAIN.fullmatch(word) and "<|" not in word and len(word) < KEPT_ENTRY:
            return b"".join(map(self.pieces.__getitem__, self.PATTERN.findall(word.lower())))
        return self._whole(word)

    def _piece(self, piece: str) -> bytes:
        return packed([self.ids[rank] for rank in self.merges._encode_single_piece(piece.encode() + self.END)])


def end_marked_merges(path: str, end: bytes):
    """The merge model of a vocabulary with word ends, for bytes followed by ``end``; and the id of each of its ranks.

    The end belongs to a word's last letter from the start, so joining these two ranks before all merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    mark, letters = model["end_of_word_suffix"], byte_letters()
    byte = {letter: bytes([b]) for b, letter in letters.items()}
    joined = [a + b for a, b in (p.split(" ") if isinstance(p, str) else p for p in model["merges"])]
    own = [letter for b, letter in letters.items() if bytes([b]) != end]
    names = [*own, *(letter + mark for letter in own), *joined]
    raw = [b"".join(byte[c] for c in n.removesuffix(mark)) + (end if n.endswith(mark) else b"") for n in names]
    ranks = {end: 0} | {r: 1 + i for i, r in enumerate(raw)}
    if len(ranks) != len(raw) + 1:
        raise ValueError("two merges make the same token")
    ids = [0, *(model["vocab"][n] for n in names)]
    return tiktoken.Encoding(path, pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=len(ranks)), ids


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One in each Python worker, so that tasks after the first find its words known."""
    return WordEncoder(path)


def release() -> None:
    """Give up the words that an earlier job's tasks left in this worker, and their memory, for work that needs it for other arrays."""
    if word_encoder.cache_info().currsize:
        word_encoder.cache_clear()
        load_tokenizer.cache_clear()
        gc.collect()
        trim()
