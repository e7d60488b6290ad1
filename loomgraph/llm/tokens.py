"""Encoders over the public vocabulary files, fast enough for whole corpora.

The merges of both BPE files run on tiktoken's core, from ranks read out of
the file itself, several times as fast as the tokenizers library does.  Texts
on which the two could differ go to the tokenizers library: those that hold the
literal content of an added token, as ``<|endoftext|>``, which the library
gives the token's id, those with characters that younger Unicode tables class
otherwise, and odd ones of ``WordBpe``.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
import unicodedata

import numpy as np

# One task has one core: neither library may start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

_TWO = re.compile(r"\s\s")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level BPE files: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _encoding(name: str, pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ids(encoding, text: str) -> np.ndarray:
    try:
        return np.frombuffer(encoding._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)
    except (AttributeError, TypeError):
        return np.array(encoding.encode_ordinary(text), np.uint32)


def _added(path: str) -> tuple[dict[str, int], re.Pattern]:
    """The file's added tokens, and a pattern of their contents (one that never matches, if there is none)."""
    found = {t["content"]: t["id"] for t in json.load(open(path)).get("added_tokens", [])}
    return found, re.compile("|".join(map(re.escape, found)) or r"(?!)")


@functools.cache
def _unsettled() -> np.ndarray:
    """For each character, whether its class (letter, number, white space or other) depends on how new an engine's Unicode tables are.

    Such are those whose class has changed since Unicode 3.2, and those that have no meaning yet.
    """
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    kinds = {"L": 1, "N": 2, "Z": 3}
    return np.array([c > 127 and (new(chr(c)) == "Cn" or kinds.get(new(chr(c))[0]) != kinds.get(old(chr(c))[0])) for c in range(sys.maxunicode + 1)])


def settled(text: str) -> bool:
    """Whether all engines cut the text alike."""
    return text.isascii() or not _unsettled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any()


def _stored(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


class ByteBpe:
    """A byte-level BPE over a JSON vocabulary file or a rank file.

    ``stored``: the type that ids are stored as, wide enough for all of them.
    """

    #: The usual pattern; and for texts without two white-space characters in a row, where its lookahead never matters.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""

    def __init__(self, path: str):
        self._library, added, self._special = None, {}, re.compile(r"(?!)")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            letters = _byte_letters()
            added, self._special = _added(path)
            vocab = json.load(open(path))["model"]["vocab"]
            self.ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
            self._library = Tokenizer.from_file(path)
        else:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self._full, self._plain = (_encoding(k, p, self.ranks) for k, p in (("full", self.PATTERN), ("plain", self.PLAIN)))
        self.bytes = [b""] * (max([*self.ranks.values(), *added.values()]) + 1)
        for token, i in (*self.ranks.items(), *((t.encode(), i) for t, i in added.items())):
            self.bytes[i] = token
        self.stored = _stored(len(self.bytes))
        self.digits = list(map(str, range(len(self.bytes))))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        if self._library and (self._special.search(text) or not settled(text)):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        return _ids(self._full if _TWO.search(text) else self._plain, text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _set_apart() -> re.Pattern:
    """Contractions, runs of signs, and single numbers.

    The pattern begins with one class of all characters that may begin such a
    piece, which the engine looks for several times as fast as for alternatives.
    """
    numbers = {c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nd", "Nl", "No")}
    sign = re.compile(r"[^\w\s]|_")
    first = [c for c in range(0x10000) if c in numbers or sign.match(chr(c))]
    edges = [i for i in range(len(first)) if i == 0 or first[i] != first[i - 1] + 1]
    spans = "".join(f"\\u{first[a]:04x}-\\u{first[b - 1]:04x}" for a, b in zip(edges, [*edges[1:], len(first)], strict=True))
    number = re.escape("".join(map(chr, sorted(numbers))))
    return re.compile(rf"[{spans}\U00010000-\U0010ffff](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<=[{number}])|(?<=[^\w\s]|_)(?:[^\w\s]|_)*)")


class WordBpe:
    """A lower-case BPE with word ends, white space dropped.

    Each word's end is marked by one space, a byte that no piece can hold; the
    ranks of tokens with a word end hold that space too.
    """

    _PATTERN = r"(?:'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+) "
    #: What the library's own normaliser or white space class may treat otherwise than Python's.
    _ODD = re.compile("[\x1c-\x1fΣ]")
    _WIDE = re.compile("[\U00010000-\U0010ffff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters = _byte_letters()
        added, self._special = _added(path)
        ranks = {}
        vocab = json.load(open(path))["model"]["vocab"]
        for token, i in vocab.items():
            if token not in added:
                ended = token.endswith("</w>")
                ranks[bytes(letters[c] for c in token.removesuffix("</w>")) + b" " * ended] = i
        self._words = _encoding("words", self._PATTERN, ranks)
        self._library = Tokenizer.from_file(path)
        self.stored = _stored(max([*vocab.values(), *added.values()]) + 1)
        self._apart = _set_apart()

    def _odd(self, text: str) -> bool:
        if text.isascii():
            return bool(self._special.search(text.lower()) or self._ODD.search(text))
        if not settled(text) or self._special.search(text.lower()) or self._ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return True
        return any(c > "\uffff" and unicodedata.category(c)[0] == "N" for c in set(self._WIDE.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        if self._odd(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        words = " ".join(self._apart.sub(r" \g<0> ", text.lower()).split())
        return _ids(self._words, words + " ")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
