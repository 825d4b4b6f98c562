"""Token ids of whole texts by a public tokenizer file, with a cache of words.

A text of Latin-1 characters only is cut into the pieces that the file's own rule splits it
into, and a piece is merged once. Other texts are cut at blanks, and their words go
through all of the file's steps once.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Words kept in a worker's cache, and how many of the oldest stay when it is full.
CACHE_WORDS, CACHE_CORE = 400_000, 200_000

_BLANKS = re.compile("[ \n]+")


#: How a file's rules must look for words to be encoded one by one, and for
#: plain words to go to its merges directly.
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = frozenset(".,!?;:")

# The split rule for lower-case Latin-1: its letters, numbers and white space.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+"
)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes for those from 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


_BYTE_CHARACTERS = _byte_characters()


def _splits_words(path: str) -> bool:
    """Whether the file drops white space and splits what is between into letters, digits
    and marks, in lower case, before it merges bytes.

    Then a text's ids are those of its blank-separated parts, one after the other, and a
    mark after a letter starts a part of its own. (Letters beyond Latin-1 are left out, as
    a few become two characters in lower case.)
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal = (rules.get("normalizer") or {}).get("normalizers", [])
    before = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = [(s["type"], s.get("pattern", {}).get("Regex")) for s in normal]
    return (
        steps == _NORMAL
        and [s["type"] for s in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"].get("Regex") == _SPLIT
        and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True)
        and not before[1]["add_prefix_space"]
        and not any(t["single_word"] or t["normalized"] for t in rules["added_tokens"])
    )


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids without special tokens, as little-endian integers of ``dtype``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<{self.code}")
        self.by_word = _splits_words(path)
        self.cache: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._packed(e.ids) for e in encoded]

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _learn(self, words: list[str]) -> None:
        """Add words to the cache, which share the ids of what comes before a mark.

        Plain words share those of their lower-case letters, too, and need the merges only.
        """
        made, others = [], {}
        for word in words:
            core, mark = word, ""
            if word[-1:] in _MARKS and word[-2:-1].isalpha() and word[-2] <= "\xff":
                core, mark = word[:-1], word[-1]
            if core.isascii() and core.isalpha():
                core = core.lower()
                if core not in self.cache:
                    ids = [t.id for t in self.tokenizer.model.tokenize(core)]
                    self.cache[core] = self._packed(ids)
            elif core not in self.cache:
                others[core] = None
            if mark and mark not in self.cache:
                others[mark] = None
            made.append((word, core, mark))
        self.cache.update(zip(others, self._bytes(list(others)), strict=True))
        for word, core, mark in made:
            self.cache[word] = self.cache[core] + (self.cache[mark] if mark else b"")

    def _make_room(self) -> None:
        if len(self.cache) > CACHE_WORDS:  # frequent words came first, so the core holds them
            for word in list(self.cache)[CACHE_CORE:]:
                del self.cache[word]

    def _merged(self, piece: str) -> bytes:
        """A piece's ids: its bytes need the merges only."""
        if not piece.isascii() or not piece.isalpha():
            piece = "".join([_BYTE_CHARACTERS[b] for b in piece.encode()])
        return self._packed([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _of_pieces(self, text: str) -> bytes:
        pieces, cache = _PIECES.findall(text.lower()), self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            self._make_room()
            for piece in set(pieces).difference(cache):
                cache[piece] = self._merged(piece)
            return b"".join([cache[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._bytes([text])[0]
        if "<|" not in text and _is_latin(text):
            return self._of_pieces(text)
        words = _BLANKS.split(text)
        cache = self.cache
        unknown = [w for w in set(words) if w not in cache]
        if unknown:
            self._make_room()
            self._learn([w for w in set(words) if w not in cache])
        return b"".join([cache[w] for w in words])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
