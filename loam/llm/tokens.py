"""Exact token ids by word: a tokenizer that never joins across white space gives each white-space run's ids once."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from loam.llm.common import worker_cache

#: A worker's cache holds at most twice this many words: those met lately, and those of the time before.
CACHE_WORDS = 200_000
#: Longer words, in bytes, are encoded each time, so that the words kept bound the cache's memory too.
LONGEST = 64

_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow U+0100.
BYTE_LETTERS = {b: b for b in _shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_shown))}
#: What the vocabulary's own pattern finds in lower-case ASCII. Fixed values.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-~]+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    """The installed vocabulary file of that name; a path parameter elsewhere replaces it."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Ids, as bytes, of the words met lately; a new word is looked up among those of the time before, else encoded.

    When it is full it becomes the time before, so that words still in use are never all forgotten at once.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.merges, self.before = tokenizer, tokenizer.model, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) > LONGEST:
            return ids
        if len(self) >= CACHE_WORDS:
            self.before = {}  # never three times of words at once
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encode(self, word: bytes) -> bytes:
        """Plain pieces go straight to the merge table, the tokenizer's whole chain serves all other words."""
        if _PLAIN.fullmatch(word) and b"<|" not in word:
            pieces = _PIECE.findall(word.lower())
            return self._merge(pieces[0].decode()) if pieces == [word] else b"".join(map(self.__getitem__, pieces))
        text = word.decode()
        stem = text.rstrip(".,;:!?#*$%&")
        if stem.isalpha() and max(stem) < "ɐ" and "İ" not in stem:
            low = stem.lower()
            return self._merge(low) if low == text else self[low.encode()] + (self[text[len(stem) :].encode()] if len(stem) < len(text) else b"")
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()


class WordTokenizer:
    """``ids(text)`` equals encoding the whole text with ``word_bpe_49k.json``.

    That tokenizer drops white space before it merges, so each run between ASCII white space has ids of its own, and
    most runs of a corpus repeat: each is encoded once and kept for a while.
    """

    def __init__(self, path: str) -> None:
        self.known = _Ids(Tokenizer.from_file(path))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, (text or "").encode("utf-8", "replace").split())), "<u4")


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between batches and tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_cache(path, lambda: WordTokenizer(path))
