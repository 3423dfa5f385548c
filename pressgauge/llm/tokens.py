"""Token ids of whole texts, by the tokenizers library, with a bounded cache of distinct words.

A byte-pair tokenizer first splits a text into words by a fixed pattern, then merges inside each word. Equal words give
equal ids, so each distinct word goes through the library's model once per worker and a text is the joined ids of its
words. Texts with characters outside the Latin range below, and texts that hold the string of an added token, are handed
to the library whole, in its default setting.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

# The letters, digits and spaces below U+0250, and the two split patterns over them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼½¾"
SPACES = "\\t-\\r \\x85\\xa0"
BYTE_SPLIT = re.compile(f" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{DIGITS}]+"
                        f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_SPLIT = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:[stmd]|re|ve|ll)|[^{SPACES}{LETTERS}{DIGITS}]+")
# Anything else, control characters that the libraries' white-space classes may treat differently, and the dotted I.
OUTSIDE = re.compile("[^\x00-\x1b\x20-įı-ɏ]")
CACHE_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return table


class Words(dict):
    """Ids of distinct words; a missing word goes through the model. Emptied when full."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = array("H", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """``ids(text)`` returns the ids as unsigned 16-bit integers in bytes, least byte first."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16 or sys.byteorder != "little":
            raise ValueError("ids must fit 16 bits, least byte first")
        self.lower = bool(spec.get("normalizer"))
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        # In either case: the library may look for them before or after it lower-cases a text.
        self.special = re.compile("|".join(added), re.I).search if added else lambda text: None
        self.split = (WORD_SPLIT if self.lower else BYTE_SPLIT).findall
        self.of_word = Words(self.whole.model).__getitem__

    def ids(self, text: str) -> bytes:
        if OUTSIDE.search(text) or self.special(text):
            return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.of_word, self.split(text.lower() if self.lower else text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
