"""Token ids of texts, by a tokenizer file of the tokenizers library.

A byte-level pre-tokenizer never lets a token reach from a character that is no
white space into white space. So a text may be cut at each such place, and a
piece has the same ids wherever it stands: the ids of its words are asked of
the library once and then remembered, up to a bound. Where that is not sure
(white space on whose kind regex engines differ, other alphabets, special
tokens, another kind of tokenizer), the library encodes the piece or the whole
text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .shared import remember

PIECE = re.compile(r"\s*\S+|\s+")
# White space on whose kind the regex engines may differ.
OTHER_SPACE = re.compile(r"[^\S \n\t\r\v\f]")
# The byte-level pre-tokenizer's published pattern, for characters up to U+024F.
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+"
    rf"| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+"
)
PLAIN = re.compile(r"[\x00-ɏ]*\Z")
# A piece that is one word of the pattern.
SINGLE = re.compile(rf" ?[{LETTER}]+\Z")
REMEMBERED = 400_000


class _EncodeWhole(Exception):
    """The text may not be cut."""


def byte_characters() -> str:
    """The character a byte-level vocabulary writes for each byte: a printable
    one for itself, the others in their order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


def _may_cut(tokenizer) -> bool:
    plan = json.loads(tokenizer.to_str())
    before = plan["pre_tokenizer"] or {}
    model = plan["model"]
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", False)
        and not before.get("add_prefix_space", True)
        and plan["normalizer"] is None
        and model["type"] == "BPE"
        and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in plan["added_tokens"])
    )


class _Pieces(dict):
    """Ids of a piece of text between two places where it may be cut, and of the words
    that the pre-tokenizer makes of it; a word has the same ids on its own."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, 2 * limit
        self.tokenize = tokenizer.model.tokenize
        self.table = dict(enumerate(byte_characters()))

    def word(self, word: str) -> bytes:
        """Ids of one word, by the library's model."""
        if word.isascii() and word.isprintable():  # its bytes are shown as themselves, but for the space
            shown = word.replace(" ", self.table[0x20])
        else:
            shown = word.encode().decode("latin-1").translate(self.table)
        return array("I", [token.id for token in self.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if SINGLE.match(piece):
            ids = self.word(piece)
        elif OTHER_SPACE.search(piece):
            raise _EncodeWhole
        elif "<|" not in piece and (piece.isascii() or PLAIN.match(piece)):
            words = WORD.findall(piece)
            ids = b"".join(map(self.__getitem__, words)) if len(words) > 1 else self.word(piece)
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False)
            ids = array("I", found.ids).tobytes()
        if len(piece) < 100:  # longer ones do not return and would fill the memory
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, special tokens not added."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer, remembered) if _may_cut(self.tokenizer) else None

    def one(self, text: str) -> bytes:
        if self.pieces is not None:
            try:
                return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
            except _EncodeWhole:
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(text) for text in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    remember(_ENCODERS[path].pieces)
    return _ENCODERS[path]
