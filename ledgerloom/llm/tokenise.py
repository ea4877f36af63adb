"""Token ids by the tokenizers library, with a bounded cache of whole pieces.

Both public BPE files split a text so that the cut before a space that stands between two other characters is
always a cut between two pre-tokens. So a text is cut at such spaces, each distinct piece is encoded once per
worker, and a text's ids are its pieces' ids joined. A piece of plain Latin letters goes straight to the
library's BPE model; whatever could be touched by other rules (special tokens, rare white space, normal forms)
goes through the library's whole `encode`. Texts in which a cut could go wrong are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import regex

#: Pieces in a generation of a worker's cache, some 200 bytes each. When a generation is full it becomes the older one, from
#: which pieces that are met again are taken over; the one before is dropped.
CACHE_PIECES = 400_000
#: A space with white space or the text's end on both sides: a cut there could split a run of white space.
DOUBTFUL = re.compile(r"\s(?: (?=\s)| \Z)|\A (?=\s|\Z)")
#: What such a text holds if it is ASCII and doesn't begin with a space: found faster than the pattern.
BEFORE_SPACE = tuple(chr(c) + " " for c in (*range(9, 14), *range(28, 33)))
#: What the fast way takes: no special token, no rare space, no character that normal forms or casing by context touch.
PLAIN = re.compile(r"[^\x00-\x09\x0b-\x1f\x7f-\xa0ɐ-\U0010ffff]*\Z")
#: The patterns by which the two files split a text (they stand in the files themselves).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """Piece -> the ids of `lead` + piece as little-endian unsigned 32-bit integers; a missing piece is encoded."""

    def __init__(self, path: str, lead: str = "", literal: bool = False, most: int = CACHE_PIECES):
        """With `literal`, strings of special tokens in a text are ordinary text; `most` pieces make a generation."""
        self.lead, self.most = lead, most
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = literal
        with open(path) as f:
            spec = json.load(f)
        self.lower = bool(spec["normalizer"])
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.lower else BYTE_PATTERN)
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(max(self.library.get_vocab(with_added_tokens=True).values()) + 1)]
        self.symbols = byte_symbols()
        self.older: dict[str, bytes] = {}
        self.points = {c: self.plain(c) for c in ".,"}
        self.after_space = None if lead or self.lower else Pieces(path, " ", literal, most)

    def mapped(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode()])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text that the file's pattern and the library's model handle by themselves."""
        ids: list[bytes] = []
        low = text.lower() if self.lower else text
        for word in (low,) if low.isalpha() or low[:1] == " " and low[1:].isalpha() else self.word.findall(low):
            if word[0] == " " and word.isascii():
                word = "\u0120" + word[1:] if word.isprintable() else self.mapped(word)
            elif not word.isascii() or not word.isprintable():
                word = self.mapped(word)
            ids += [self.packed[t.id] for t in self.tokenize(word)]
        return b"".join(ids)

    def letters(self, word: str) -> bytes:
        """Ids of a piece of ASCII letters, which is one word."""
        word = word.lower() if self.lower else "\u0120" + word if self.lead else word
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(word)])

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is not None:
            pass
        elif key.isascii() and key.isalpha():
            ids = self.letters(key)
        else:
            piece = self.lead + key
            if key[-1:] in self.points and (key[:-1].lower() if self.lower else key[:-1]).isalpha() and (key.isascii() or PLAIN.match(key)):
                ids = self[key[:-1]] + self.points[key[-1]]  # a letter and a point are never one word
            elif (piece.isascii() and piece.isprintable() or PLAIN.match(piece)) and "<|" not in piece:
                ids = self.plain(piece)
            else:
                ids = self.whole(piece)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) in the library's order, as bytes."""
        if not text:
            return b""
        if self.lower:
            text = text.replace("\n", " ")
            return b"".join(map(self.__getitem__, text.split(" ")))
        if (not text.isascii() or text[0] == " " or any(map(text.__contains__, BEFORE_SPACE))) and DOUBTFUL.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.after_space.__getitem__, rest))


@lru_cache(4)
def pieces(path: str, literal: bool = False, most: int = CACHE_PIECES) -> Pieces:
    """One cache per worker process and tokenizer file."""
    return Pieces(path, literal=literal, most=most)


@lru_cache(8)
def id_width(path: str, *more: int) -> int:
    """Bytes that an id of the tokenizer, or one of `more`, needs in a file: 2 or 4."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()
    return 2 if max(max(known, default=0), *more, 0) < 1 << 16 else 4


def narrowed(ids: bytes, width: int) -> bytes:
    """Little-endian ids of 4 bytes as ids of `width` bytes; an id that doesn't fit is an error."""
    if width == 4:
        return ids
    every = np.frombuffer(ids, "<u4")
    if len(every) and every.max() >= 1 << 8 * width:
        raise ValueError(f"id {every.max()} needs more than {width} bytes")
    return every.astype(f"<u{width}").tobytes()
