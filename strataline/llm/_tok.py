"""Exact and fast use of public tokenizers: split texts into words, encode each distinct word once.

Two shapes of tokenizer files are split here: byte-level (a pattern that keeps
white space) and lower-case word BPE (a pattern that drops it). A word here is
a run between white space, with the white space character before it where the
pattern keeps that; it is cut into the pattern's pieces only when it is new.
Texts that hold an added token, or characters where the rules of two Unicode
libraries could differ, go to the tokenizers library itself, as do all texts of
files of any other shape. The results are those of the library in every case.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from functools import cached_property

import regex

#: Within PLAIN, white space and numbers other than digits, as the tokenizers library's patterns have them. (fixed values)
WHITE, SIGNS = r"\x09-\x0D\x20\x85\xA0", "\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
LETTERS, OTHERS = rf"[^\W\d_{SIGNS}]+", rf"(?:[^\w{WHITE}]|_)+"
SHORT = "'(?:s|t|re|ve|m|ll|d)"
BYTE_LEVEL = re.compile(rf" ?{LETTERS}|{SHORT}| ?[\d{SIGNS}]+| ?{OTHERS}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD_LEVEL = re.compile(rf"{LETTERS}|[\d{SIGNS}]|{SHORT}|{OTHERS}")
#: Letters and signs whose properties, composition and case are the same in all Unicode versions.
PLAIN = regex.compile(r"[\x00-\u024F\u2010-\u2027]*+\Z")
#: White space in runs, or of other kinds than space and line feed: the words depend on what stands around.
KNOTS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\x00")
#: str.split() takes these for white space, the patterns don't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def spec(path: str) -> str:
    """The tokenizer file's JSON, read on the driver; at most 64 MB, so that it can be broadcast."""
    with open(path, encoding="utf-8") as f:
        out = f.read()
    if len(out) > 64 << 20:
        raise ValueError(f"{path} is too large for a tokenizer file")
    return out


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False).ids`` does, without truncation or padding.

    ids are given as bytes: unsigned integers of 2 or 4 bytes, in the machine's order.
    """

    def __init__(self, text: str, width: int = 4, cache: int = 1_600_000):
        self.text = text
        d = json.loads(text)
        self.added = [a["content"] for a in d.get("added_tokens", [])]
        self.code = {2: "H", 4: "I"}[width]
        pre, norm = d.get("pre_tokenizer") or {}, d.get("normalizer")
        kinds = [x["type"] for x in pre.get("pretokenizers", [])]
        self.kind = ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind, self.pattern = "byte", BYTE_LEVEL
        elif kinds == ["Split", "ByteLevel"] and norm and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.kind, self.pattern = "word", WORD_LEVEL
        self.signs = byte_signs()
        self.words_seen, self.pieces_seen = _Seen(self._part), _Seen(self._piece)
        self.most = cache

    @cached_property
    def tok(self):
        """The library's tokenizer, loaded where it is first needed."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.text)
        out.no_truncation()
        out.no_padding()
        return out

    @property
    def size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def _plain(self, text: str) -> bool:
        return bool(self.kind) and not any(a in text for a in self.added) and (text.isascii() or PLAIN.match(text) is not None)

    def words(self, text: str) -> list[str]:
        """Words whose encodings, one after the other, are the text's; the text itself where only the library can tell."""
        if not self._plain(text):
            return [text]
        if self.kind == "word":
            return [text] if any(x in text for x in SEPARATORS) else text.lower().split()
        if any(x in text for x in KNOTS):
            return self.pattern.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def encode_words(self, words: Iterable[str]) -> list[bytes]:
        """The ids of each word."""
        if len(self.pieces_seen) > self.most // 4:
            self.pieces_seen.clear()
        get, find, low = self.pieces_seen.__getitem__, self.pattern.findall if self.kind else None, self.kind == "word"
        out = []
        for w in words:
            if self._plain(w):
                out.append(b"".join(map(get, find(w.lower() if low else w))))
            else:
                out.append(self._ids(self.tok.encode(w, add_special_tokens=False).ids))
        return out

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of one of the pattern's pieces; in printable ASCII every byte is its own sign."""
        signs = piece if self.kind == "word" and piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.signs)
        return self._ids([x.id for x in self.tok.model.tokenize(signs)])

    def _part(self, word: str) -> bytes:
        """The ids of a word of a plain text."""
        return b"".join(map(self.pieces_seen.__getitem__, self.pattern.findall(word)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty. Words seen lately are not encoded again."""
        for seen, most in ((self.words_seen, self.most), (self.pieces_seen, self.most // 4)):
            if len(seen) > most:
                seen.clear()
        get, out = self.words_seen.__getitem__, []
        for x in texts:
            w = self.words(x or "")
            # a text that is its only word may be one for the library, which _part is not
            out.append(b"".join(map(get, w)) if len(w) > 1 else self.encode_words(w)[0] if w else b"")
        return out


class _Seen(dict):
    """Ids by word; those of a word that is missing are made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.make(word)
        return out


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(text: str, width: int = 4) -> WordEncoder:
    """One encoder per worker process and tokenizer."""
    if (text, width) not in _encoders:
        _encoders.clear()
        _encoders[text, width] = WordEncoder(text, width)
    return _encoders[text, width]
