"""Token ids of whole texts by a public tokenizer file, with a cache of the pieces between blanks.

Both kinds of tokenizer below cut a text into pre-tokens by a pattern that never joins what a blank
separates (a byte-level piece may start with one space). So a text's ids are the ids of its pieces in
a row, and each distinct piece is encoded once by the tokenizers library and then looked up. Pieces of plain letters are cut here, by the
same pattern, and their parts go to the library's model."""

from __future__ import annotations

import os
import re
import struct

import regex

from .shared import claim

#: Characters that Python and the tokenizers' patterns don't both see as blanks; such texts are encoded whole.
_ODD = "\x1c\x1d\x1e\x1f\x85\u1680\u180e\u200b\u2060\ufeff"
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: How the two kinds of tokenizer cut a piece into pre-tokens (fixed values, the files' own patterns).
_CUT = {
    True: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    False: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
}
#: The same for ASCII pieces, which are most.
_ASCII = {
    True: re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"),
    False: re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"),
}
#: Pieces of these characters are their own normal form, and their letters have the same lower case in Python as in the library.
_PLAIN = regex.compile("[ !-~\xa1-\xac\xae-\u012f\u0131-\u01c3\u0400-\u0481\u048a-\u04ff]*")


def _letters() -> dict[int, str]:
    """The byte-level spelling: printable bytes are themselves, the others follow from U+0100 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


_LETTERS = _letters()


class _Pieces(dict):
    """Ids of pieces, found by ``make`` when first asked for. Holds the pieces of two spans of ``most`` new ones, so those often used stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """``encode(texts)`` gives each text's ids as bytes: little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # a byte-level pre-tokenizer that applies the pattern itself keeps blanks as ids; the other kind drops them
        self.keeps_blanks = "use_regex=True" in repr(self.tok.pre_tokenizer)
        self.lowers = "Lowercase" in repr(self.tok.normalizer)
        self.cut, self.cut_ascii = _CUT[self.keeps_blanks].findall, _ASCII[self.keeps_blanks].findall
        self.tokenize = self.tok.model.tokenize
        self.pieces, self.parts = _Pieces(self._piece, most), _Pieces(self._part, most)

    def _whole(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids := self.tok.encode(text, add_special_tokens=False).ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        if not (part.isascii() and part.isalnum()):
            part = part.encode("utf-8").decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            cut = self.cut_ascii
        elif _PLAIN.fullmatch(piece):
            cut = self.cut
        else:
            return self._whole(piece)
        return b"".join(map(self.parts.__getitem__, cut(piece.lower() if self.lowers else piece)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = _PIECES.findall if self.keeps_blanks else str.split
        self.pieces.turn()
        self.parts.turn()
        get = self.pieces.__getitem__
        return [self._whole(t) if any(c in t for c in _ODD) else b"".join(map(get, cut(t))) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of that file."""
    claim("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
