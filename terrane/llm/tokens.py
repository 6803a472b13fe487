"""Exact, cached use of the public byte-pair tokenizers.

Tokenizing a whole text by the library costs about a microsecond a character. Both vocabularies split a text into
pre-tokens that are encoded independently of each other, so the ids of a text are the joined ids of its pieces, and
each worker encodes a distinct piece once. Cuts are made only where the pre-tokenizer is certain to cut:

* byte style (``byte_bpe_50k``): before a single space. A run of white space is cut there too, but only runs of at
  most two characters, for which the outcome equals that of the pre-tokenizer; texts with longer runs go through the
  pre-token pattern itself.
* word style (``word_bpe_49k``): at any blank, tab or line end; white space is dropped by the vocabulary.

Pieces with characters outside the Latin and punctuation ranges are handed to the library as they are.
"""

from __future__ import annotations

import struct

import regex

from terrane.llm.memory import kept

#: Characters whose classes and case are alike in every Unicode version.
_PLAIN = regex.compile(r"[\x09\x0A\x0D\x20-\x7E¡-¬®-įı-ɏ‐-‧]*+")
_LAST_LATIN = "\u024F"
_LONG_SPACE = regex.compile(r"\s\s\s")
#: The pre-token patterns that the two vocabulary files state (fixed values).
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> dict[int, str]:
    """Byte to character of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """A dict that fills itself and is emptied when it has ``limit`` entries, so memory stays bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PieceEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``style``: "byte" or "word". Special-token strings in a text are ordinary text.
    """

    def __init__(self, path: str, style: str, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.style = style
        self.pieces = _Memo(self._piece, limit // 2)
        if style == "byte":
            self.first = _Memo(self._chunk, limit // 8)
            self.after_space = _Memo(lambda c: self._chunk(" " + c), limit)
        elif style == "word":
            self.after_space = _Memo(self._chunk, limit)
        else:
            raise ValueError(style)

    @staticmethod
    def _pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join(map(self.alphabet.__getitem__, piece.encode("utf-8")))
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        letters = chunk[1:] if self.style == "byte" and chunk[0] == " " else chunk
        if letters.isalpha() and max(letters) <= _LAST_LATIN and "İ" not in letters:
            return self.pieces[chunk if self.style == "byte" else chunk.lower()]
        if not _PLAIN.fullmatch(chunk):
            return self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if self.style == "byte":
            return b"".join([self.pieces[p] for p in _BYTE_PIECES.findall(chunk)])
        return b"".join([self.pieces[p] for p in _WORD_PIECES.findall(chunk.lower())])

    def encode(self, text: str) -> bytes:
        if self.style == "word":
            blanked = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
            return b"".join(map(self.after_space.__getitem__, blanked.split(" ")))
        # printable characters are no white space but the blank, so most texts are cleared without a pattern
        blanked = text.replace("\n", " ")
        if "   " in blanked or not blanked.isprintable() and _LONG_SPACE.search(text):
            if _PLAIN.fullmatch(text):
                return b"".join([self.pieces[p] for p in _BYTE_PIECES.findall(text)])
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.after_space.__getitem__, parts[1:]))


def encoder(path: str, style: str) -> PieceEncoder:
    """The worker's own encoder; its cache lives until the worker serves another operator."""
    # words repeat more than the byte style's pieces do, so a smaller memory serves them
    return kept(("encoder", path, style), lambda: PieceEncoder(path, style, 900_000 if style == "byte" else 300_000))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
