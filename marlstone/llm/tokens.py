"""Whole-text encoding with a ``tokenizers`` file, sped up by remembering the ids of space-separated chunks.

Byte-level BPE never merges across the boundary before a single space, so a text may be encoded chunk by chunk
wherever both neighbours of the space are not white space.  Texts with any other white space around a space are
encoded in one call, and so are texts that hold one of the tokenizer's added tokens, as these are cut out of a text
before anything else.  The ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks kept by one encoder, in two generations of half as many: about 200 bytes each.
CACHE_ENTRIES = 1_400_000
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: Symbols that never join a letter before them; an apostrophe can.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins byte-level BPE uses for the 256 bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.  ``drops_space``: the tokenizer's pre-tokenizer removes
    white space, so that every space is a boundary; else a chunk carries the space before it."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # Such tokens are looked for in the normal form, which isn't known before the text is encoded.
        self.all_whole = any(t.normalized for t in added)
        self.drops_space = self.tok.encode("a b", add_special_tokens=False).ids == [
            i for t in ("a", "b") for i in self.tok.encode(t, add_special_tokens=False).ids
        ]
        self.lowers = self.tok.encode("A", add_special_tokens=False).ids == self.tok.encode("a", add_special_tokens=False).ids
        self.model, self.alphabet = self.tok.model, byte_alphabet()
        self.entries = entries
        self.new: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}
        self.lead = "" if self.drops_space else " "
        self.blank = {"": "", " ": self.alphabet[32]}
        self.line = self.whole("\n")
        self.ends: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, s: str, lead: str) -> bytes:
        """One pre-token of letters in normal form."""
        s = self.blank[lead] + s if s.isascii() else (lead + s).encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _plain(self, chunk: str, lead: str) -> bytes | None:
        """Ids of letters, with symbols after them; None for other chunks."""
        word = chunk.lower() if self.lowers else chunk
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            return self._letters(word, lead)
        word = word.rstrip(SYMBOLS)
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            return self._letters(word, lead) + self._end(chunk[len(word) :])
        return None

    def _end(self, symbols: str) -> bytes:
        """Symbols after a letter: a pre-token of their own."""
        ids = self.ends.get(symbols)
        if ids is None:
            ids = self.whole(symbols)
            if len(self.ends) < 10_000:
                self.ends[symbols] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes | bool:
        """Ids of one chunk; False if it can't be told apart from its neighbours."""
        if not self.drops_space and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            return False
        if not chunk:
            return b""
        left, line, right = chunk.partition("\n")
        if line and left and right and not left[-1].isspace() and not right[0].isspace():
            # A line feed between other characters is a pre-token of its own, or dropped.
            rest = self._plain(right, "")
            return self._known(left) + self.line + (self.whole(right) if rest is None else rest)
        word = chunk.rstrip(SYMBOLS)
        # The lower case of a letter may end in a mark, which would join the symbols.
        if len(word) < len(chunk) and (word[-1:].lower() if self.lowers else word[-1:]).isalpha():
            return self._known(word) + self._end(chunk[len(word) :])
        ids = self._plain(chunk, self.lead)
        return self.whole(self.lead + chunk) if ids is None else ids

    def _known(self, chunk: str) -> bytes:
        ids = self.new.get(chunk)
        return self._missing(chunk) if ids is None else ids

    def _missing(self, chunk: str) -> bytes | bool:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self.new) >= self.entries // 2:
                self.old, self.new = self.new, {}
            self.new[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.all_whole or any(t in text for t in self.added):
            return self.whole(text)
        chunks = text.split(" ")
        first = b""
        if not self.drops_space:
            head = chunks.pop(0)
            if not head or head[-1].isspace() or not chunks:
                return self.whole(text)
            first = self.whole(head)
        found = list(map(self.new.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._missing(chunks[i])
        if False in found:
            return self.whole(text)
        return first + b"".join(found)


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """The encoder of a file.  A Python worker keeps the last one with what it remembers for its later tasks."""
    if (path, entries) not in _encoders:
        _encoders.clear()
        _encoders[path, entries] = ChunkEncoder(path, entries)
    return _encoders[path, entries]
