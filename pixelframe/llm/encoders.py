"""Whole-text encoding with a public tokenizer, remembering the pieces that recur.

The vocabularies split a text into pre-tokens, and a pre-token's ids do not
depend on its neighbours.  None spans the border between white space and what
follows it, so a text is first cut there into chunks; chunks recur, and most
are found among the known ones.  An unknown chunk is cut into pre-tokens, and
an unknown pre-token is encoded by the library's model.  Chunks with characters
outside the Latin blocks are encoded by the whole library, and so are texts
with a character on which Python and the library may disagree about white
space, so that nothing depends on versions of Unicode.
"""

from __future__ import annotations

import os
import re
from array import array

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

from .common import FORGETS  # noqa: E402

ODD = re.compile("[\x00\x1c-\x1f\x85᠎​⁠﻿]")
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
LATIN = re.compile("[ !-~¡-¬®-įı-ɏ]+")
MARKS = ".,;:!?"
KNOWN = 800_000  # chunks that a worker remembers, and three quarters as many pre-tokens

# fixed values: the pre-token patterns of the two vocabularies, and the byte alphabet of byte-level BPE
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, int]:
    """Bytes that print stand for themselves; the others take the code points from 256 on."""
    rest = [b for b in range(256) if b not in PRINTED]
    return {b: b for b in PRINTED} | {b: 256 + k for k, b in enumerate(rest)}


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    spaces: True where white space is part of the ids (byte-level
    vocabularies); False where the vocabulary drops it and lower-cases.
    """

    def __init__(self, path: str, spaces: bool, most: int = KNOWN):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaces = spaces
        self.split = SPACED.findall if spaces else str.split
        self.pattern = BYTE_PARTS if spaces else WORD_PARTS
        self.alphabet = byte_alphabet()
        self.space = chr(self.alphabet[32])  # printed ASCII stands for itself
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def tokenized(self, part: str) -> bytes:
        spelled = part.replace(" ", self.space) if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a pre-token that is no known part; as a chunk of its own it may be known."""
        ids = self.known.get(part)
        if ids is None:
            ids = self.parts[part] = self.tokenized(part)
        return ids

    def cut(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a chunk; None where the whole library must decide."""
        if not self.spaces:
            chunk = chunk.lower()
        word = chunk.rstrip(MARKS)
        letters = word[1:] if self.spaces and word[:1] == " " else word
        if letters.isalpha() and (letters.isascii() or LATIN.fullmatch(letters)):  # nearly all: a word and marks after it
            return [word, chunk[len(word) :]] if len(word) < len(chunk) else [word]
        return self.pattern.findall(chunk) if LATIN.fullmatch(chunk) and not chunk.isspace() else None

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and (chunk[1:] if self.spaces and chunk[:1] == " " else chunk).isalpha():  # a plain word is one pre-token
            part = chunk if self.spaces else chunk.lower()
            ids = self.parts.get(part)
            if ids is None:
                ids = self.tokenized(part) if part == chunk else self.part(part)
            self.known[chunk] = ids
            return ids
        parts = self.cut(chunk)
        if parts is None:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            ready = self.parts.get
            ids = b"".join([ready(x) or self.part(x) for x in parts])
        self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > self.most:
            self.known.clear()
        if 4 * len(self.parts) > 3 * self.most:
            self.parts.clear()
        chunks, ready = self.split(text), self.known.get
        found = list(map(ready, chunks))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = ready(chunks[at]) or self.chunk(chunks[at])
        return b"".join(found)


_OPEN: dict[tuple[str, bool], ChunkEncoder] = {}
FORGETS.append(_OPEN.clear)


def encoder(path: str, spaces: bool, most: int = KNOWN) -> ChunkEncoder:
    """One encoder for each vocabulary and worker process; most: chunks that it remembers."""
    if (path, spaces) not in _OPEN:
        _OPEN[path, spaces] = ChunkEncoder(path, spaces)
    _OPEN[path, spaces].most = most
    return _OPEN[path, spaces]
