"""Token ids of whole texts by a public vocabulary, exact and with a cache by word.

The vocabulary's pre-tokeniser never joins what white space separates, so a text's ids are those of its
chunks between white space in turn. Each worker keeps the ids of chunks and of pre-tokens it has met; the
library encodes only new ones. A test holds this against the library's ids of whole texts.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import regex

#: Entries a worker keeps at most; beyond, new chunks are encoded each time. This bounds memory, not results.
MOST_CHUNKS, MOST_PIECES = 400_000, 100_000
#: White space of the library that Python's split doesn't have the same way is left to the library.
_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: the vocabulary's own pre-tokeniser pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile("[a-z]+").fullmatch


#: How the vocabulary writes bytes as characters: visible ones stand for themselves, the others for 256 and on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = dict(zip(_SEEN, _SEEN)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SEEN))}
#: Marks that may end a chunk and never begin a contraction.
_TAIL = ".,;:!?*#$%&()[]{}+=/_~^@-"


class _Pieces(dict):
    """Ids of single pre-tokens: the library's own merges, without its normaliser and splitter, which have nothing left to do."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        seen = piece if _PLAIN(piece) else piece.encode().decode("latin-1").translate(_BYTE)
        got = array("H", [t.id for t in self.tokenize(seen)]).tobytes()
        if len(self) < MOST_PIECES:
            self[piece] = got
        return got


class _Chunks(dict):
    def __init__(self, library):
        self.library, self.pieces = library, _Pieces(library.model)

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk or "Σ" in chunk:  # special tokens; a letter whose lower case depends on its neighbours
            got = array("H", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
            body = text.rstrip(_TAIL)
            if body.isalpha():
                got = self.pieces[body]
                if len(body) < len(text):
                    got += self.pieces[text[len(body) :]]
            else:
                got = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        if len(self) < MOST_CHUNKS and len(chunk) < 64:
            self[chunk] = got
        return got


@cache
def _chunks(path: str) -> _Chunks:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    if library.get_vocab_size() > 1 << 16:
        raise ValueError("this encoder holds ids as 16 bits")
    if sys.byteorder != "little":
        raise ValueError("this encoder needs a little-endian machine")
    return _Chunks(library)


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of text as little-endian 16-bit integers; null is the empty text."""
    known = _chunks(path)
    if not text:
        return np.empty(0, "<u2")
    if _ODD.search(text):
        return np.array(known.library.encode(text, add_special_tokens=False).ids, "<u2")
    return np.frombuffer(b"".join(map(known.__getitem__, text.split())), "<u2")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
