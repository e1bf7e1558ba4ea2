"""Byte-level BPE by lookup: texts are cut before every space that a non-space follows.

A pre-token of the vocabulary's own pattern never crosses such a cut, so a piece's ids do not
depend on its neighbours and can be kept in a cache. Texts with characters on which two regular
expression engines may differ, or with the vocabulary's special string, go to the tokenizer
library whole.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"

#: ASCII but the separators 1C-1F, Latin letters, and common typographic marks.
UNSAFE = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
SPACE_RUN = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r" (?=\S)")
LONGEST_KEPT = 64


def default_dir() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=4)
def library(folder: str):
    """The tokenizer whose ids count."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(folder, VOCABULARY))


@lru_cache(maxsize=4)
def piece_library(folder: str):
    """The same vocabulary as ranks; several times as fast on short pieces."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(dict):
    """Value of ``lead + piece`` by piece; misses are encoded, and kept up to ``limit`` entries."""

    def __init__(self, folder: str, lead: str, value, limit: int, frequent: dict | None = None):
        super().__init__(frequent or {})
        self.encode, self.lead, self.value = piece_library(folder).encode_ordinary, lead, value
        self.limit, self.frequent = limit + len(self), frequent or {}

    def __missing__(self, piece: str):
        found = self.value(self.encode(self.lead + piece))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[piece] = found
        return found


def split(text: str) -> list[str] | None:
    """Pieces of a text (all but the first lack their leading space); None: use the library."""
    if UNSAFE.search(text) or SPECIAL in text:
        return None
    return CUT.split(text) if SPACE_RUN.search(text) else text.split(" ")


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class IdEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, folder: str, limit: int = 300_000):
        self.folder = folder
        self.first, self.rest = Pieces(folder, "", as_bytes, 20_000), Pieces(folder, " ", as_bytes, limit)

    def __call__(self, text: str) -> bytes:
        parts = split(text)
        if parts is None:
            return as_bytes(library(self.folder).encode(text, add_special_tokens=False).ids)
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


class CountEncoder:
    """Texts to token counts; ``frequent`` is the shared first tier, the worker's caches the second."""

    def __init__(self, folder: str, frequent: dict[str, int], limit: int = 500_000):
        self.folder = folder
        self.first, self.rest = Pieces(folder, "", len, 20_000), Pieces(folder, " ", len, limit, frequent)

    def __call__(self, text: str) -> int:
        parts = split(text)
        if parts is None:
            return len(library(self.folder).encode(text, add_special_tokens=False).ids)
        return self.first[parts[0]] + sum(map(self.rest.__getitem__, parts[1:]))


@lru_cache(maxsize=2)
def id_encoder(folder: str) -> IdEncoder:
    """One per worker process."""
    return IdEncoder(folder)
