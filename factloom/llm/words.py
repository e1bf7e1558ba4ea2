r"""Codes of the words of whole texts, all words of many texts at once: no step takes a word in Python.

A token is a run of ``\w`` or a run of what is neither that nor white space. Its code is the CRC-32 of its lower-case
UTF-8, after ``^`` if it is all in capitals; the code of its beginning that of the first five characters and ``*``.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np

SPACE = re.compile(r"\s")
#: Characters worked on at once, about; a longer text is cut at white space.
PIECE = 1 << 17
#: Texts in a group, at most.
GROUP = 1 << 12
#: Bytes up to which tokens go through the common loop.
LONG = 64
#: Classes of characters: white space is 0, the others flags.
WORD, SIGN, UPPER, CASED, ODD = 1, 2, 4, 8, 16
NO_BEGINNING = zlib.crc32(b"*")


def code(token: str) -> tuple[int, int]:
    """Code of one token and of its beginning."""
    shape, low = "^" if len(token) > 1 and token.isupper() else "", token.lower()
    return zlib.crc32((shape + low).encode()), zlib.crc32((shape + low[:5] + "*").encode()) if len(low) > 5 else NO_BEGINNING


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each character, and the steps of CRC-32 by byte.

    Characters whose lower case depends on their neighbours or is longer are ODD.
    """
    lower = np.arange(0x110000, dtype=np.uint32)
    every = lower.tobytes().decode("utf-32-le", "surrogatepass")
    classes = np.zeros(len(every), dtype=np.uint8)
    for pattern, flag in ((r"\w+", WORD), (r"[^\w\s]+", SIGN)):
        for m in re.finditer(pattern, every):
            classes[m.start() : m.end()] = flag
    # all characters with case lie in the first two planes
    for i, c in enumerate(every[:0x20000]):
        if c.isupper():
            classes[i] |= UPPER
        elif c.islower() or c.istitle():
            classes[i] |= CASED
        if (low := c.lower()) != c:
            if len(low) == 1:
                lower[i] = ord(low)
            else:
                classes[i] |= ODD
    classes[ord("Σ")] |= ODD
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ 0xEDB88320, steps >> 1).astype(np.uint32)
    return classes, lower, steps


def _crc(raw: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC's state after ``length`` (below 256) bytes of ``raw`` from each ``start``."""
    steps = _tables()[2]
    order = np.argsort(length, kind="stable")[::-1]
    at, now = start[order], state[order]
    # how many are longer than 0, 1, 2, ... bytes
    for n in len(length) - np.bincount(length)[:-1].cumsum():
        part = now[:n]
        part[:] = steps[(part ^ raw[at[:n]]) & 255] ^ part >> 8
        at[:n] += 1
    found = np.empty_like(now)
    found[order] = now
    return found


def _coded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``text``, code and code of the beginning of each token."""
    classes, lower, steps = _tables()
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = classes[chars]
    runs = kinds & (WORD | SIGN)
    # where the class changes a run begins, the first one at 0
    bounds = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, dtype=np.int64)
    tokens = runs[bounds] != 0
    start, end = bounds[tokens], np.append(bounds[1:], len(runs))[tokens]
    if not len(start):
        return start, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    flags = np.bitwise_or.reduceat(kinds, bounds)[tokens]
    chars = lower[chars]
    if text.isascii():
        raw, at = chars.astype(np.uint8), None
    else:
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        at = np.concatenate([[0], (1 + (chars >= 0x80).view(np.uint8) + (chars >= 0x800) + (chars >= 0x10000)).cumsum(dtype=np.int64)])
    head = np.minimum(start + 5, end)
    first, middle, last = (start, head, end) if at is None else (at[start], at[head], at[end])
    odd = (flags & ODD != 0) | (last - first > LONG)
    tail = np.where(odd, 0, last - middle).astype(np.uint8)
    capitals = (flags & (UPPER | CASED) == UPPER) & (end - start > 1)
    none, shape = (np.uint32(~zlib.crc32(s) & 0xFFFFFFFF) for s in (b"", b"^"))
    begun = _crc(raw, first, (middle - first).astype(np.uint8), np.where(capitals, shape, none))
    stem = np.where(end > head, ~(steps[(begun ^ ord("*")) & 255] ^ begun >> 8), np.uint32(NO_BEGINNING))
    one = ~_crc(raw, middle, tail, begun)
    for i in np.flatnonzero(odd):
        one[i], stem[i] = code(text[start[i] : end[i]])
    return start, one, stem


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``PIECE`` characters that cut no token."""
    at = 0
    while len(text) - at > PIECE and (m := SPACE.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def coded(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of neighbouring texts: their number, and of each token its text in the group, its code and its beginning's."""
    at = 0
    while at < len(texts):
        size, until = len(texts[at] or ""), at + 1
        while until < min(len(texts), at + GROUP) and size + len(texts[until] or "") < PIECE:
            size, until = size + len(texts[until] or "") + 1, until + 1
        group = [t or "" for t in texts[at:until]]
        if len(group) > 1:
            start, one, stem = _coded("\n".join(group))
            owner = np.searchsorted(np.cumsum([len(t) + 1 for t in group]), start, side="right")
        else:
            one, stem = (np.concatenate(c) for c in list(zip(*map(_coded, _pieces(group[0]))))[1:])
            owner = np.zeros(len(one), dtype=np.int64)
        yield len(group), owner, one, stem
        at = until
