"""Words as decontamination and resampling take them: A-Z lower-cased, then runs of digits, a-z and
characters beyond ASCII. Every delimiter is one byte of UTF-8, so whole texts are cut as bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of text cut into words at a time, so that a very long text is never a list of all its words.
PIECE = 1 << 20


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``PIECE`` bytes; no word is split."""
    data, at = (text or b"").lower(), 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield WORDS.findall(data, at, end)
        at = end


IS_WORD = np.array([bool(WORDS.fullmatch(bytes([b]))) for b in range(256)])
#: The low n bytes of eight.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start and end."""
    inside = IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys among the distinct ones, and a place of each distinct one."""
    _, place, ranks = np.unique(keys, return_index=True, return_inverse=True)
    return ranks, place


def coded(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Start of each word of lower-cased bytes, a code for each, and the words by code.

    Words of up to 16 bytes are compared as one or two integers, longer ones as bytes."""
    starts, ends = boundaries(data)
    size = ends - starts
    padded = data + bytes(16)
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    codes, words = np.empty(len(starts), np.int64), []

    def told(mine: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> None:
        codes[mine] = ranks + len(words)
        at = mine[place]
        words.extend(data[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist()))

    low = eight[starts] & LOW_BYTES[np.minimum(size, 8)]
    short, middle, long = (np.flatnonzero(m) for m in (size <= 8, (size > 8) & (size <= 16), size > 16))
    told(short, *_ranks(low[short]))
    high = eight[starts[middle] + 8] & LOW_BYTES[size[middle] - 8]
    first, second = _ranks(low[middle])[0], _ranks(high)[0]
    told(middle, *_ranks(first * (len(middle) + 1) + second))
    known: dict[bytes, int] = {}
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        codes[i] = len(words) + known.setdefault(data[a:b], len(known))
    return starts, codes, words + list(known)
