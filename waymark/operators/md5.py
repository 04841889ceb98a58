"""First words of MD5 digests of many short texts at once, by array steps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Texts that are digested at once: their words stay in a processor's cache.
ROWS = 4_096
#: Bytes of a text that fit into one block.
ONE_BLOCK = 55
_ADDED = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first(words: np.ndarray) -> np.ndarray:
    """The first word of each digest, its bytes from the left, of blocks given as 16 arrays of words."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += words[at]
        f += np.uint32(_ADDED[i])
        turn = _TURNS[i // 16][i % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        high |= f
        high += b
        a, d, c, b = d, c, b, high
    return (a + np.uint32(_START[0])).byteswap()


def first_words(prefixes: Sequence[str], keys: Sequence[str | None]) -> Iterator[np.ndarray]:
    """For each prefix the first 32 bits of the MD5 of ``prefix:key`` for all keys; of the prefix alone where a key is null."""
    texts = [b"" if k is None else b":" + k.encode() for k in keys]
    size = np.array([len(k) for k in texts], np.int64)
    width = int(size.max(initial=0))
    held = None  # blocks, made anew where a prefix is longer
    for prefix in prefixes:
        start = prefix.encode()
        n = len(start)
        out = np.empty(len(texts), np.uint32)
        fits = size + n <= ONE_BLOCK
        if width + n > ONE_BLOCK:
            for i in np.flatnonzero(~fits):
                out[i] = int.from_bytes(hashlib.md5(start + texts[i]).digest()[:4])
        short = np.flatnonzero(fits)
        if len(short):
            if held is None or held[1] != n:
                held = (_blocks([texts[i] for i in short], size[short], n), n)
            front = np.frombuffer(start, np.uint8)
            for first, block in zip(range(0, len(short), ROWS), held[0]):
                block[:, :n] = front
                words = np.ascontiguousarray(block.view("<u4").T)
                out[short[first : first + ROWS]] = _first(words)
        yield out


def _blocks(texts: list[bytes], size: np.ndarray, front: int) -> list[np.ndarray]:
    """Padded blocks of texts that ``front`` bytes go before, by ``ROWS``."""
    width = int(size.max())
    flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, front : front + width] = flat
    out[np.arange(len(texts)), front + size] = 0x80
    out[:, 56:64] = ((size + front) * 8).astype("<u8")[:, None].view(np.uint8)
    return [out[i : i + ROWS] for i in range(0, len(texts), ROWS)]
