"""MD5 over many short keys at once: whole arrays of 32-bit words through the rounds.

A Catalyst md5 per base costs microseconds, most of them in hex and casts. Keys
here share what they have in common: `prefix|number`, for numbers from 1 on.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys worked on at a time: the arrays stay in the cache.
CELLS = 1 << 14
#: Bytes that one block of the digest has room for.
ROOM = 55


def head(key: bytes) -> int:
    """The first 32 bits of one digest."""
    return int.from_bytes(hashlib.md5(key).digest()[:4], "big")


def _first_words(m: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits of the digests of one-block messages; m has 16 words that broadcast to the shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    # The first word of the digest is what round 60 leaves in b.
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        np.add(f, a, out=f)
        np.add(f, m[g] + np.uint32(_K[i]), out=f)
        turn = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


def heads(prefixes: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For every prefix and each number i from 1 to its count, the first 32 bits of md5(prefix|i), one after another."""
    counts = np.asarray(counts, np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(bounds[-1]), np.uint32)
    sizes = np.array([len(p) for p in prefixes], np.int64)
    for size in np.unique(sizes[counts > 0]) if len(sizes) else ():
        own = np.flatnonzero((sizes == size) & (counts > 0))
        own = own[np.argsort(counts[own], kind="stable")]
        width = 1
        while len(own):
            first, last = 10 ** (width - 1), 10**width
            own = own[counts[own] >= first]
            if size + 1 + width > ROOM:
                for r in own.tolist():
                    for i in range(first, int(counts[r]) + 1):
                        out[bounds[r] + i - 1] = head(prefixes[r] + b"|" + str(i).encode())
                break
            at = 0
            while at < len(own):
                least = min(int(counts[own[at]]), last - 1) - first + 1
                rows = own[at : at + max(1, CELLS // least)]
                at += len(rows)
                most = min(int(counts[rows[-1]]), last - 1)
                for lo in range(first, most + 1, CELLS):
                    _fill(out, bounds, counts, prefixes, rows, int(size), width, lo, min(most, lo + CELLS - 1))
            width += 1
    return out


def _fill(out: np.ndarray, bounds: np.ndarray, counts: np.ndarray, prefixes: list[bytes], rows: np.ndarray, size: int, width: int, lo: int, hi: int) -> None:
    """The numbers lo to hi, all of one width, of some prefixes of one size."""
    n = np.arange(lo, hi + 1)
    left = np.zeros((len(rows), 64), np.uint8)
    left[:, :size] = np.frombuffer(b"".join(prefixes[r] for r in rows.tolist()), np.uint8).reshape(len(rows), size)
    left[:, size] = ord("|")
    right = np.zeros((len(n), 64), np.uint8)
    for k in range(width):
        right[:, size + 1 + k] = n // 10 ** (width - 1 - k) % 10 + 48
    right[:, size + 1 + width] = 0x80
    right[:, 56:58] = np.array([(size + 1 + width) * 8], "<u2").view(np.uint8)
    p, s = left.view("<u4"), right.view("<u4")
    words = []
    for w in range(16):
        inside, beyond = 4 * w <= size, 4 * w + 3 > size
        words.append(p[:, w, None] | s[None, :, w] if inside and beyond else p[:, w, None] if inside else s[None, :, w])
    got = _first_words(words, (len(rows), len(n)))
    wanted = n[None, :] <= counts[rows][:, None]
    out[(bounds[rows][:, None] + n[None, :] - 1)[wanted]] = got[wanted]
