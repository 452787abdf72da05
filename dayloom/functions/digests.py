"""md5 of many short keys at once, for work that draws in numpy what ``md5_bits`` draws in SQL."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of a key that still fits one block of md5.
SHORT = 55
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_WORDS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys that go through together: their arrays stay in the cache.
TOGETHER = 1 << 14


def _blocks(words: np.ndarray) -> np.ndarray:
    """Four big-endian words of the md5 of every block; ``words`` is 16 rows of little-endian ones."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += words[_WORDS[i]]
        np.left_shift(f, _TURNS[i], out=t)
        f >>= 32 - _TURNS[i]
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    return np.stack([(x + np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), _START)])


class Prefixes:
    """First parts of keys, to be followed by one ending or another."""

    def __init__(self, keys: list[bytes] | pa.StringArray, longest: int = 16):
        """``longest``: bytes that an ending may have. An Arrow column's bytes are taken as they lie."""
        if isinstance(keys, pa.StringArray):
            ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
            text = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
        else:
            ends = np.cumsum([0, *map(len, keys)])
            text = np.frombuffer(b"".join(keys), np.uint8)
        self.lengths = np.diff(ends)
        self.short = np.flatnonzero(self.lengths + longest <= SHORT)
        over = np.flatnonzero(self.lengths + longest > SHORT).tolist()
        self.long = [(i, text[ends[i] : ends[i + 1]].tobytes()) for i in over]
        lengths, starts = self.lengths[self.short], ends[self.short]
        self.block = np.zeros((len(lengths), 64), np.uint8)
        for j in range(int(lengths.max(initial=0))):
            some = np.flatnonzero(lengths > j)
            self.block[some, j] = text[starts[some] + j]
        self.at = np.arange(len(lengths)) * 64 + lengths

    def words(self, ending: bytes) -> np.ndarray:
        """Four 32-bit words of the md5 of every key with an ending, as rows."""
        out = np.empty((4, len(self.lengths)), np.uint32)
        flat, bits = self.block.reshape(-1), (self.lengths[self.short] + len(ending)) * 8
        for j, byte in enumerate(ending + b"\x80"):
            flat[self.at + j] = byte
        words = np.ascontiguousarray(self.block.view("<u4").T)
        for j in range(len(ending) + 1):
            flat[self.at + j] = 0
        words[14] = bits
        for start in range(0, len(self.short), TOGETHER):
            part = slice(start, start + TOGETHER)
            out[:, self.short[part]] = _blocks(np.ascontiguousarray(words[:, part]))
        for i, key in self.long:
            out[:, i] = np.frombuffer(hashlib.md5(key + ending, usedforsecurity=False).digest(), ">u4")
        return out


def md5_words(keys: list[bytes]) -> np.ndarray:
    """Four 32-bit words of the md5 of every key, as rows."""
    return Prefixes(keys, 0).words(b"")


@lru_cache(64)
def _laid(keys: tuple[bytes, ...], at: int, ended: bool) -> np.ndarray:
    """16 rows of words with every key from byte ``at`` on, and with what follows a key if it ends there.
    One panel's endings are the next one's."""
    block = np.zeros((len(keys), 64), np.uint8)
    for row, key in zip(block, keys):
        if at + len(key) <= SHORT:
            text = key + b"\x80" if ended else key
            row[at : at + len(text)] = np.frombuffer(text, np.uint8)
            if ended:
                row[56:60] = np.frombuffer(((at + len(key)) * 8).to_bytes(4, "little"), np.uint8)
    return np.ascontiguousarray(block.view("<u4").T)


def paired_words(firsts: list[bytes], endings: list[bytes], p: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Four words of the md5 of ``firsts[p] + endings[e]`` for every pair of places, as rows."""
    out = np.empty((4, len(p)), np.uint32)
    lengths, more = (np.fromiter(map(len, x), np.int64, len(x)) for x in (firsts, endings))
    begun, last = _laid(tuple(firsts), 0, ended=False), tuple(endings)
    for size in np.unique(lengths).tolist():
        ends = _laid(last, size, ended=True)
        mine = lengths[p] == size
        at = np.flatnonzero(mine & (more[e] + size <= SHORT))
        for start in range(0, len(at), TOGETHER):
            some = at[start : start + TOGETHER]
            out[:, some] = _blocks(begun[:, p[some]] | ends[:, e[some]])
        for i in np.flatnonzero(mine & (more[e] + size > SHORT)).tolist():
            digest = hashlib.md5(firsts[p[i]] + endings[e[i]], usedforsecurity=False).digest()
            out[:, i] = np.frombuffer(digest, ">u4")
    return out


def normals(words: np.ndarray) -> np.ndarray:
    """The four standard normal draws of every digest, as ``normal_from_md5`` has them."""
    out = np.empty(words.shape)
    for pair in (0, 2):
        size = np.sqrt(-2.0 * np.log((words[pair] + 1.0) / 4294967297.0))
        angle = 6.283185307179586 * (words[pair + 1] / 4294967296.0)
        out[pair], out[pair + 1] = size * np.cos(angle), size * np.sin(angle)
    return out
