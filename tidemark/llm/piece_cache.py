"""Codes of texts from the codes of their pieces, where each distinct piece is encoded once and then held."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from . import memory

LIMIT = 80_000_000  # bytes of the arrays of a cache
AT_ONCE = 1 << 20  # parts that are gathered at once


class PieceCache:
    """Holds the codes of pieces in a few arrays: 128-bit hashes, an open-addressing table over them, and codes.

    No piece is an object of its own, so a million take some 50 MB and go in one go. When LIMIT is reached, all go;
    frequent ones are soon back.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self) -> None:
        self.count, self.used = 0, 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys, self.ends, self.codes = np.empty((1 << 10, 2), np.uint64), np.zeros((1 << 10) + 1, np.int64), np.empty(1 << 14, np.uint8)

    @property
    def size(self) -> int:
        return self.slots.nbytes + self.keys.nbytes + self.ends.nbytes + self.codes.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those not held."""
        mask, out, todo = np.uint64(len(self.slots) - 1), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys[:, 0] & mask).astype(np.int64)
        while len(todo):
            held = self.slots[slot]
            same = (held >= 0) & (self.keys[held] == keys[todo]).all(1)
            out[todo[same]] = held[same]
            more = ~same & (held >= 0)
            todo, slot = todo[more], (slot[more] + 1) & int(mask)
        return out

    def _place(self, first: int) -> None:
        """Enter the keys from ``first`` on into the table; no two are alike."""
        mask, todo = len(self.slots) - 1, np.arange(first, self.count)
        slot = (self.keys[first : self.count, 0] & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several for one slot the last stays
            more = self.slots[slot] != todo
            todo, slot = todo[more], (slot[more] + 1) & mask

    def hold(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Hold the codes of keys that are not held: bytes one after the other, and how many each has."""
        first, self.count = self.count, self.count + len(keys)
        if self.count > len(self.keys):
            more = max(self.count, len(self.keys) * 3 // 2) - len(self.keys)
            self.keys, self.ends = np.concatenate([self.keys, np.empty((more, 2), np.uint64)]), np.concatenate([self.ends, np.zeros(more, np.int64)])
        if self.used + len(flat) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.empty(max(self.used + len(flat), len(self.codes) * 3 // 2) - len(self.codes), np.uint8)])
        self.keys[first : self.count] = keys
        self.ends[first + 1 : self.count + 1] = self.used + np.cumsum(sizes)
        self.codes[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if 2 * self.count > len(self.slots):
            self.slots, first = np.full(1 << (4 * self.count - 1).bit_length(), -1, np.int32), 0
        self._place(first)
        if self.size > self.limit:
            self._empty()

    def held(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the places ``at``: bytes one after the other, and how many each has."""
        begin = self.ends[at]
        size = self.ends[at + 1] - begin
        return gather(self.codes, begin, size), size

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """The little-endian 32-bit ids of each text, given its pieces."""
        memory.used()
        pieces = list(set().union(*split))
        keys = keys_of(pieces)
        at = self.find(keys)
        here, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        flat, size = self.held(at[here])
        flat, cuts = flat.tobytes(), np.cumsum(size).tolist()
        codes = dict(zip([pieces[i] for i in here.tolist()], [flat[i:j] for i, j in zip([0, *cuts], cuts)]))
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            found = self.encode(fresh)
            codes.update(zip(fresh, found))
            self.hold(keys[new], np.frombuffer(b"".join(found), np.uint8), np.array([len(x) for x in found], np.int64))
        get = codes.__getitem__
        return [b"".join(map(get, part)) for part in split]


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``begin`` and are ``size`` long, one after the other."""
    out = []
    for k in range(0, len(begin), AT_ONCE):
        b, n = begin[k : k + AT_ONCE], size[k : k + AT_ONCE]
        upto = np.cumsum(n)
        out.append(pool[np.repeat(b - (upto - n), n) + np.arange(upto[-1])])
    return out[0] if len(out) == 1 else np.concatenate(out or [pool[:0]])


def keys_of(pieces: list[str] | list[bytes]) -> np.ndarray:
    """128-bit hashes of pieces; a text and its UTF-8 bytes have the same."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)
