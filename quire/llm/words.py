"""Word hashes of whole batches of texts as array operations."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x5851F42D4C957F2D
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)
_SIDE_BY_SIDE = 256  # bytes of the longest word that is hashed beside others


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Hasher:
    """64-bit hash of each run of word characters.

    A word is taken in steps of eight bytes; each is mixed into what came before by a bijection, so words of one length
    that differ in one step alone never agree, and others do so by chance (1 in 2**64). Long words have a digest instead.

    ``ascii_words``: words are what stands between ASCII white space, A-Z is lower-cased, and
    UTF-8 bytes are hashed. Otherwise words are runs of letters and digits of the text in
    lower case, and code points are hashed.
    """

    def __init__(self, ascii_words: bool):
        self.ascii_words = ascii_words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.white = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.alnum = None if ascii_words else np.array([chr(c).isalnum() for c in range(0x110000)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        if self.ascii_words:
            raw = [t.encode() for t in texts]
            values = self.lower[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
            inside = ~self.white[values]
        else:
            raw = [t.lower() for t in texts]
            values = np.frombuffer(("\n".join(raw) + "\n").encode("utf-32-le"), np.uint32)
            inside = self.alnum[values]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.r_[0, edges]
        starts, ends = edges[::2], edges[1::2]  # the text ends outside a word
        hashes = _digests(values, starts, ends)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        places = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
        return hashes, np.diff(places)


def _digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of values."""
    size = values.itemsize
    data = np.concatenate([values.view(np.uint8), np.zeros(8, np.uint8)])
    # The eight bytes from every place on.
    ahead = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    at, left = starts * size, (ends - starts) * size
    hashes = mixed(left.astype(np.uint64) * _ODD + _SEED)
    long = np.flatnonzero(left > _SIDE_BY_SIDE)
    open_ = np.flatnonzero(left <= _SIDE_BY_SIDE)
    step = 0
    while len(open_):
        block = ahead[at[open_] + step]
        short = left[open_] - step
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(short, 8)).astype(np.uint64))
        hashes[open_] = mixed(hashes[open_] ^ block)
        step += 8
        open_ = open_[short > 8]
    for i in long.tolist():
        run = data[at[i] : at[i] + left[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")
    return hashes


def windows(hashes: np.ndarray, offsets: tuple[int, ...], seed: int) -> np.ndarray:
    """Hash of the words at the offsets from each position; shorter by the last offset."""
    n = max(0, len(hashes) - offsets[-1])
    total = np.full(n, seed, np.uint64)
    factor = int(_ODD)
    for offset in offsets:
        factor = (factor * _BASE + 2) & 0xFFFFFFFFFFFFFFFF
        total += hashes[offset : offset + n] * np.uint64(factor | 1)
    return mixed(total)
