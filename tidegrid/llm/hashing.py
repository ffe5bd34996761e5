"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20  # bytes hashed together
_GAMMA, _A, _B, _P = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.full(4096, _P))
    # 1 for the first 4096 bytes of a word: long words beside it don't change a word's hash
    _FAR = np.append(np.uint64(1), np.multiply.accumulate(np.full(4095, mix(np.array([7], np.uint64))[0] | np.uint64(1))))


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block."""
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    at = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
    with np.errstate(over="ignore"):
        value = _BYTE[b] * _POWER[at & 4095]
        if at[-1] > 4095 or at.max() > 4095:
            value *= _FAR[(at >> 12) & 4095]
        value *= word
        return starts, mix(np.add.reduceat(value, starts))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (with the end of the last).

    Words are runs of bytes other than ASCII white space. Long texts are hashed in blocks cut at white
    space, so memory beyond the hashes doesn't grow with a text.
    """
    out, counts, waiting, held = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal waiting, held
        if waiting:
            ends = np.cumsum([len(t) + 1 for _, t in waiting])
            starts, hashes = _block(b" ".join(t for _, t in waiting))
            n = np.diff(np.searchsorted(starts, ends), prepend=0)
            np.add.at(counts, [i for i, _ in waiting], n)
            out.append(hashes)
        waiting, held = [], 0

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > BLOCK:
            cut = max(t.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t"))
            if cut <= at:  # a word longer than a block stays whole
                ends = [x for x in (t.find(c, at + BLOCK) for c in (b" ", b"\n", b"\t")) if x >= 0]
                cut = min(ends, default=len(t))
            waiting.append((i, t[at:cut]))
            flush()
            at = cut
        waiting.append((i, t[at:]))
        held += len(t) - at
        if held >= BLOCK:
            flush()
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(counts))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of each `n` words in a row; of all words if there are fewer, none if there is none."""
    k = max(0, min(n, len(words)))
    if not k:
        return words[:0]
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = out * _GAMMA + words[i : len(words) - k + 1 + i]
        return mix(out + np.uint64(k))
