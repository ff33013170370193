"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are runs of bytes other than space and 0x09-0x0D of the UTF-8 text with A-Z in
lower case. A word's hash is a polynomial over its bytes modulo 2**64, mixed; a
shingle's hash mixes those of its words in order. Working memory follows CHUNK, not the
text, but for 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_lowered = np.arange(256)
_lowered[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_byte_value = mix(_lowered.astype(U) + U(0x51ED270B))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base, and of its inverse."""
    have = max(_powers, default=0)
    if have < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, U(_BASE)), np.full(size, U(pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers.clear()
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        have = size
    return _powers[have]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    out, at = [], 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not _is_space[raw[end - 1]]:  # a word isn't cut
            more = np.flatnonzero(_is_space[raw[end : end + CHUNK]])
            end = end + int(more[0]) + 1 if len(more) else min(len(raw), end + CHUNK)
        part = raw[at:end]
        at = end
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_is_space[part]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_byte_value[part] * up[: len(part)], out=total[1:])
        out.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(U)))
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The set of a text's shingles, sorted; with fewer words than ``size``, the whole sequence is the one shingle."""
    if not len(words):
        return words
    n = min(size, len(words))
    x = np.full(len(words) - n + 1, U(n))
    for i in range(n):
        x = mix(x * U(3) + words[i : len(words) - n + 1 + i])
    return np.unique(x)


def shingle_sets(texts: Iterable[bytes | str | None], size: int) -> Iterator[np.ndarray]:
    """A sorted array of distinct hashes for each text. Texts are hashed together, as many as fit CHUNK, as numpy's calls cost more than short texts."""
    held: list[bytes] = []
    length = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        held.append(data)
        length += len(data) + 1
        if length >= CHUNK:
            yield from _sets(held, size)
            held, length = [], 0
    yield from _sets(held, size)


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    if len(texts) == 1:
        yield shingle_hashes(word_hashes(texts[0]), size)
        return
    if not texts:
        return
    joined = b"\n".join(texts)
    words = word_hashes(joined)
    raw = np.frombuffer(joined, np.uint8)
    begins = np.zeros(len(raw) + 1, np.int64)
    spaces = _is_space[raw]
    starts = ~spaces
    starts[1:] &= spaces[:-1]
    np.cumsum(starts, out=begins[1:])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at[-1] -= 1
    bounds = begins[at]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield shingle_hashes(words[a:b], size)
