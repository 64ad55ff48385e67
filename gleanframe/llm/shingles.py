"""Sets of word shingles as sorted arrays of 64-bit hashes, computed in numpy for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .common import text_slices

U = np.uint64
_RNG = np.random.default_rng(914_003)
BYTE = _RNG.integers(0, 1 << 64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(int(BASE), -1, 1 << 64))
STEP = _RNG.integers(0, 1 << 64, 64, dtype=U) | U(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text whose words are hashed at once, but for a single longer text.
CHUNK = 512 << 10
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", BASE), ("down", UNBASE)):
            held = np.empty(size, dtype=U)
            held[0] = 1
            held[1:] = base
            _POWERS[name] = np.multiply.accumulate(held)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in a row, and each text's first word's place (one more at the end).

    A word's hash is a polynomial over its bytes, so sums up to each place give every word's.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts_of = np.concatenate([[0], np.cumsum(lengths)])
    up, down = powers(len(data))
    space = IS_SPACE[data]
    sums = np.cumsum(BYTE[data] * up[: len(data)])
    inner = ~space
    first = np.flatnonzero(inner & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(inner & np.concatenate([space[1:], [True]]))
    before = np.where(first > 0, sums[first - 1], U(0))
    words = mix((sums[last] - before) * down[first] + (last - first + 1).astype(U))
    return words, np.searchsorted(first, starts_of)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words; fewer words, but one at least, are one run."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * STEP[:n]).sum(dtype=U, keepdims=True) + U(n) * STEP[k : k + 1])
    total = words[: n - k + 1] * STEP[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * STEP[i]
    return mix(total)


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """The set of each text, sorted: A-Z lower-cased, words are runs of all but ASCII white space."""
    for lo, hi in text_slices(texts, CHUNK):
        words, at = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]])
        for a, b in zip(at, at[1:], strict=False):
            yield np.unique(shingle_hashes(words[a:b], k))
