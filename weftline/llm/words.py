"""Words of a text as arrays of 64-bit hashes, equal in every worker."""

from __future__ import annotations

import numpy as np
import xxhash

_SEEN: dict[str, int] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[str]) -> np.ndarray:
    if len(_SEEN) > 300_000:
        _SEEN.clear()
    get, digest = _SEEN.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _SEEN[w] = digest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words: a polynomial in BASE mod 2**64, mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # doubling: hash of k words from hashes of powers of two
    power, width, part, done = BASE, 1, mix(h), 0
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out = out + scale * part[done : done + n]
                done += width
                scale = scale * power
            if done == k:
                break
            part = part[: len(part) - width] + power * part[width:]
            width, power = width * 2, power * power
    return mix(out)
