"""Vectorised numpy kernels over UTF-8 bytes: words, word hashes, shingle sets."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 1 mod 4
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)
#: One odd factor for each place in a window, drawn by the same rule.
_PLACE = mix(np.arange(1, 65, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for base, name in ((_BASE, "_POW"), (_BASE_INV, "_INV")):
                out = np.ones(size, U64)
                done, step = 1, U64(base)
                while done < size:
                    take = min(done, size - done)
                    out[done : done + take] = out[:take] * step
                    step = step * step
                    done *= 2
                globals()[name] = out
    return _POW, _INV


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word ``[^\\x20\\x09-\\x0D]+``; words never cross documents."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    sep = _SEP[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = sep[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = True
    first &= ~sep
    starts = np.flatnonzero(first)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = sep[1:]
    cut = edges[edges > 0] - 1
    last[cut] = True
    last &= ~sep
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; ``lower`` folds A-Z first."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    pow_, inv = _powers(len(data))
    with np.errstate(over="ignore"):
        cum = np.zeros(len(data) + 1, U64)
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[data] * pow_[: len(data)], out=cum[1:])
        return mix((cum[ends] - cum[starts]) * inv[starts] + (ends - starts).astype(U64))


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's run in an ascending array of document numbers."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``k`` words within one document."""
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        s = h[:n] * _PLACE[0]
        for j in range(1, k):
            s = s + h[j : j + n] * _PLACE[j]
        same = doc[:n] == doc[k - 1 :]
        return mix(s[same]), doc[:n][same]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the ascending distinct hashes of its ``k``-word shingles (lower-cased).

    Fewer than ``k`` words count as one shingle of the whole sequence; no word gives an empty set.
    """
    n_docs = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    h = word_hashes(data, starts, ends, True)
    sh, sh_doc = windows(h, doc, k)
    wb, sb = doc_bounds(doc, n_docs), doc_bounds(sh_doc, n_docs)
    out = []
    with np.errstate(over="ignore"):
        for i in range(n_docs):
            n = wb[i + 1] - wb[i]
            if n >= k:
                s = np.sort(sh[sb[i] : sb[i + 1]])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                part = h[wb[i] : wb[i + 1]]
                out.append(mix((part * _PLACE[8 : 8 + n]).sum(keepdims=True) + U64(n) * _PLACE[20]))
            else:
                out.append(np.zeros(0, U64))
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64)
        b = mix(s ^ U64(0xE7037ED1A0B428DB)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def repeated_words(h: np.ndarray, doc: np.ndarray, k: int = 3) -> np.ndarray:
    """Marks the words that lie in a ``k``-word window found twice or more in its document."""
    marks = np.zeros(len(h), bool)
    if len(h) < k:
        return marks
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        s = h[:n] * _PLACE[0]
        for j in range(1, k):
            s = s + h[j : j + n] * _PLACE[j]
        s = mix(s + doc[:n].astype(U64) * _PLACE[30])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    s = s[at]
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    same = np.zeros(len(s), bool)
    eq = ranked[1:] == ranked[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    twice = at[order[same]]
    for j in range(k):
        marks[twice + j] = True
    return marks


def counts_between(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each stretch of ``offs``."""
    cum = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=cum[1:])
    return cum[offs[1:]] - cum[offs[:-1]]
