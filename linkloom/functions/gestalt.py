"""difflib's ratio for many pairs at once.

SequenceMatcher takes the longest common block of two texts (of several the first in a, then in b), and goes on with
what is left of it and right of it. Here all open pieces of all pairs go together: pieces of like size are columns of
one table, and the table of common suffixes is filled a row at a time for all of them."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np

#: From this length of b on, difflib leaves characters out that b has often; such pairs go to difflib itself.
POPULAR = 200
#: A longer a alone is done sooner by difflib; cells of a table at most.
LONGEST, CELLS = 1 << 10, 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of all texts one after the other as small numbers from 2 on, where each text begins)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(flat.max(initial=0)) + 1, np.uint32)
    number[flat] = 1
    number = np.cumsum(number, dtype=np.uint32) + 1
    small = np.uint8 if number[-1] < 256 else np.uint32
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return number.astype(small)[flat], np.cumsum(size) - size


def _columns(flat: np.ndarray, start: np.ndarray, size: np.ndarray, height: int, pad: int) -> np.ndarray:
    k = np.arange(height)[:, None]
    inside = k < size
    return np.where(inside, flat[np.where(inside, start + k, 0)], flat.dtype.type(pad))


def _longest(flat: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, end in a, end in b) of the longest common block of each piece, as difflib chooses it."""
    x, y = _columns(flat, a, na, int(na.max()), 0), _columns(flat, b, nb, int(nb.max()), 1)
    best, at, bt = np.zeros(len(a), np.uint8), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    run, last = np.zeros((len(y) + 1, len(a)), np.uint8), np.zeros((len(y) + 1, len(a)), np.uint8)
    same = np.empty(y.shape, bool)
    for i in range(len(x)):
        np.equal(y, x[i], out=same)
        np.add(last[:-1], 1, out=run[1:])
        np.multiply(run[1:], same, out=run[1:])
        most = run.max(axis=0)
        better = np.flatnonzero(most > best)
        if len(better):
            best[better], at[better], bt[better] = most[better], i + 1, run[:, better].argmax(axis=0)
        run, last = last, run
    return best.astype(np.int64), at, bt


def _matches(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The number of characters in common blocks; b is shorter than POPULAR, both have characters."""
    flat, begin = _codes([x for pair in pairs for x in pair])
    size = np.fromiter((len(x) for pair in pairs for x in pair), np.int64, 2 * len(pairs))
    out = np.zeros(len(pairs), np.int64)
    pair, a, na, b, nb = np.arange(len(pairs)), begin[::2], size[::2], begin[1::2], size[1::2]
    while len(pair):
        like = (na + 7) // 8 * (POPULAR // 16 + 1) + (nb + 15) // 16
        order = np.argsort(like, kind="stable")
        pair, a, na, b, nb, like = (v[order] for v in (pair, a, na, b, nb, like))
        found, at, bt = (np.empty(len(pair), np.int64) for _ in range(3))
        lo = 0
        while lo < len(pair):
            s = slice(lo, min(lo + CELLS // POPULAR, int(np.searchsorted(like, like[lo], "right"))))
            found[s], at[s], bt[s] = _longest(flat, a[s], na[s], b[s], nb[s])
            lo = s.stop
        out += np.bincount(pair, found, len(out)).astype(np.int64)
        hit = found > 0
        left = (pair, a, at - found, b, bt - found)
        right = (pair, a + at, na - at, b + bt, nb - bt)
        pair, a, na, b, nb = (np.concatenate((p[hit], q[hit])) for p, q in zip(left, right))
        more = (na > 0) & (nb > 0)
        pair, a, na, b, nb = (v[more] for v in (pair, a, na, b, nb))
    return out


def ratios(xs: Iterable[str | None], ys: Iterable[str | None]) -> list[float | None]:
    """SequenceMatcher(None, x, y).ratio() of each x and y; null where one is."""
    pairs = list(zip(xs, ys))
    known: dict[tuple[str | None, str | None], float | None] = dict.fromkeys(pairs)
    some = []
    for p in known:
        x, y = p
        if x is None or y is None:
            continue
        if x == y:
            known[p] = 1.0
        elif not x or not y:
            known[p] = 0.0
        elif len(y) < POPULAR and len(x) < LONGEST:
            some.append(p)
        else:
            known[p] = SequenceMatcher(None, x, y).ratio()
    if some:
        for p, n in zip(some, _matches(some).tolist()):
            known[p] = 2.0 * n / (len(p[0]) + len(p[1]))
    return [known[p] for p in pairs]
