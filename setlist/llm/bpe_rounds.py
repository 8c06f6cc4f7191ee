"""Byte-pair merges of many words of one length at once.

A table of merges has ``count``, sorted ``keys`` (left * count + right), their ``rank`` and their
``merged`` symbol, ``pack`` (rows of symbols to 16-bit ids) and ``final`` (one row that holds
unknown symbols to ids). Symbols are positive; what is not positive never merges.
"""

from __future__ import annotations

import numpy as np

LONGEST = 48
_NEVER = np.int64(1 << 40)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(32))


class Places:
    """Where each of a set of different numbers stands in its list, by a table that is probed in place of a search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(10, int(len(keys) * 16).bit_length())
        self.table = np.full((1 << self.bits) + 64, -1, np.int32)
        for i, h in enumerate(self._slot(keys).tolist()):
            while self.table[h] >= 0:
                h += 1
            self.table[h] = i

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(_M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Each number's place, or any place for one that is not in the list."""
        slot = self._slot(code)
        at = self.table[slot]
        wrong = np.flatnonzero((at.ravel() >= 0) & (self.keys[at.ravel()] != code.ravel()))
        if len(wrong):
            at, slot, code = at.copy(), slot.ravel(), code.ravel()
            flat = at.reshape(-1)
            while len(wrong):  # what another number stands in the way of may be in the next place
                slot[wrong] += 1
                now = self.table[slot[wrong]]
                flat[wrong] = now
                wrong = wrong[(now >= 0) & (self.keys[now] != code[wrong])]
        return np.maximum(at, 0)


def candidates(bpe: Bpe, s: np.ndarray, p: np.ndarray, key: np.ndarray, j: np.ndarray | slice, dropout: float, rows=None) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of merging symbols ``j`` and ``j + 1``; skipped ones rank last."""
    if rows is None:
        a, b, lo, mid, hi, k = s[:, :-1], s[:, 1:], p[:, :-2], p[:, 1:-1], p[:, 2:], key[:, None]
    else:
        a, b, lo, mid, hi, k = s[rows, j], s[rows, j + 1], p[rows, j], p[rows, j + 1], p[rows, j + 2], key[rows]
    code = np.where((a > 0) & (b > 0), a * bpe.count + b, -1)
    i = bpe.find(code) if hasattr(bpe, "find") else np.minimum(np.searchsorted(bpe.keys, code), len(bpe.keys) - 1)
    hit = bpe.keys[i] == code
    if dropout:
        hit &= mix(k + span_terms(lo, mid, hi)) >> np.uint64(11) >= np.uint64(int(dropout * (1 << 53)))
    return np.where(hit, bpe.rank[i], _NEVER), bpe.merged[i]


def span_terms(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What a candidate's place adds to the key that its hash is made of."""
    u = np.uint64
    return lo.astype(u) * u(0x2545F4914F6CDD1D) + mid.astype(u) * u(0x9E6C63D0876A9A47) + hi.astype(u) * u(0xD1342543DE82EF95)


def rounds(bpe: Bpe, s: np.ndarray, key: np.ndarray, at: np.ndarray, dropout: float, out: list[bytes], trace: list | None = None) -> None:
    """Merge each row of ``s``; its ids go to ``out`` at its place ``at``. ``trace`` gets (places, span terms) of the merges
    of each round."""
    n = s.shape[1]
    p = np.broadcast_to(np.arange(n + 1), (len(s), n + 1)).copy()
    rank, new = candidates(bpe, s, p, key, slice(None), dropout) if n > 1 else (np.empty((len(s), 0), np.int64),) * 2
    while len(s):
        width = s.shape[1]
        best = rank.argmin(axis=1) if width > 1 else np.zeros(len(s), np.int64)
        go = rank[np.arange(len(s)), best] < _NEVER if width > 1 else np.zeros(len(s), bool)
        if not go.all():
            done = ~go
            rows = s[done]
            plain = (rows > 0).all(axis=1)
            packed = bpe.pack(rows)
            for i, ok, row, ids in zip(at[done].tolist(), plain.tolist(), rows, packed, strict=True):
                out[i] = ids.tobytes() if ok else bpe.final(row.tolist())
            s, p, key, at, rank, new, best = s[go], p[go], key[go], at[go], rank[go], new[go], best[go]
        if not len(s):
            return
        m = len(s)
        r = np.arange(m)
        if trace is not None:
            trace.append((at, span_terms(p[r, best], p[r, best + 1], p[r, best + 2])))
        s[r, best] = new[r, best]
        keep = np.ones((m, width), bool)
        keep[r, best + 1] = False
        s = s[keep].reshape(m, width - 1)
        keep_p = np.ones((m, width + 1), bool)
        keep_p[r, best + 1] = False
        p = p[keep_p].reshape(m, width)
        if width == 2:
            rank = new = np.empty((m, 0), np.int64)
            continue
        # of the pairs around the merge one goes and its neighbours change
        keep = np.ones((m, width - 1), bool)
        keep[r, np.minimum(best, width - 2)] = False
        rank, new = rank[keep].reshape(m, width - 2), new[keep].reshape(m, width - 2)
        for j in (best - 1, best):
            rows = np.flatnonzero((j >= 0) & (j < width - 2))
            if len(rows):
                rank[rows, j[rows]], new[rows, j[rows]] = candidates(bpe, s, p, key, j[rows], dropout, rows)
