"""Additive quantisation: full-dimensional residual codebooks, beam-search encoding and lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Stages that keep the whole beam, as do all that name a cell; later ones, whose codes only refine a sum, keep a quarter.
WIDE_STAGES = 4


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty centroids move to the rows that lie worst."""
    if len(x) == 0:
        return np.zeros((k, x.shape[1]), np.float32)
    c = x[rng.permutation(len(x))[:k]]
    if len(c) < k:
        c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), np.float32)])
    for _ in range(rounds):
        d = x @ c.T
        d *= -2
        d += (c * c).sum(1)
        label = d.argmin(1)
        n = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        starts = np.searchsorted(label[order], np.arange(k))
        full = n > 0
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        c = c.copy()
        c[full] = sums / n[full, None]
        if (~full).any():
            worst = np.argsort(-d[np.arange(len(x)), label])[: (~full).sum()]
            c[np.flatnonzero(~full)[: len(worst)]] = x[worst]
    return c.astype(np.float32)


@dataclass
class Quantiser:
    """Codebooks (stages, codewords, width) whose sums approximate vectors."""

    books: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, stages: int, codewords: int, beam: int = 4, rounds: int = 8, seed: int = 7) -> Quantiser:
        """Stage by stage: k-means on what the earlier stages, encoded by beam search, leave over."""
        rng = np.random.default_rng(seed)
        books = np.zeros((0, codewords, x.shape[1]), np.float32)
        rest = x
        for _ in range(stages):
            books = np.concatenate([books, kmeans(rest, codewords, rounds, rng)[None]])
            q = cls(books)
            rest = x - q.decode(q.encode(x, beam)[0][:, 0])
        return cls(books)

    def __getstate__(self) -> dict:
        return {"books": self.books}

    def __setstate__(self, state: dict) -> None:
        self.books = state["books"]
        self.__post_init__()

    def __post_init__(self) -> None:
        m, k, w = self.books.shape
        self.flat = self.books.reshape(m * k, w)
        self.norm2 = (self.flat * self.flat).sum(1).reshape(m, k)
        self.gram = (self.flat @ self.flat.T).reshape(m, k, m * k)

    def encode(self, x: np.ndarray, beam: int, block: int = 2048, early: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, beam, stages), best first, and the beam as it stood after the first `early` stages, (n, beam, early)."""
        m = self.books.shape[0]
        codes, first = [np.zeros((0, beam, m), np.uint8)], [np.zeros((0, beam, early), np.uint8)]
        for at in range(0, len(x), block):
            for done, c in zip((codes, first), self._encode(x[at : at + block], beam, early)):
                if c.shape[1] < beam:  # fewer sums than the beam is wide: repeat the last
                    c = np.concatenate([c, np.repeat(c[:, -1:], beam - c.shape[1], 1)], 1)
                done.append(c)
        return np.concatenate(codes), np.concatenate(first)

    def _encode(self, x: np.ndarray, beam: int, early: int) -> tuple[np.ndarray, np.ndarray]:
        m, k, _ = self.books.shape
        n = len(x)
        dots = (x @ self.flat.T).reshape(n, m, k)
        codes, cost = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
        first = codes
        rows = np.arange(n)[:, None]
        for s in range(m):
            cross = np.zeros((n, codes.shape[1], k), np.float32)
            for t in range(s):
                cross += self.gram[t, codes[:, :, t], s * k : (s + 1) * k]
            cross *= 2
            cross += (self.norm2[s] - 2 * dots[:, s])[:, None, :]
            cross += cost[:, :, None]
            total = cross.reshape(n, -1)
            keep = min(beam if s < max(WIDE_STAGES, early) else max(1, beam // 4), total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
            values = np.take_along_axis(total, best, 1)
            order = np.argsort(values, axis=1, kind="stable")
            best, cost = np.take_along_axis(best, order, 1), np.take_along_axis(values, order, 1)
            codes = np.concatenate([codes[rows, best // k], (best % k).astype(np.uint8)[:, :, None]], 2)
            if s + 1 == early:
                first = codes
        return codes, first

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((*codes.shape[:-1], self.books.shape[2]), np.float32)
        for s in range(codes.shape[-1]):
            out += self.books[s][codes[..., s]]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of every query with every codeword: (queries, stages * codewords)."""
        return queries @ self.flat.T
