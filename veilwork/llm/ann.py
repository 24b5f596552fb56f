"""Approximate nearest neighbours by a forest of random-projection trees.

Each block of vectors has a forest of its own.  A query walks all trees of it
through one priority queue, nearest margin first, until it has gathered enough
leaf candidates, which are then ranked by exact cosine.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .vectors import searched_in_blocks, usable

TREES = 40
LEAF = 32
CANDIDATES = 3500


class Forest:
    """Trees over rows of unit length; a split is a random direction through
    the middle of the projections, so leaves stay even."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.x, self.normal, self.cut, self.kids, self.rows = x, [], [], [], []
        self.roots = [self._grow(np.arange(len(x)), leaf, rng) for _ in range(trees)]
        self.normals = np.array(self.normal) if self.normal else np.zeros((0, x.shape[1]))

    def _grow(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """Number of a split, or -1 - number of a leaf."""
        if len(rows) <= leaf:
            self.rows.append(rows)
            return -len(self.rows)
        a, b = self.x[rows[rng.integers(len(rows))]], self.x[rows[rng.integers(len(rows))]]
        v = a - b
        v = v if (v @ v) > 1e-12 else rng.standard_normal(self.x.shape[1])
        v = v / np.sqrt(v @ v)
        side = self.x[rows] @ v
        half = len(rows) // 2
        split = np.argpartition(side, half)
        k = len(self.normal)
        self.normal.append(v)
        self.cut.append(float(side[split[half]]))
        self.kids.append((0, 0))
        self.kids[k] = (self._grow(rows[split[:half]], leaf, rng), self._grow(rows[split[half:]], leaf, rng))
        return k

    def candidates(self, q: np.ndarray, enough: int) -> np.ndarray:
        margin = (self.normals @ q - np.array(self.cut)).tolist()
        heap = [(0.0, r) for r in self.roots]
        heapq.heapify(heap)
        seen, n = np.zeros(len(self.x), bool), 0
        while heap and n < enough:
            d, k = heapq.heappop(heap)
            while k >= 0:
                m = margin[k]
                low, high = self.kids[k]
                heapq.heappush(heap, (d + m * m, high if m < 0 else low))
                k = low if m < 0 else high
            rows = self.rows[-k - 1]
            n += len(rows) - int(seen[rows].sum())
            seen[rows] = True
        return np.flatnonzero(seen)


def search(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int, leaf: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors are one entry of the index; a query takes the k smallest of
    their ids that are not its own."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    distinct, owner = np.unique(data, axis=0, return_inverse=True)
    owner = owner.ravel()
    by = np.argsort(owner, kind="stable")
    named, first = ids[by], np.searchsorted(owner[by], np.arange(len(distinct) + 1))
    norm = np.sqrt((distinct * distinct).sum(1))
    forest = Forest(distinct / norm[:, None], trees, leaf)
    out = []
    for qi, q in zip(query_ids.tolist(), queries, strict=True):
        qn = float(np.sqrt((q * q).sum()))
        rows = forest.candidates(q / qn, enough)
        score = (distinct[rows] * q).sum(1) / (norm[rows] * qn)
        mine: list[tuple[float, int]] = []
        for c in np.argsort(-score, kind="stable").tolist():
            if len(mine) >= k and score[c] < mine[k - 1][0]:
                break
            r = rows[c]
            copies = named[first[r]:first[r + 1]]
            own, after = (np.searchsorted(copies, qi, side) for side in ("left", "right"))
            mine += [(float(score[c]), i) for i in [*copies[:min(own, k)].tolist(), *copies[after:after + k].tolist()][:k]]
            mine.sort(key=lambda t: (-t[0], t[1]))
            del mine[k:]
        out += [(qi, i, s) for s, i in mine]
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2], np.float64)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, trees: int = TREES, leaf: int = LEAF, enough: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for ids divisible by `every`.

    Every row is indexed.  Vectors that are null, zero, or hold a null, NaN or
    infinite component, and rows without id, take no part.  Shorter vectors
    count as filled up with zeros.  A repeated row is a candidate once for each
    copy but never for its own id; a repeated query is asked once.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return searched_in_blocks(queries, rows, lambda i, d, qi, q: search(i, d, qi, q, k, trees, leaf, enough), "double", k)
