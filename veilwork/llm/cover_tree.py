"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are each put into a cover tree.  Node pairs are descended
best bound first; a pair is pruned once the largest inner product that the two
covering balls allow lies below the worst kth score of the query group.
Scores are whole numbers, so ties are exact and go to the smaller id.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .vectors import searched_in_blocks, usable

SCALE = 1024
LEAF = 256
QUERY_LEAF = 24
FAN = 64


class Node:
    __slots__ = ("center", "kids", "rows", "radius", "norm", "worst")

    def __init__(self, center: np.ndarray, radius: float):
        self.center, self.radius, self.norm = center, radius, float(np.sqrt(center @ center))
        self.kids: list[Node] = []
        self.rows: np.ndarray | None = None
        self.worst = -np.inf


def build(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree: the points below a node lie within its radius; its children
    are centred on points of its own that are more than half the radius apart,
    farthest first and at most `FAN` of them.  Points that are all equal, or few, form a leaf."""
    start = x[0]
    dist = np.sqrt(((x - start) ** 2).sum(1))
    root = Node(start, float(dist.max()))
    todo = [(root, np.arange(len(x)), dist)]
    while todo:
        node, rows, dist = todo.pop()
        if len(rows) <= leaf or node.radius == 0:
            node.rows = rows
            continue
        near, owner = dist.copy(), np.zeros(len(rows), np.int64)
        centers, limit = [0], node.radius / 2
        centers[0] = int(near.argmin())
        most = max(2, min(FAN, len(rows) // 8))
        while near.max() > limit and len(centers) < most:
            far = int(near.argmax())
            d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(1))
            owner[d < near] = len(centers)
            near = np.minimum(near, d)
            centers.append(far)
        if len(centers) == 1:
            node.rows = rows
            continue
        for c in range(len(centers)):
            mine = owner == c
            if mine.any():
                kid = Node(x[rows[centers[c]]], float(near[mine].max()))
                node.kids.append(kid)
                todo.append((kid, rows[mine], near[mine]))
    return root


def search(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best but itself."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    tree, asked = build(data), build(queries, QUERY_LEAF)
    big = float(max(np.abs(data).max(initial=0), np.abs(queries).max(initial=0), 1))
    slack = 1e-9 * big * big * data.shape[1]
    best: list[list[tuple]] = [[] for _ in query_ids]  # (score, -id), smallest first

    def bound(q: Node, r: Node) -> float:
        return float(q.center @ r.center) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius + slack

    def worst(q: Node) -> float:
        if q.rows is not None:
            return min((best[i][0][0] if len(best[i]) >= k else -np.inf) for i in q.rows.tolist())
        return q.worst

    tick = count()
    heap = [(-bound(asked, tree), next(tick), asked, tree)]
    parents: dict[int, Node] = {}
    stack = [asked]
    while stack:
        n = stack.pop()
        for c in n.kids:
            parents[id(c)] = n
            stack.append(c)
    while heap:
        up, _, q, r = heapq.heappop(heap)
        if -up < worst(q):
            continue
        if q.rows is not None and r.rows is not None:
            s = exact(queries[q.rows], data[r.rows])
            for row, i in enumerate(q.rows.tolist()):
                line, mine = s[row], best[i]
                floor = mine[0][0] if len(mine) >= k else None
                # the query's own rows go before the cut: a repeated id has many
                ok = ids[r.rows] != query_ids[i]
                cand = np.flatnonzero(ok if floor is None else ok & (line >= floor))
                if len(cand) > k:
                    # by score, then by id: rows are in the order of ids
                    cand = cand[np.lexsort((cand, -line[cand]))[:k]] if line.dtype != object else sorted(cand.tolist(), key=lambda c: (-line[c], c))[:k]
                for c in cand:
                    item = (line[c], -int(ids[r.rows[c]]))
                    if len(mine) < k:
                        heapq.heappush(mine, item)
                    elif item > mine[0]:
                        heapq.heapreplace(mine, item)
            up_node = parents.get(id(q))
            while up_node is not None:
                w = min(worst(c) for c in up_node.kids)
                if w <= up_node.worst:
                    break
                up_node.worst = w
                up_node = parents.get(id(up_node))
            continue
        if r.rows is None and (q.rows is not None or r.radius >= q.radius):
            pairs = [(q, c) for c in r.kids]
        else:
            pairs = [(c, r) for c in q.kids]
        for a, b in pairs:
            u = bound(a, b)
            if u >= worst(a):
                heapq.heappush(heap, (-u, next(tick), a, b))
    out = [(int(q), -i, s) for q, found in zip(query_ids, best, strict=True) for s, i in found]
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array([max(-(1 << 63), min(int(s), (1 << 63) - 1)) for s in cols[2]], np.int64)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: by floating point while every sum stays below 2**53, else by
    Python's integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    ints = np.frompyfunc(int, 1, 1)
    return ints(a).astype(object) @ ints(b).astype(object).T


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for queries with ids divisible by `every`.

    Components become floor(scale * x).  Vectors that are null or hold a null,
    NaN or infinite component, and rows without id, take no part.  Shorter
    vectors count as filled up with zeros.  A repeated row is a candidate once
    for each copy but never for its own id; a repeated query is asked once.
    Scores beyond a long are ranked exactly and returned as the nearest long.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col).select("id", F.transform("v", lambda x: _floor(x, scale)).alias("v"))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return searched_in_blocks(queries, rows, lambda i, d, qi, q: search(i, d, qi, q, k, integer_products), "long", k)


def _floor(x, scale: int):
    """floor(scale * x) as a double: Spark's floor of a double is a long and
    would cut off what lies beyond one."""
    y = x * F.lit(float(scale))
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
