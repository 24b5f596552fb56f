"""Deep-shallow suffix sorting of byte strings.

Multikey quicksort orders the strings by their first bytes down to a shallow
depth; groups that still agree there are ordered by a blind trie, which looks
at single branching bytes and compares one pair of strings for each insertion.
"""

from __future__ import annotations

SHALLOW = 24


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix; the first `at` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    lo, hi = at, n  # agree before lo, differ before hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("depth", "kids", "some")

    def __init__(self, depth: int, some: int):
        self.depth, self.kids, self.some = depth, {}, some


def _byte(s: bytes, i: int) -> int:
    return s[i] if i < len(s) else -1


def blind_trie(strings: list[bytes], ids: list[int], depth: int) -> list[tuple[int, int]]:
    """(id, lcp with the one before it) in order; all agree on `depth` bytes.
    Nodes hold a depth and branching bytes only; leaves are lists of equal strings."""
    root = _Node(depth, ids[0])
    root.kids[_byte(strings[ids[0]], depth)] = [ids[0]]
    for i in ids[1:]:
        s = strings[i]
        node: _Node | list[int] = root
        while isinstance(node, _Node):  # blind descent: to any leaf below the same branching bytes
            nxt = node.kids.get(_byte(s, node.depth))
            node = next(iter(node.kids.values())) if nxt is None else nxt
        t = strings[node[0]]
        d = lcp(s, t, depth)
        if d == len(s) == len(t):
            node.append(i)
            continue
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < d:
            parent, node = node, node.kids[_byte(s, node.depth)]
        if isinstance(node, _Node) and node.depth == d:
            node.kids[_byte(s, d)] = [i]
            continue
        split = _Node(d, i)
        split.kids[_byte(t, d)] = node
        split.kids[_byte(s, d)] = [i]
        if parent is None:
            root = split
        else:
            parent.kids[_byte(s, parent.depth)] = split
    out: list[tuple[int, int]] = []
    stack: list[tuple[object, int]] = [(root, depth)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, _Node):
            kids = [node.kids[c] for c in sorted(node.kids)]
            for k, kid in reversed(list(enumerate(kids))):
                stack.append((kid, common if k == 0 else node.depth))
        else:
            out.append((node[0], common))
            out += [(i, len(strings[i])) for i in node[1:]]
    return out


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcps): the sorted order and, for each place but the first, the
    length of the prefix shared with the string before.  `known` bytes agree."""
    out: list[tuple[int, int]] = []
    # (ids, depth, lcp with what was put out before); depth -1: ids are equal strings
    stack = [(list(range(len(strings))), known, 0)]
    while stack:
        ids, depth, common = stack.pop()
        if not ids:
            continue
        if len(ids) == 1:
            out.append((ids[0], common))
            continue
        if depth - known >= shallow:
            part = blind_trie(strings, ids, depth)
            out.append((part[0][0], common))
            out += part[1:]
            continue
        keys = [_byte(strings[i], depth) for i in ids]
        pivot = sorted(keys)[len(keys) // 2]
        less = [i for i, c in zip(ids, keys, strict=True) if c < pivot]
        same = [i for i, c in zip(ids, keys, strict=True) if c == pivot]
        more = [i for i, c in zip(ids, keys, strict=True) if c > pivot]
        after = depth if less else common
        stack.append((more, depth, depth))
        if pivot < 0:  # they end here: equal strings
            stack += [([i], depth, depth if k else after) for k, i in reversed(list(enumerate(same)))]
        else:
            stack.append((same, depth + 1, after))
        stack.append((less, depth, common))
    return [i for i, _ in out], [c for _, c in out[1:]]
