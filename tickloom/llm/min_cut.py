"""Minimum cuts of small sparse graphs whose nodes have a leaning to one of two sides."""

from __future__ import annotations

from collections import deque


def min_cut(leaning: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the first side in a labelling of least cost; in the one with most nodes there, among equals.

    A node on the second side costs max(0, leaning), one on the first max(0, -leaning);
    an edge (i, j, weight) costs its weight where its ends differ. A node that leans more
    than all its edges can pull is settled at once and its edges become leanings of its
    neighbours; what is left falls into parts, and a maximum flow settles each.
    """
    n = len(leaning)
    lean = list(leaning)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    pull = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is not None or -pull[i] <= lean[i] < pull[i]:
            continue
        side[i] = lean[i] >= pull[i]
        for j, w in near[i].items():
            if side[j] is None:
                lean[j] += w if side[i] else -w
                pull[j] -= w
                waiting.append(j)
    for i in range(n):
        if side[i] is None:
            part, seen = [i], {i}
            for k in part:
                for j in near[k]:
                    if side[j] is None and j not in seen:
                        seen.add(j)
                        part.append(j)
            at = {k: x for x, k in enumerate(part)}
            inner = [(at[k], at[j], w) for k in part for j, w in near[k].items() if k < j and j in at]
            for k, first in zip(part, _by_flow([lean[k] for k in part], inner), strict=True):
                side[k] = first
    return [bool(x) for x in side]


def _by_flow(lean: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The same by a maximum flow from the first side to the second along shortest paths (Dinitz); whatever can't reach the second is on the first."""
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(i: int, j: int, forth: int, back: int) -> None:
        for a, b, w in ((i, j, forth), (j, i, back)):
            out[a].append(len(to))
            to.append(b)
            room.append(w)

    for i, x in enumerate(lean):
        if x > 0:
            add(source, i, x, 0)
        elif x < 0:
            add(i, sink, -x, 0)
    for i, j, w in edges:
        add(i, j, w, w)

    def levels() -> list[int]:
        """Steps to the sink through edges with room."""
        far = [-1] * (n + 2)
        far[sink] = 0
        row = deque([sink])
        while row:
            j = row.popleft()
            for e in out[j]:
                i = to[e]
                if far[i] < 0 and room[e ^ 1]:
                    far[i] = far[j] + 1
                    row.append(i)
        return far

    while True:
        far = levels()
        if far[source] < 0:
            return [x < 0 for x in far[:n]]
        begin = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while begin[i] < len(out[i]):
                e = out[i][begin[i]]
                if room[e] and far[to[e]] == far[i] - 1:
                    break
                begin[i] += 1
            else:
                if i == source:
                    break
                e = path.pop()
                i = to[e ^ 1]
                begin[i] += 1
                continue
            path.append(e)
            i = to[e]
