"""Cutting one connected patch of cells, of bounded size, into connected parts of nearly equal size.

What a task of ``splitting.py`` does with its patch. A front grows from a far end of the patch, in the order of distance, until
it has its share; cells that it cuts off from the rest join it, and it ends as much earlier. Both sides are cut again until
each part is one front. Then rich parts hand cells to poorer ones, along chains of neighbouring parts, as long as a
cell's part stays connected without it.
"""

from __future__ import annotations

from collections import deque

import numpy as np


def neighbours(places: np.ndarray, kernel: list[tuple[int, ...]]) -> list[list[int]]:
    """For each cell the cells at the kernel's offsets; of cells at one place the first."""
    at: dict[tuple[int, ...], int] = {}
    rows = [tuple(p) for p in places.tolist()]
    for i, p in enumerate(rows):
        at.setdefault(p, i)
    # further cells at a place hang on the first
    out = [[at[q] for o in kernel if (q := tuple(a + b for a, b in zip(p, o, strict=True))) in at] for p in rows]
    for i, p in enumerate(rows):
        if at[p] != i:
            out[i] = [at[p]]
            out[at[p]].append(i)
    return out


def by_distance(near: list[list[int]], own: set[int], start: int) -> list[int]:
    """The cells of ``own`` that can be reached from ``start``, nearest first."""
    order, seen, todo = [], {start}, deque([start])
    while todo:
        i = todo.popleft()
        order.append(i)
        for j in near[i]:
            if j in own and j not in seen:
                seen.add(j)
                todo.append(j)
    return order


def parts_of(near: list[list[int]], own: set[int]) -> list[list[int]]:
    """Connected parts, the largest first."""
    left, out = set(own), []
    while left:
        part = by_distance(near, left, min(left))
        out.append(part)
        left.difference_update(part)
    return sorted(out, key=lambda p: (-len(p), p[0]))


def front(near: list[list[int]], own: set[int], share: int) -> set[int]:
    """A connected part of about ``share`` cells whose rest is connected too."""
    end = by_distance(near, own, by_distance(near, own, min(own))[-1])
    best: set[int] = set()
    for start in (end[0], end[-1], end[len(end) // 2], min(own), max(own)):
        order = by_distance(near, own, start)
        low, high = 1, share
        for _ in range(12):
            # the longest beginning that, with what it cuts off, has no more cells than its share
            middle = (low + high + 1) // 2 if low < share else share
            head = set(order[:middle])
            for part in parts_of(near, own - head)[1:]:
                head.update(part)
            if len(head) < len(own) and (not best or abs(len(head) - share) < abs(len(best) - share)):
                best = head
            if len(head) == share or low >= high:
                break
            low, high = (middle, high) if len(head) <= share else (low, middle - 1)
            if low >= high and middle == low:
                break
        if len(best) == share:
            break
    return best


def cut(near: list[list[int]], own: set[int], parts: int, labels: np.ndarray, first: int = 0) -> None:
    """Label ``own`` by ``parts`` fronts, from ``first`` on."""
    if parts <= 1:
        labels[list(own)] = first
        return
    left = parts // 2
    head = front(near, own, max(1, round(len(own) * left / parts)))
    rest = own - head
    if not head or not rest:
        labels[list(own)] = first
        return
    # both sides have as many parts as their cells are worth, and as cells at least
    left = min(max(1, round(parts * len(head) / len(own))), parts - 1, len(head))
    left = max(left, parts - len(rest))
    cut(near, head, left, labels, first)
    cut(near, rest, parts - left, labels, first + left)


def handed(near: list[list[int]], labels: np.ndarray, parts: int) -> None:
    """Even out sizes by handing cells along chains of neighbouring parts, one cell a link."""
    cells: list[set[int]] = [set(np.flatnonzero(labels == p).tolist()) for p in range(parts)]

    def loose(p: int, q: int) -> int:
        """A cell of p next to q without which p stays connected, or -1."""
        for i in sorted(cells[p]):
            if any(labels[j] == q for j in near[i]) and len(cells[p]) > 1:
                rest = cells[p] - {i}
                if len(by_distance(near, rest, next(iter(rest)))) == len(rest):
                    return i
        return -1

    stuck: set[tuple[int, int]] = set()
    for _ in range(4 * len(labels)):
        sizes = [len(c) for c in cells]
        rich = max(range(parts), key=lambda p: (sizes[p], -p))
        if sizes[rich] - min(sizes) <= 1:
            return
        links: list[set[int]] = [set() for _ in range(parts)]
        for i, own in enumerate(near):
            links[labels[i]].update(int(labels[j]) for j in own)
        from_, todo, target = {rich: -1}, deque([rich]), -1
        while todo and target < 0:
            p = todo.popleft()
            for q in sorted(links[p]):
                if q not in from_ and (p, q) not in stuck:
                    from_[q] = p
                    todo.append(q)
                    if sizes[q] < sizes[rich] - 1:
                        target = q
                        break
        if target < 0:
            return
        chain = [target]
        while from_[chain[-1]] >= 0:
            chain.append(from_[chain[-1]])
        for q, p in zip(chain, chain[1:], strict=False):
            i = loose(p, q)
            if i < 0:
                stuck.add((p, q))
                break
            cells[p].discard(i)
            cells[q].add(i)
            labels[i] = q


def even_parts(places: np.ndarray, kernel: list[tuple[int, ...]], parts: int) -> np.ndarray:
    """A label from 0 for each cell of a connected patch."""
    near = neighbours(places, kernel)
    labels = np.zeros(len(places), np.int64)
    parts = min(parts, len(places))
    cut(near, set(range(len(places))), parts, labels)
    handed(near, labels, parts)
    return labels
