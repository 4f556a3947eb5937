"""Simple tree matching of two element trees, exactly, in bounded memory.

Two elements match if their labels do; their children are matched in order so that most
elements match in all, and a pair of equal text counts half an element more. Child lists are
matched by dynamic programming over whole lists, a row of the table at a time; lists whose table
would be large are halved at the best place, so that no more than two rows are held. Elements
of one structure, with the same of those texts that the other tree has too, are of one kind (a
64-bit hash): pairs of kinds are weighed once, and equal heads and tails of lists are matched
before the rest.

Of equally good matchings of two lists, the one is taken that pairs the last children first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of the table of two lists that are held at once.
MOST_CELLS = 2_000_000
#: Up to so many cells a plain loop is faster.
FEW_CELLS = 1_024
#: The key of elements without text.
EMPTY = 1


class Twig:
    """An element for matching: its label, a key of its text, its children, and what it stands for."""

    __slots__ = ("key", "kids", "kind", "label", "shape", "stands_for", "weight")

    def __init__(self, label: str, key: int, kids: list[Twig], stands_for: object = None) -> None:
        self.label, self.key, self.kids, self.stands_for = label, key, kids, stands_for
        self.shape = hash((label, key == EMPTY, *[k.shape for k in kids]))
        self.weight = 1 + sum([k.weight for k in kids])
        self.kind = 0  # set for a matching: what it may weigh with elements of the other tree

    def same(self, other: Twig) -> bool:
        """Whether the trees are equal in labels and texts, all the way down."""
        pairs = [(self, other)]
        while pairs:
            x, y = pairs.pop()
            if x.shape != y.shape or x.key != y.key or x.label != y.label or len(x.kids) != len(y.kids):
                return False
            pairs += zip(x.kids, y.kids)
        return True


def below(tree: Twig) -> list[Twig]:
    """All elements, a parent before its children."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids)
    return out


class _Weights:
    """What pairs of two lists weigh, by the kinds of their elements."""

    def __init__(self, matching: Matching, xs: list[Twig], ys: list[Twig], x_kinds: list[int], y_kinds: list[int]) -> None:
        self.matching, self.xs, self.ys, self.x_kinds, self.y_kinds = matching, xs, ys, x_kinds, y_kinds
        self.known: dict[int, list[float]] = {}
        self.wide: dict[int, np.ndarray] = {}
        self.columns: np.ndarray | None = None

    def row(self, i: int) -> np.ndarray:
        """Of the i-th of the first list with all of the second."""
        kind = self.x_kinds[i]
        if kind not in self.wide:
            if self.columns is None:
                self.columns = np.array(self.y_kinds)
            if len(self.wide) * len(self.y_kinds) > MOST_CELLS:
                self.wide.clear()
            self.wide[kind] = np.array(self.known_row(i))[self.columns]
        return self.wide[kind]

    def known_row(self, i: int) -> list[float]:
        """Of the i-th of the first list with each kind of the second."""
        kind = self.x_kinds[i]
        if kind not in self.known:
            if len(self.known) * len(self.ys) > MOST_CELLS:
                self.known.clear()
            self.known[kind] = [self.matching.size(self.xs[kind], y) for y in self.ys]
        return self.known[kind]

    def sums(self, i: range, j: slice) -> Iterator[np.ndarray]:
        """Best sums of matchings of the first rows of ``i``, from none to all, with the first columns of ``j``."""
        row = np.zeros(len(range(len(self.y_kinds))[j]) + 1)
        yield row
        for k in i:
            row = np.maximum.accumulate(np.maximum(row, np.concatenate(([0.0], row[:-1] + self.row(k)[j]))))
            yield row

    def alike(self) -> bool:
        return len(self.xs) == 1 and len(self.ys) == 1

    def few(self) -> tuple[float, list[tuple[int, int]]]:
        """The best sum and its pairs, from the whole table; last pairs first."""
        n, m = len(self.x_kinds), len(self.y_kinds)
        if self.alike():
            w = float(self.known_row(0)[0])
            return w * min(n, m), [(n - 1 - k, m - 1 - k) for k in range(min(n, m))] if w else []
        weights = [self.known_row(i) for i in range(n)]
        kinds = self.y_kinds
        row = [0.0] * (m + 1)
        best = [row]
        for known in weights:
            above, row, left = row, [0.0], 0.0
            for j in range(m):
                here = above[j] + known[kinds[j]]
                if above[j + 1] > here:
                    here = above[j + 1]
                if left > here:
                    here = left
                row.append(here)
                left = here
            best.append(row)
        pairs, i, j = [], n, m
        while i and j:
            w = weights[i - 1][kinds[j - 1]]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return best[n][m], pairs

    def best(self) -> float:
        n, m = len(self.x_kinds), len(self.y_kinds)
        for row in self.sums(range(n), slice(0, m)):
            pass
        return float(row[-1])

    def paired(self, most_cells: int) -> list[tuple[int, int]]:
        out, work = [], [(0, len(self.x_kinds), 0, len(self.y_kinds))]
        while work:
            x0, x1, y0, y1 = work.pop()
            if x0 == x1 or y0 == y1:
                continue
            if (x1 - x0) * (y1 - y0) > most_cells and x1 - x0 > 1:
                half = (x0 + x1) // 2
                for head in self.sums(range(x0, half), slice(y0, y1)):
                    pass
                for tail in self.sums(range(x1 - 1, half - 1, -1), slice(y1 - 1, y0 - 1 if y0 else None, -1)):
                    pass
                cut = y0 + int((head + tail[::-1]).argmax())
                work += [(x0, half, y0, cut), (half, x1, cut, y1)]
                continue
            best = list(self.sums(range(x0, x1), slice(y0, y1)))
            i, j = x1 - x0, y1 - y0
            while i and j:
                w = self.known_row(x0 + i - 1)[self.y_kinds[y0 + j - 1]]
                if w and best[i][j] == best[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((x0 + i, y0 + j))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


class Matching:
    """The best matching of a reference tree with a page's."""

    def __init__(self, a: Twig, b: Twig, most_cells: int = MOST_CELLS) -> None:
        self.most_cells = most_cells
        ours, theirs = below(a), below(b)
        common = ({x.key for x in ours} & {y.key for y in theirs}) - {EMPTY}
        for tree in (ours, theirs):
            for x in reversed(tree):
                x.kind = hash((x.shape, x.key if x.key in common else 0, *[k.kind for k in x.kids]))
        self.sizes: dict[tuple[int, int], float] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of children, for kinds of elements with short lists
        self.root = (a, b)

    def size(self, a: Twig, b: Twig) -> float:
        """Elements that match in ``a`` and ``b``, with half an element for each equal text."""
        if a.label != b.label:
            return 0.0
        known = (a.kind, b.kind)
        found = self.sizes.get(known)
        if found is None:
            found = 1.0 + (0.5 if a.key == b.key else 0.0) + (self._best(a.kids, b.kids, known) if a.kids and b.kids else 0.0)
            self.sizes[known] = found
        return found

    def _weights(self, xs: list[Twig], ys: list[Twig]) -> _Weights:
        """``size`` of each pair; children that can't differ in it are one kind."""
        firsts, places = [], []
        for side in (xs, ys):
            kinds: dict[int, int] = {}
            first: list[Twig] = []
            place: list[int] = []
            for x in side:
                kind = kinds.get(x.kind)
                if kind is None:
                    kind = kinds[x.kind] = len(first)
                    first.append(x)
                place.append(kind)
            firsts.append(first)
            places.append(place)
        return _Weights(self, *firsts, *places)

    @staticmethod
    def _ends(xs: list[Twig], ys: list[Twig]) -> tuple[int, int]:
        """Lengths of the equal heads and tails of two lists: some best matching pairs them."""
        short = min(len(xs), len(ys))
        head = 0
        while head < short and xs[head].same(ys[head]):
            head += 1
        tail = 0
        while tail < short - head and xs[-1 - tail].same(ys[-1 - tail]):
            tail += 1
        return head, tail

    def _best(self, xs: list[Twig], ys: list[Twig], known: tuple[int, int]) -> float:
        head, tail = self._ends(xs, ys)
        ended = sum([1.5 * x.weight for x in [*xs[:head], *xs[len(xs) - tail :]]])
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if not xs or not ys:
            return ended
        weights = self._weights(xs, ys)
        if weights.alike() or len(xs) * len(ys) <= FEW_CELLS:
            best, pairs = weights.few()
            self.pairs[known] = pairs
        else:
            best = weights.best()
        return ended + best

    def _paired(self, a: Twig, b: Twig) -> list[tuple[Twig, Twig]]:
        """The pairs of the best matching in order of two elements' children."""
        xs, ys = a.kids, b.kids
        head, tail = self._ends(xs, ys)
        out = [*zip(xs[:head], ys[:head]), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :])]
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if xs and ys:
            pairs = self.pairs.get((a.kind, b.kind))
            out += [(xs[i], ys[j]) for i, j in (self._weights(xs, ys).paired(self.most_cells) if pairs is None else pairs)]
        return out

    def aligned(self) -> list[tuple[Twig, Twig]]:
        """All matched pairs of elements, from the roots down."""
        out, stack = [], [self.root] if self.size(*self.root) else []
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            if x.kids and y.kids:
                stack += self._paired(x, y)
        return out
