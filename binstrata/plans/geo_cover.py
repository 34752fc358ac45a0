"""Cells of the S2 grid, and least covers of sets of cells, on the driver.

A cell id has 64 bits: three of face, two for each level along the face's Hilbert curve, and a marker
bit. Here ids are unsigned Python integers; columns hold the same bits as signed bigints.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

MAX_LEVEL = 30
# fixed values: the public S2 curve, position of (i, j) and change of orientation by position
_IJ_TO_POS = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
_TURN = np.array([1, 0, 0, 3])


def lsb(level: int) -> int:
    """The marker bit of a level."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"no level {level}")
    return 1 << 2 * (MAX_LEVEL - level)


def level_of(cell: int) -> int:
    low = (cell & -cell).bit_length() - 1
    if cell <= 0 or low % 2:
        raise ValueError(f"no cell id: {cell}")
    return MAX_LEVEL - low // 2


def parent(cell: int, level: int | None = None) -> int:
    own = level_of(cell)
    level = own - 1 if level is None else level
    if not 0 <= level < own:
        raise ValueError(f"level {level} is not coarser than {own}")
    return cell & -(2 * lsb(level)) | lsb(level)


def children(cell: int) -> list[int]:
    step = lsb(level_of(cell) + 1)
    return [cell + k * step for k in (-3, -1, 1, 3)]


def to_token(cell: int) -> str:
    return f"{cell:016x}".rstrip("0") or "X"


def from_token(token: str) -> int:
    if token in ("X", "x"):
        return 0
    if not 1 <= len(token) <= 16:
        raise ValueError(f"no token: {token!r}")
    return int(token.ljust(16, "0"), 16)


def descendants(cell: int, level: int) -> tuple[int, int]:
    """Inclusive range of the ids of a cell's descendants at a level."""
    own = level_of(cell)
    if level < own:
        raise ValueError(f"level {level} is coarser than the cell's {own}")
    half = lsb(own) - lsb(level)
    return cell - half, cell + half


def merge_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive ranges; overlapping and adjacent ones become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def intersect_ranges(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intersection of two sets of inclusive ranges, by one sweep over both."""
    x, y, out = merge_ranges(a), merge_ranges(b), []
    i = j = 0
    while i < len(x) and j < len(y):
        lo, hi = max(x[i][0], y[j][0]), min(x[i][1], y[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if x[i][1] < y[j][1]:
            i += 1
        else:
            j += 1
    return out


def cover_ranges(cells: Iterable[int], level: int) -> list[tuple[int, int]]:
    """Merged ranges of the descendants of cells of mixed levels."""
    return merge_ranges(descendants(c, level) for c in cells)


def cells_at(lat: np.ndarray, lng: np.ndarray, level: int) -> np.ndarray:
    """Cell ids (uint64) of points in degrees, vectorized."""
    phi, theta = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    p = np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)])
    axis = np.argmax(np.abs(p), axis=0)
    main = np.take_along_axis(p, axis[None], 0)[0]
    face = np.where(main < 0, axis + 3, axis)
    x, y, z = p
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.select([face == k for k in range(6)], [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.select([face == k for k in range(6)], [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    i, j = (np.clip(np.floor(_st(w) * (1 << MAX_LEVEL)), 0, (1 << MAX_LEVEL) - 1).astype(np.int64) for w in (u, v))
    turn, out = face & 1, face.astype(np.uint64)
    for k in range(MAX_LEVEL - 1, MAX_LEVEL - 1 - level, -1):
        pos = _IJ_TO_POS[turn, 2 * ((i >> k) & 1) + ((j >> k) & 1)]
        out = (out << np.uint64(2)) | pos.astype(np.uint64)
        turn = turn ^ _TURN[pos]
    low = np.uint64(2 * (MAX_LEVEL - level) + 1)
    return (out << low) | (np.uint64(1) << (low - np.uint64(1)))


def _st(u: np.ndarray) -> np.ndarray:
    r = np.sqrt(1 + 3 * np.abs(u))
    return np.where(u >= 0, 0.5 * r, 1 - 0.5 * r)


def cell_samples(cell: int, n: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes (degrees) of an n x n grid over a cell, its edges included."""
    level, face = level_of(cell), cell >> 61
    turn, i, j = face & 1, 0, 0
    inverse = np.argsort(_IJ_TO_POS, axis=1)
    for k in range(level):
        pos = (cell >> (61 - 2 * (k + 1))) & 3
        ij = int(inverse[turn, pos])
        i, j = i << 1 | ij >> 1, j << 1 | ij & 1
        turn ^= int(_TURN[pos])
    t = np.linspace(0, 1, n)
    s, r = np.meshgrid((i + t) / (1 << level), (j + t) / (1 << level))
    u, v = ((np.where(w >= 0.5, (4 * w * w - 1), 1 - 4 * (1 - w) ** 2)) / 3 for w in (s, r))
    one = np.ones_like(u)
    x, y, z = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)][face]
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


@dataclass(frozen=True)
class BBox:
    """A box in degrees; ``west > east`` crosses the antimeridian."""

    south: float
    west: float
    north: float
    east: float

    def contains(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        across = (lng >= self.west) | (lng <= self.east) if self.west > self.east else (lng >= self.west) & (lng <= self.east)
        return (lat >= self.south) & (lat <= self.north) & across

    def samples(self, n: int = 17) -> tuple[np.ndarray, np.ndarray]:
        width = (self.east - self.west) % 360 if self.west > self.east else self.east - self.west
        lat, lng = np.meshgrid(np.linspace(self.south, self.north, n), self.west + np.linspace(0, width, n))
        return lat.ravel(), (lng.ravel() + 180) % 360 - 180


def bbox_cells(box: BBox, level: int, max_cells: int = 10_000) -> list[int]:
    """Cells of a level that meet a box, ascending; more than ``max_cells`` raise an error.

    A cell meets the box if a point of a grid over the cell lies in the box or a point of a grid over
    the box lies in the cell; descent keeps cells whose bounds, with a margin, overlap the box's."""
    lat, lng = box.samples()
    touched = {k: set(np.unique(cells_at(lat, lng, k)).tolist()) for k in range(level + 1)}
    found = [f << 61 | lsb(0) for f in range(6)]
    for k in range(level + 1):
        kept = []
        for c in found:
            a, b = cell_samples(c, 9)
            if c in touched[k] or box.contains(a, b).any() or (k < level and _near(box, a, b)):
                kept.append(c)
        if k == level:
            found = kept
            break
        found = [x for c in kept for x in children(c)]
        if len(found) > 16 * max_cells + 24:
            raise ValueError(f"more than {max_cells} cells of level {level}")
    if len(found) > max_cells:
        raise ValueError(f"more than {max_cells} cells of level {level}")
    return sorted(found)


def _near(box: BBox, lat: np.ndarray, lng: np.ndarray) -> bool:
    margin = max(1e-9, (lat.max() - lat.min()) / 4)
    if lat.max() + margin < box.south or lat.min() - margin > box.north:
        return False
    span = lng.max() - lng.min()
    if span > 180 or max(abs(lat.max()), abs(lat.min())) > 80 or box.west > box.east:
        return True
    side = max(1e-9, span / 4)
    return not (lng.max() + side < box.west or lng.min() - side > box.east)


def pick_resolution(box: BBox, resolutions: Sequence[int], budget: int, cells=None) -> tuple[int, list[int]]:
    """The finest resolution (given finest first) with at least one and at most ``budget`` cells; else the
    coarsest that has any; else the centre's cell at the coarsest."""
    cells = cells or (lambda r: _try(box, r, budget))
    last = None
    for r in resolutions:
        got = cells(r)
        if got is None:
            continue
        if 0 < len(got) <= budget:
            return r, got
        if got:
            last = (r, got)
    if last:
        return last
    r = resolutions[-1]
    width = (box.east - box.west) % 360 if box.west > box.east else box.east - box.west
    centre = cells_at(np.array([(box.south + box.north) / 2]), np.array([(box.west + width / 2 + 180) % 360 - 180]), r)
    return r, [int(centre[0])]


def _try(box: BBox, r: int, budget: int) -> list[int] | None:
    try:
        return bbox_cells(box, r, max(budget, 10_000))
    except ValueError:
        return None


@dataclass
class Node:
    """A node of a containment forest. Leaves can be wanted; every node can be a term."""

    term: object
    leaf: bool = False
    kids: list[Node] = field(default_factory=list)
    wanted: int = 0
    other: int = 0


def least_cover(roots: Sequence[Node], wanted: set, subtract: bool = True) -> tuple[list, list]:
    """``(include, exclude)``: the fewest terms whose nearest ones above select exactly the wanted leaves.

    For each node two costs are known from its children's: of selecting its wanted leaves when nothing
    above is included, and of taking away the others when something is. Either way the node itself
    may be turned around for one term; plain listing wins a tie."""
    order: list[Node] = []
    todo = list(roots)
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    cost: dict[int, tuple[int, int]] = {}
    for n in reversed(order):
        n.wanted = sum(k.wanted for k in n.kids) + (n.leaf and n.term in wanted)
        n.other = sum(k.other for k in n.kids) + (n.leaf and n.term not in wanted)
        add, drop = (sum(cost[id(k)][x] for k in n.kids) for x in (0, 1))
        pos = 0 if not n.wanted else 1 if not n.other else min(add, 1 + drop) if subtract else add
        neg = 0 if not n.other else 1 if not n.wanted else min(drop, 1 + add)
        cost[id(n)] = (pos, neg)
    include: list = []
    exclude: list = []
    work = [(r, True) for r in reversed(roots)]
    while work:
        n, plus = work.pop()
        mine, foreign = (n.wanted, n.other) if plus else (n.other, n.wanted)
        if not mine:
            continue
        listed = sum(cost[id(k)][0 if plus else 1] for k in n.kids)
        if not foreign or ((subtract or not plus) and 1 + sum(cost[id(k)][1 if plus else 0] for k in n.kids) < listed):
            (include if plus else exclude).append(n.term)
            plus = not plus
            if not foreign:
                continue
        work += [(k, plus) for k in reversed(n.kids)]
    return include, exclude


def minimal_cover(include: Iterable[int], system: Iterable[int], subtract: bool = True, coarsest: int = 0) -> tuple[list[int], list[int]]:
    """Least ± cover of the cells ``include`` among the cells ``system``; terms are these cells and their
    ancestors down from level ``coarsest``. Cells of the system must not contain each other."""
    want = set(include)
    cells = want | set(system)
    if not want:
        return [], []
    nodes = {c: Node(c, True) for c in cells}
    tops: dict[int, set[int]] = {}
    for c in cells:
        tops.setdefault(level_of(c), set()).add(c)
    roots: list[Node] = []
    while tops:
        level = max(tops)
        if level <= coarsest or (len(tops) == 1 and len(tops[level]) == 1):
            roots += [nodes[c] for k in sorted(tops) for c in sorted(tops[k])]
            break
        for c in sorted(tops.pop(level)):
            p = parent(c)
            if p in cells:
                raise ValueError("cells of the system contain each other")
            nodes.setdefault(p, Node(p)).kids.append(nodes[c])
            tops.setdefault(level - 1, set()).add(p)
    return least_cover(roots, want, subtract)


def vocabulary_forest(cells: Iterable[int], leaves: Mapping[str, int]) -> list[Node]:
    """Containment forest of a stored vocabulary: each cell under its nearest ancestor among the cells,
    each leaf, by key, under the finest cell that contains its own."""
    vocab = {c: Node(c) for c in dict.fromkeys(cells)}

    def above(c: int | None) -> Node | None:
        while c is not None:
            if c in vocab:
                return vocab[c]
            c = parent(c) if level_of(c) else None
        return None

    roots: list[Node] = []
    for c, n in vocab.items():
        up = above(parent(c)) if level_of(c) else None
        (up.kids if up else roots).append(n)
    for key, c in leaves.items():
        up = above(c)
        (up.kids if up else roots).append(Node(key, True))
    return roots


def vocabulary_cover(roots: Sequence[Node], wanted: Iterable[str], positive_only: bool = False) -> tuple[list, list]:
    """Least ± list of vocabulary terms that selects exactly the wanted keys; unknown keys raise."""
    want = set(wanted)
    known: set = set()
    todo = list(roots)
    while todo:
        n = todo.pop()
        todo += n.kids
        if n.leaf:
            known.add(n.term)
    if want - known:
        raise ValueError(f"unknown keys: {sorted(want - known)[:5]}")
    return least_cover(roots, want, not positive_only)


def in_cover(cell: int, include: set[int], exclude: set[int]) -> bool:
    """Whether the nearest term at or above a cell is an included one."""
    while True:
        if cell in exclude:
            return False
        if cell in include:
            return True
        if level_of(cell) == 0:
            return False
        cell = parent(cell)
