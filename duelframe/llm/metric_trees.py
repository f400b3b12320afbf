"""Metric trees by the anchors hierarchy, and passes over them that use whole balls.

A tree is built middle-out. Anchors come first: the point farthest from its anchor becomes
the next one and takes over the points nearer to it, where only points farther from their
anchor than half the way to the new one can change sides. About as many anchors as the square root
of the points are made, each ball is built the same way, and the balls are joined upwards in pairs,
those first whose common ball is smallest. Every ball caches the sum and the number of its
points, its centre and its radius.

A pass goes down the tree with the list of entries that may be nearest to some point of the
ball. Balls inherit the list of the ball above and drop every entry that is farther from all of
their points than another one. A ball left with one entry is wholly owned: its cached sum and
number go to that entry, and its points are not looked at.
"""

from __future__ import annotations

import numpy as np

#: Points of a ball that is not divided further.
LEAF = 48
#: Relative room for rounding when balls and entries are compared; doubtful entries stay.
SLACK = 1e-9


def _anchors(points: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """Owner of each point, and the number of anchors made."""
    owner = np.zeros(len(points), dtype=np.int64)
    places = points[:1]
    away = np.sqrt(((points - places[0]) ** 2).sum(axis=1))
    while len(places) < count:
        farthest = int(away.argmax())
        if away[farthest] == 0:
            break
        new = points[farthest]
        halfway = np.sqrt(((places - new) ** 2).sum(axis=1)) / 2
        undecided = np.flatnonzero(away > halfway[owner] * (1 - SLACK))
        to_new = np.sqrt(((points[undecided] - new) ** 2).sum(axis=1))
        nearer = to_new < away[undecided]
        owner[undecided[nearer]] = len(places)
        away[undecided[nearer]] = to_new[nearer]
        places = np.vstack([places, new])
    return owner, len(places)


class _Builder:
    def __init__(self, points: np.ndarray):
        self.points, self.floats = points, points.astype(np.float64)
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.total: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.root = self._divide(np.arange(len(points)))

    def _ball(self, members: np.ndarray, total: np.ndarray, children: tuple[int, int]) -> int:
        centre = total / len(members)
        self.members.append(members)
        self.children.append(children)
        self.total.append(total)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((self.floats[members] - centre) ** 2).sum(axis=1).max())))
        return len(self.members) - 1

    def _leaf(self, members: np.ndarray) -> int:
        return self._ball(members, self.points[members].sum(axis=0), (-1, -1))

    def _divide(self, members: np.ndarray) -> int:
        if len(members) <= LEAF:
            return self._leaf(members)
        owner, count = _anchors(self.floats[members], int(np.ceil(np.sqrt(len(members)))))
        if count == 1:  # all points are the same
            return self._leaf(members)
        order = np.argsort(owner, kind="stable")
        parts = np.split(members[order], np.cumsum(np.bincount(owner, minlength=count))[:-1])
        return self._join([self._divide(part) for part in parts if len(part)])

    def _common(self, one: int, others: list[int]) -> np.ndarray:
        """Radius of the smallest ball around ``one`` and each of the others."""
        centres, radii = np.array([self.centre[i] for i in others]), np.array([self.radius[i] for i in others])
        apart = np.sqrt(((centres - self.centre[one]) ** 2).sum(axis=1))
        return np.maximum(np.maximum(radii, self.radius[one]), (apart + radii + self.radius[one]) / 2)

    def _join(self, balls: list[int]) -> int:
        common = np.full((len(balls), len(balls)), np.inf)
        for i in range(1, len(balls)):
            common[i, :i] = self._common(balls[i], balls[:i])
        for _ in range(len(balls) - 1):
            i, j = divmod(int(common.argmin()), len(balls))
            left, right = balls[j], balls[i]
            both = np.concatenate([self.members[left], self.members[right]])
            balls[j] = self._ball(both, self.total[left] + self.total[right], (left, right))
            common[i, :] = common[:, i] = np.inf
            alive = [k for k in range(len(balls)) if k != j and balls[k] >= 0 and k != i]
            balls[i] = -1
            if alive:
                radii = self._common(balls[j], [balls[k] for k in alive])
                for k, radius in zip(alive, radii):
                    common[max(j, k), min(j, k)] = radius
            else:
                return balls[j]
        return balls[0]


class Tree:
    """A tree over whole-number points: points in tree order, and its balls from the top down.

    ``first`` and ``last`` are a ball's points in that order; ``left`` and ``right`` its halves,
    -1 for a leaf.
    """

    FIELDS = (("order", "<i4"), ("points", "<i4"), ("first", "<i4"), ("last", "<i4"), ("left", "<i4"), ("right", "<i4"), ("total", "<i8"), ("radius", "<f8"))

    def __init__(self, points: np.ndarray | None = None):
        if points is None:
            return
        built = _Builder(points)
        balls, at = [built.root], 0
        while at < len(balls):
            balls += [child for child in built.children[balls[at]] if child >= 0]
            at += 1
        number = {ball: i for i, ball in enumerate(balls)}
        self.left, self.right = (np.array([number.get(built.children[b][side], -1) for b in balls], np.int64) for side in (0, 1))
        sizes = np.array([len(built.members[b]) for b in balls])
        self.first = np.zeros(len(balls), np.int64)
        for i in range(len(balls)):  # a ball stands above its halves
            if self.left[i] >= 0:
                self.first[self.left[i]] = self.first[i]
                self.first[self.right[i]] = self.first[i] + sizes[self.left[i]]
        self.last = self.first + sizes
        self.order = np.zeros(len(points), np.int64)
        for i, ball in enumerate(balls):
            if self.left[i] < 0:
                self.order[self.first[i] : self.last[i]] = built.members[ball]
        self.points = points[self.order]
        self.total = np.array([built.total[b] for b in balls], np.int64)
        self.radius = np.array([built.radius[b] for b in balls])

    def to_bytes(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), dtype=kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def from_bytes(cls, fields: list[bytes], width: int) -> Tree:
        tree = cls()
        for (name, kind), raw in zip(cls.FIELDS, fields):
            values = np.frombuffer(raw, kind).astype(kind[1] + "8")
            setattr(tree, name, values.reshape(-1, width) if name in ("points", "total") else values)
        return tree

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every point in tree order (ties: the first), and the points' sums and number by entry."""
        nearest = np.zeros(len(self.order), dtype=np.int64)
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        # Of equal entries only the first can own anything.
        firsts = np.zeros(len(entries), dtype=bool)
        firsts[np.unique(entries, axis=0, return_index=True)[1]] = True
        places = entries.astype(np.float64)
        sizes = self.last - self.first
        balls, listed = np.zeros(1, np.int64), firsts[None, :]
        while len(balls):
            centres = self.total[balls] / sizes[balls, None]
            away = np.sqrt(((centres[:, None, :] - places) ** 2).sum(axis=2))
            best = np.where(listed, away, np.inf).min(axis=1, keepdims=True)
            reach = 2 * self.radius[balls, None]
            listed = listed & (away <= best + reach + SLACK * (1 + best + reach))
            whole = listed.sum(axis=1) == 1
            for ball, entry in zip(balls[whole].tolist(), listed[whole].argmax(axis=1).tolist()):
                nearest[self.first[ball] : self.last[ball]] = entry
                sums[entry] += self.total[ball]
                counts[entry] += sizes[ball]
            balls, listed = balls[~whole], listed[~whole]
            leaf = self.left[balls] < 0
            for ball, possible in zip(balls[leaf].tolist(), listed[leaf]):
                chosen = np.flatnonzero(possible)
                own = self.points[self.first[ball] : self.last[ball]]
                found = chosen[((own[:, None, :] - entries[chosen]) ** 2).sum(axis=2).argmin(axis=1)]
                nearest[self.first[ball] : self.last[ball]] = found
                np.add.at(sums, found, own)
                counts += np.bincount(found, minlength=len(entries))
            inner, passed = balls[~leaf], listed[~leaf]
            balls, listed = np.concatenate([self.left[inner], self.right[inner]]), np.concatenate([passed, passed])
        return nearest, sums, counts
