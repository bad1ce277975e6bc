"""The growing map as a small state machine on the driver: no samples, no Spark.

Neurons are numbered in the order they are added. Links are kept in the order
they are made, since two-neighbour insertion depends on which came first.
"""

from __future__ import annotations

import numpy as np

from somatlas.operators.topology import hop_matrix

Cell = tuple[int, int]
STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


class GrowingMap:
    def __init__(self, seeds: np.ndarray):
        """A 2 x 2 square of four prototypes, at (0,0), (0,1), (1,0), (1,1)."""
        self.cells: list[Cell] = [(0, 0), (0, 1), (1, 0), (1, 1)]
        self.weights = np.array(seeds, dtype=float)
        self.created = [0, 0, 0, 0]
        self.errors = np.zeros(4)
        self.at = {c: i for i, c in enumerate(self.cells)}
        self.links: list[list[int]] = [[] for _ in self.cells]
        for a, b in ((0, 1), (0, 2), (1, 3), (2, 3)):
            self._link(a, b)

    @classmethod
    def of(cls, cells: list[Cell], weights: np.ndarray, errors: np.ndarray | None = None) -> GrowingMap:
        """A map of any shape; grid neighbours are linked in the order of the cells."""
        self = cls.__new__(cls)
        self.cells, self.weights, self.created = list(cells), np.array(weights, dtype=float), [0] * len(cells)
        self.errors = np.zeros(len(cells)) if errors is None else np.array(errors, dtype=float)
        self.at = {c: i for i, c in enumerate(self.cells)}
        self.links = [[] for _ in self.cells]
        for i, (x, y) in enumerate(self.cells):
            for dx, dy in STEPS:
                j = self.at.get((x + dx, y + dy))
                if j is not None and j > i:
                    self._link(i, j)
        return self

    def __len__(self) -> int:
        return len(self.cells)

    def _link(self, a: int, b: int) -> None:
        self.links[a].append(b)
        self.links[b].append(a)

    def edges(self) -> list[tuple[int, int]]:
        return [(i, j) for i, near in enumerate(self.links) for j in near]

    def hops(self) -> np.ndarray:
        return hop_matrix(len(self), self.edges())

    def degree(self, i: int) -> int:
        return len(self.links[i])

    def add(self, cell: Cell, weight: np.ndarray, epoch: int) -> int:
        new = len(self.cells)
        self.cells.append(cell)
        self.at[cell] = new
        self.weights = np.vstack([self.weights, weight])
        self.created.append(epoch)
        self.errors = np.append(self.errors, 0.0)
        self.links.append([])
        for dx, dy in STEPS:
            j = self.at.get((cell[0] + dx, cell[1] + dy))
            if j is not None:
                self._link(new, j)
        return new

    def distribute_errors(self, threshold: float) -> None:
        """An inner neuron above the threshold keeps half of its error; its boundary neighbours share the rest, which is lost where there are none."""
        for i in [i for i in range(len(self)) if self.degree(i) == 4 and self.errors[i] > threshold]:
            self.errors[i] /= 2
            takers = [j for j in self.links[i] if self.degree(j) < 4]
            for j in takers:
                self.errors[j] += self.errors[i] / len(takers)

    def grow(self, threshold: float, epoch: int, interior_blocks: bool = False) -> int:
        """Insert next to every boundary neuron above the threshold, largest error first; returns the number of new neurons.

        ``interior_blocks`` ends the pass at the first inner neuron, even though it is above the threshold.
        """
        before, errors = len(self), self.errors.copy()
        for i in sorted(range(before), key=lambda i: (-errors[i], i)):
            if errors[i] <= threshold:
                break
            if self.degree(i) < 4:
                self.insert(i, epoch)
            elif interior_blocks:
                break
        return len(self) - before

    def insert(self, i: int, epoch: int) -> None:
        (x, y), near = self.cells[i], self.links[i]
        if len(near) == 3:
            cell = next(c for dx, dy in STEPS if (c := (x + dx, y + dy)) not in self.at)
            opposite = self.at[2 * x - cell[0], 2 * y - cell[1]]
            self._mirror(i, opposite, cell, epoch)
        elif len(near) == 2:
            self._insert_two(i, near[0], near[1], epoch)
        elif len(near) == 1:
            self._insert_three(i, near[0], epoch)

    def _mirror(self, i: int, j: int, cell: Cell, epoch: int) -> None:
        self.add(cell, 2 * self.weights[i] - self.weights[j], epoch)

    def _reflected(self, i: int, j: int) -> Cell:
        return 2 * self.cells[i][0] - self.cells[j][0], 2 * self.cells[i][1] - self.cells[j][1]

    def _insert_two(self, i: int, a: int, b: int, epoch: int) -> None:
        (x, y), ca, cb = self.cells[i], self.cells[a], self.cells[b]
        if ca[0] == cb[0]:
            self._mirror(i, b, (x + 1, y), epoch)
        elif ca[1] == cb[1]:
            self._mirror(i, a, (x, y + 1), epoch)
        else:
            away = b if self.errors[a] > self.errors[b] else a
            self._mirror(i, away, self._reflected(i, away), epoch)

    def _insert_three(self, i: int, nb: int, epoch: int) -> None:
        x, y = self.cells[i]
        diagonal = {(x + dx, y + dy) for dx in (-1, 1) for dy in (-1, 1)}
        sides = sorted((j for j in self.links[nb] if self.cells[j] in diagonal), key=lambda j: self.cells[j])
        if not sides or self.errors[nb] > max(self.errors[j] for j in sides):
            self._mirror(i, nb, self._reflected(i, nb), epoch)
            return
        side = sides[0] if len(sides) == 1 or self.errors[sides[0]] > self.errors[sides[1]] else sides[1]
        cs, cn = self.cells[side], self.cells[nb]
        cell = (cs[0] + x - cn[0], cs[1] + y - cn[1])
        self.add(cell, ((2 * self.weights[i] - self.weights[nb]) + self.weights[side]) / 2, epoch)

    def without(self, dead: np.ndarray) -> GrowingMap:
        """The map without the neurons marked; the rest keep their order."""
        live = [i for i in range(len(self)) if not dead[i]]
        out = GrowingMap.of([self.cells[i] for i in live], self.weights[live], self.errors[live])
        out.created = [self.created[i] for i in live]
        return out

    def u_matrix(self, scope: str = "local") -> np.ndarray:
        """Mean distance in input space to the grid neighbours, or to the ends of all edges; 0 for a neuron without any."""
        out = np.zeros(len(self))
        ends = [j for _, j in self.edges()]
        for i, near in enumerate(self.links):
            to = near if scope == "local" else ends
            if to:
                out[i] = np.linalg.norm(self.weights[to] - self.weights[i], axis=1).mean()
        return out
