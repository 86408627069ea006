"""A shape made of disjoint boxes: what cutting boxes out of boxes leaves."""

from __future__ import annotations

from dataclasses import dataclass

Box = tuple[float, float, float, float]


@dataclass
class Cells:
    boxes: list[Box]

    @classmethod
    def of_box(cls, *b: float) -> Cells:
        return cls([tuple(map(float, b))])

    @property
    def area(self) -> float:
        return sum((c - a) * (d - b) for a, b, c, d in self.boxes)

    def intersection_area(self, other: Cells) -> float:
        return self.common(other).area

    def common(self, other: Cells) -> Cells:
        found = [(max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])) for p in self.boxes for q in other.boxes]
        return Cells([b for b in found if b[0] < b[2] and b[1] < b[3]])

    def minus(self, other: Cells) -> Cells:
        left = self.boxes
        for q in other.boxes:
            rest = []
            for a, b, c, d in left:
                x0, y0, x1, y1 = max(a, q[0]), max(b, q[1]), min(c, q[2]), min(d, q[3])
                if x0 >= x1 or y0 >= y1:
                    rest.append((a, b, c, d))
                    continue
                pieces = ((a, b, c, y0), (a, y1, c, d), (a, y0, x0, y1), (x1, y0, c, y1))
                rest += [p for p in pieces if p[0] < p[2] and p[1] < p[3]]
            left = rest
        return Cells(left)

    def parts(self) -> list[Cells]:
        """Groups of boxes that share a piece of border."""
        todo, out = list(self.boxes), []
        while todo:
            group, front = [], [todo.pop()]
            while front:
                p = front.pop()
                group.append(p)
                near = [q for q in todo if _touch(p, q)]
                todo = [q for q in todo if q not in near]
                front += near
            out.append(Cells(group))
        return out


def _touch(p: Box, q: Box) -> bool:
    x = min(p[2], q[2]) - max(p[0], q[0])
    y = min(p[3], q[3]) - max(p[1], q[1])
    return x >= 0 and y >= 0 and x + y > 0
