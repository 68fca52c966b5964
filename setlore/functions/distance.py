"""Edit distances in Python, for use inside Arrow functions."""

from __future__ import annotations


def osa_distance(a: str, b: str, cap: int | None = None) -> int:
    """Optimal string alignment distance: insert, delete, replace, swap of neighbours, each part edited once.

    With a cap, any distance beyond it comes out as cap + 1.
    """
    if a == b:
        return 0
    if cap is not None and abs(len(a) - len(b)) > cap:
        return cap + 1
    if cap is None:
        cap = max(len(a), len(b))
    far = cap + 1
    before: list[int] = []
    last = [j if j <= cap else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - cap), min(len(b), i + cap)  # no cell outside this band can be within the cap
        row = [far] * (len(b) + 1) if len(b) < 64 else _Band(far)
        if i <= cap:
            row[0] = i
        for j in range(low, high + 1):
            y = b[j - 1]
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row[j] = min(cost, far)
        before, last = last, row
    return last[len(b)]


class _Band(dict):
    """A sparse row: cells outside the band are far."""

    def __init__(self, far: int) -> None:
        super().__init__()
        self.far = far

    def __missing__(self, key: int) -> int:
        return self.far


def osa_within(a: str, b: str, most: int) -> bool:
    return a == b or (most > 0 and osa_distance(a, b, most) <= most)
