"""Differences of two regions, shown only where one minimum edit explains them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

BUDGET = 65_536
#: Cells of the cost tables held at once; one pair within the budget always fits.
HELD = 1 << 21
KINDS = {"unchanged": "=", "substitution": "X", "removed": "D", "added": "I"}


def _codes(texts: list[str], size: int) -> np.ndarray:
    return np.array([[ord(c) for c in t] for t in texts], dtype=np.int32).reshape(len(texts), size)


def edit_tables(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each pair of prefixes, and how many minimum scripts the whole has (2 stands for more).

    Rows are pairs of one shape; cells of an anti-diagonal do not depend on each other and are done at once.
    """
    k, m = before.shape
    n = after.shape[1]
    far = m + n + 1
    cost = np.full((k, m + 1, n + 1), far, dtype=np.int32)
    ways = np.zeros((k, m + 1, n + 1), dtype=np.int8)
    cost[:, 0, 0], ways[:, 0, 0] = 0, 1
    for d in range(1, m + n + 1):
        i = np.arange(max(0, d - n), min(m, d) + 1)
        j = d - i
        found = []
        for back_i, back_j in ((1, 1), (1, 0), (0, 1)):
            ok = (i >= back_i) & (j >= back_j)
            pi, pj = np.where(ok, i - back_i, 0), np.where(ok, j - back_j, 0)
            step = 1
            if back_i and back_j and m and n:
                step = before[:, np.where(ok, i - 1, 0)] != after[:, np.where(ok, j - 1, 0)]
            found.append((np.where(ok, cost[:, pi, pj] + step, far + 1), ways[:, pi, pj]))
        least = np.minimum(np.minimum(found[0][0], found[1][0]), found[2][0])
        cost[:, i, j] = least
        ways[:, i, j] = np.minimum(2, sum(np.where(c == least, w, 0) for c, w in found))
    return cost, ways[:, m, n]


def _script(cost: np.ndarray, before: str, after: str) -> str:
    """The only minimum script, read back from the end."""
    i, j = cost.shape[0] - 1, cost.shape[1] - 1
    out = []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (before[i - 1] != after[j - 1]):
            out.append(KINDS["unchanged" if before[i - 1] == after[j - 1] else "substitution"])
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            out.append(KINDS["removed"])
            i -= 1
        else:
            out.append(KINDS["added"])
            j -= 1
    return "".join(reversed(out))


def _compare(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for before, after in parts:
        out: list[tuple] = [("unresolved_budget", None, None)] * len(before)
        shapes: dict[tuple[int, int], list[int]] = {}
        for at, (b, a) in enumerate(zip(before, after, strict=True)):
            if b is None or a is None:
                out[at] = ("unassessed", None, None)
            elif (len(b) + 1) * (len(a) + 1) <= BUDGET:
                if b == a:
                    out[at] = ("identical", 0, KINDS["unchanged"] * len(b))
                else:
                    shapes.setdefault((len(b), len(a)), []).append(at)
        for (m, n), rows in shapes.items():
            step = max(1, HELD // ((m + 1) * (n + 1)))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                cost, ways = edit_tables(_codes([before[r] for r in part], m), _codes([after[r] for r in part], n))
                for r, c, w in zip(part, cost, ways, strict=True):
                    alone = w == 1
                    out[r] = ("unique_minimum_edit" if alone else "ambiguous_minimum_edit", int(c[m, n]), _script(c, before[r], after[r]) if alone else None)
        frame = pd.DataFrame(out, columns=["correspondence", "edits", "script"])
        yield frame.astype({"edits": "Int32"})


def region_difference(before: Column, after: Column) -> Column:
    """(correspondence, edits, script) of two regions.

    ``identical``; ``unique_minimum_edit`` with its script (= X D I: unchanged, substitution, removed, added);
    ``ambiguous_minimum_edit`` where several scripts are least; ``unresolved_budget`` beyond 65,536 cells; and
    ``unassessed`` where a region is null.
    """
    return F.pandas_udf(_compare, "correspondence string, edits int, script string")(before, after)
