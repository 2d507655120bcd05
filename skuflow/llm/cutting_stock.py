"""Cutting-stock patterns for a histogram of lengths, by column generation.

The histogram has at most ``capacity`` entries whatever the corpus, so this small linear
program is solved where the job is planned; Spark counts the lengths and places the pieces.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), times used

#: Stop when the plan is proven to be within this share of the linear optimum.
GAP = 0.001
MAX_COLUMNS = 4000
_REFRESH = 250


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Copies of each length (any number) that fit the capacity at the highest value."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        n = ends[c]
        gain = best[c - lengths[:n]] + values[:n]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    copies = np.zeros(len(lengths))
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            copies[pick[c]] += 1
            c -= int(lengths[pick[c]])
    return float(best[capacity]), copies


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange: small matrices need no threads of a BLAS."""
    m = len(matrix)
    work = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        work -= np.outer(factors, work[k])
    return work[:, m:]


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int):
    """Columns and their amounts in the linear program's plan."""
    m = len(lengths)
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    amounts = (inverse * demand).sum(axis=1)
    for step in range(MAX_COLUMNS):
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, column = _knapsack(prices, lengths, capacity)
        # prices / value is feasible for the dual, so amounts.sum() / value bounds the plan
        if value <= 1 + GAP:
            break
        direction = (inverse * column).sum(axis=1)
        usable = direction > 1e-9
        ratio = np.where(usable, amounts / np.where(usable, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % _REFRESH == _REFRESH - 1:
            inverse = _inverse(columns)
        amounts = np.maximum((inverse * demand).sum(axis=1), 0)
    assert columns.shape == (m, m)
    return columns, amounts


def _first_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for the few pieces that rounding leaves: the longest that fits first."""
    out = []
    while left:
        room, pattern = capacity, []
        for length in sorted(left, reverse=True):
            copies = min(left[length], room // length)
            if copies:
                pattern.append((length, copies))
                room -= copies * length
        times = min(left[length] // copies for length, copies in pattern)
        for length, copies in pattern:
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        out.append((tuple(pattern), times))
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns with whole numbers of uses that take exactly the pieces of the histogram.

    The linear plan is rounded down, which leaves less than one bin for each length; what
    is left is filled longest first.
    """
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if not left:
        return []
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = np.array(sorted(left))
    columns, amounts = fractional(lengths, np.array([left[k] for k in lengths], float), capacity)
    out: list[Pattern] = []
    for j in np.argsort(-amounts, kind="stable"):
        used = [(int(lengths[i]), int(round(columns[i, j]))) for i in np.flatnonzero(columns[:, j])]
        times = int(amounts[j] + 1e-6)
        times = min([times, *(left.get(k, 0) // n for k, n in used)])
        if times > 0:
            out.append((tuple(used), times))
            for k, n in used:
                left[k] -= n * times
    return out + _first_fit({k: n for k, n in left.items() if n}, capacity)
