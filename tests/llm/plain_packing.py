"""Best-fit packing over counts by size in plain Python: what the distributed sweeps are measured against."""

import numpy as np

BANDS = 32


def matched_runs(counts: np.ndarray, most: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, number, first sequence, place) of all runs, and the number of sequences.

    counts: how many documents have each size, from 0 to most.
    """
    left, done = [int(c) for c in counts], [0] * (most + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]  # by size: ranges of sequences
    runs, opened = [], 0

    def place(size: int, first: int, n: int, gap: int, new: list) -> None:
        runs.append((size, done[size], n, first, most - gap))
        done[size] += n
        left[size] -= n
        new.append((gap - size, first, n))

    top = most
    while top >= 1:
        floor = top - max(1, top // BANDS)
        while any(left[floor + 1 : top + 1]):
            new: list[tuple[int, int, int]] = []
            stack: list[int] = []  # sizes with gaps, the smallest last
            for size in range(most, floor, -1):
                if gaps[size]:
                    stack.append(size)
                while size <= top and left[size] and stack:
                    gap = stack[-1]
                    first, n = gaps[gap].pop()
                    if n > left[size]:
                        gaps[gap].append((first + left[size], n - left[size]))
                        n = left[size]
                    place(size, first, n, gap, new)
                    if not gaps[gap]:
                        stack.pop()
            if not new:  # no gap is left for any of them
                total = sum(size * left[size] for size in range(floor + 1, top + 1))
                opening = max(-(-total // most), sum(left[max(floor, most // 2) + 1 : top + 1]))
                for size in range(top, floor, -1):
                    if n := min(opening, left[size]):
                        place(size, opened, n, most, new)
                        opened += n
                        opening -= n
            for gap, first, n in new:
                if gap:
                    gaps[gap].append((first, n))
        top = floor
    return runs, opened
