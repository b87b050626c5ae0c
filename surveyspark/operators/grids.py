"""One frame as arrays: the vectorised steps that pixel rows would need many shuffled or exploded rows for.

All functions take and give boolean grids of one frame, which its sensor bounds; Spark distributes frames. Outside the
frame counts as false for growing and as true for shrinking, so a mask that reaches the border keeps reaching it.
"""

from __future__ import annotations

import numpy as np


def disk(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    padded, out = np.pad(mask, r), np.zeros(mask.shape, bool)
    for a, b in disk(r):
        out |= padded[r + a:r + a + mask.shape[0], r + b:r + b + mask.shape[1]]
    return out


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    return ~dilate(~mask, r)


def close(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, r), r)


def open_(mask: np.ndarray, r: int) -> np.ndarray:
    return dilate(erode(mask, r), r)


def joined(pos: np.ndarray, frame: np.ndarray, width: int, connectivity: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For pixels sorted by frame and position: smallest position of each pixel's region, and the region's size.

    Pixels side by side form runs; runs that meet in neighbouring rows are found by binary search and joined by
    passing on the smaller root until nothing changes.
    """
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = 1 if connectivity == 8 else 0
    y, x = pos // width, pos % width
    row = frame * (int(y.max()) + 3) + y
    start = np.r_[True, (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1)]
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    last = np.r_[first[1:], len(pos)] - 1
    span = width + 4
    lo, hi, below = x[first] - reach, x[last] + reach, (row[first] + 1) * span
    a = np.searchsorted(row[last] * span + x[last], below + lo, "left")
    b = np.searchsorted(row[first] * span + x[first], below + hi, "right")
    n = np.maximum(b - a, 0)
    src = np.repeat(np.arange(len(first)), n)
    dst = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    root = np.arange(len(first))
    while True:
        p, q = root[src], root[dst]
        if np.array_equal(p, q):
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, root[root]):
            root = root[root]
    of = root[run]
    return pos[first][of], np.bincount(of, minlength=len(first))[of]


def regions(mask: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, region, area) of the true pixels."""
    pos = np.flatnonzero(mask)
    return pos, *joined(pos, np.zeros(len(pos), np.int64), mask.shape[1], connectivity)


def region_sums(mask: np.ndarray, values: np.ndarray, distance: np.ndarray, connectivity: int = 8) -> dict[str, np.ndarray]:
    """Moment sums, extent, and sums and extremes of values and distances of each region, in order of first pixels."""
    pos, region, _ = regions(mask, connectivity)
    order = np.argsort(region, kind="stable")
    pos, region = pos[order], region[order]
    first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]][:len(pos)])
    y, x = pos // mask.shape[1], pos % mask.shape[1]
    v, d = values.ravel()[pos].astype(np.int64), distance.ravel()[pos]
    if not len(pos):
        return {}
    add = lambda a: np.add.reduceat(a, first)
    low, high = (lambda a: np.minimum.reduceat(a, first)), (lambda a: np.maximum.reduceat(a, first))
    return {
        "region": region[first], "area": np.diff(np.r_[first, len(pos)]), "_sy": add(y), "_sx": add(x), "_syy": add(y * y), "_sxx": add(x * x), "_sxy": add(x * y),
        "min_y": low(y), "min_x": low(x), "max_y": high(y) + 1, "max_x": high(x) + 1,
        "_raw": add(v), "_low": low(v), "_high": high(v), "min_shore": low(d), "mean_shore": add(d) / np.diff(np.r_[first, len(pos)]),
    }


def drop_small(mask: np.ndarray, size: int, connectivity: int = 4) -> np.ndarray:
    pos, _, area = regions(mask, connectivity)
    out = np.zeros(mask.shape, bool)
    out.ravel()[pos[area >= size]] = True
    return out


def fill_small(mask: np.ndarray, size: int, connectivity: int = 4) -> np.ndarray:
    """Background regions below ``size`` join the mask, at the border too."""
    return ~drop_small(~mask, size, connectivity)


def largest(mask: np.ndarray, fraction: float = 0.05) -> np.ndarray:
    """The largest 8-connected region (of equal ones the first) if it covers more than ``fraction`` of the frame."""
    pos, region, area = regions(mask)
    out = np.zeros(mask.shape, bool)
    if len(pos) and area.max() > fraction * mask.size:
        out.ravel()[pos[region == region[area.argmax()]]] = True
    return out


def _envelope(column: np.ndarray) -> np.ndarray:
    """Least (x - u)^2 + column[u] for every x, by the lower envelope of parabolas; all rows take each step together.

    A row pushes each of its columns once and pops it at most once, so the work is linear in pixels.
    """
    height, width = column.shape
    f = column.astype(np.int64)
    rows = np.arange(height)
    centre = np.zeros((height, width), np.int64)  # columns whose parabolas form the envelope so far
    begin = np.zeros((height, width), np.int64)  # where each takes over
    top = np.zeros(height, np.int64)
    for u in range(1, width):
        live = rows
        while len(live):
            t = top[live]
            s, at = centre[live, t], begin[live, t]
            beaten = (at - s) ** 2 + f[live, s] > (at - u) ** 2 + f[live, u]
            live = live[beaten]
            top[live] -= 1
            live = live[top[live] >= 0]
        empty = top < 0
        s = centre[rows, np.maximum(top, 0)]
        over = 1 + (u * u - s * s + f[:, u] - f[rows, s]) // (2 * (u - s))
        over = np.where(empty, 0, over)
        push = rows[over < width]
        top[push] += 1
        centre[push, top[push]], begin[push, top[push]] = u, over[push]
    out = np.empty((height, width), np.int64)
    for u in range(width - 1, -1, -1):
        s = centre[rows, top]
        out[:, u] = (u - s) ** 2 + f[rows, s]
        top -= begin[rows, top] == u
    return out


def squared_distance(mask: np.ndarray, wanted: np.ndarray | None = None, steps: int = 32) -> np.ndarray:
    """Squared Euclidean distance of every cell to the nearest true one, exact at any range; -1 without one.

    Nearest true cell in the column first. Along the rows, ever farther columns are tried until none farther can be
    nearer to a ``wanted`` cell (all cells by default; others may then be too far); cells still open after ``steps``
    columns are settled by the lower envelope.
    """
    height, width = mask.shape
    if not mask.any():
        return np.full(mask.shape, -1, np.int64)
    far = height + width
    rows = np.arange(height, dtype=np.int32)[:, None]
    up = rows - np.maximum.accumulate(np.where(mask, rows, np.int32(-far)), 0)
    down = np.minimum.accumulate(np.where(mask, rows, np.int32(height + far))[::-1], 0)[::-1] - rows
    column = np.minimum(np.minimum(up, down), np.int32(far)) ** 2
    best, k = column.copy(), 1
    least = column.min(1, keepdims=True)  # no column of the row offers less
    gain = lambda: int((best - least).max() if wanted is None else (best - least)[wanted].max(initial=0))
    while k < width and k * k < gain():
        if k > steps:
            return _envelope(column)
        np.minimum(best[:, k:], column[:, :-k] + np.int32(k * k), out=best[:, k:])
        np.minimum(best[:, :-k], column[:, k:] + np.int32(k * k), out=best[:, :-k])
        k += 1
    return best.astype(np.int64)


def shore(land: np.ndarray, ocean: np.ndarray, waves: np.ndarray, r: int = 2) -> np.ndarray:
    """Ocean within ``r`` of land, and all waves."""
    return dilate(land, r) & ocean | waves


def cleaned_rules(ocean: np.ndarray, waves: np.ndarray, size: int = 100, specks: int = 25, holes: int = 200, fraction: float = 0.05) -> dict[str, np.ndarray]:
    """Surface masks after the rules: specks go, one significant ocean stays, what is neither it nor waves is land, and
    small holes of ocean and land are filled. A frame without any ocean keeps its land without specks."""
    land = drop_small(~(ocean | waves), size)
    ocean, waves = drop_small(ocean, size), drop_small(waves, specks)
    if ocean.any():
        ocean = largest(ocean, fraction)
        land = ~(ocean | waves)
    return {"ocean": fill_small(ocean, holes), "land": fill_small(land, holes), "waves": waves}


def smoothed(mask: np.ndarray, size: int) -> np.ndarray:
    """Without specks and holes below ``size``, closed by a disk of 2 and opened by a disk of 1."""
    return open_(close(fill_small(drop_small(mask, size), size), 2), 1)


def ranked(ocean: np.ndarray, land: np.ndarray, waves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Waves beat land, land beats ocean."""
    land = land & ~waves
    return ocean & ~waves & ~land, land, waves


def cleaned_ranges(ocean: np.ndarray, land: np.ndarray, waves: np.ndarray, size: int = 200, specks: int = 50) -> dict[str, np.ndarray]:
    return dict(zip(("ocean", "land", "waves"), ranked(smoothed(ocean, size), smoothed(land, size), smoothed(waves, specks))))


def cleaned_vote(
    hsv: tuple[np.ndarray, ...], lab: tuple[np.ndarray, ...], blue: np.ndarray, green: np.ndarray,
    size: int = 200, specks: int = 50, last_size: int = 500, last_specks: int = 100, reach: int = 5,
) -> dict[str, np.ndarray]:
    """Two cleaned segmentations vote (one voice for ocean or land, two for waves), strong colours join, the result is
    cleaned again, and undefined pixels near only one of ocean and land become that."""
    h, l_ = (list(cleaned_ranges(*m, size, specks).values()) for m in (hsv, lab))
    ocean, land, waves = smoothed(h[0] | l_[0] | blue, last_size), smoothed(h[1] | l_[1] | green, last_size), smoothed(h[2] & l_[2], last_specks)
    ocean, land, waves = ranked(ocean, land, waves)
    rest, near_ocean, near_land = ~(ocean | land | waves), dilate(ocean, reach), dilate(land, reach)
    return {"ocean": ocean | rest & near_ocean & ~near_land, "land": land | rest & near_land & ~near_ocean, "waves": waves}


def cleaned_land(land: np.ndarray, size: int = 100) -> np.ndarray:
    return drop_small(close(land, 2), size)


def cleaned_score(ocean: np.ndarray, size: int = 1000, holes: int = 1000) -> np.ndarray:
    """Land where the ocean score is low, after the ocean is closed and rid of specks and holes."""
    return ~fill_small(drop_small(close(ocean, 3), size), holes)
