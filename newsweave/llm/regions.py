"""Overlapping regions of unit vectors: near ones share a region.

A vector lies in the ``reach`` regions whose pivots it scores best with. Pivots are directions drawn with the
spread of the data, their scores shifted so that drawn vectors are spread evenly. How many
regions a vector needs is settled on pairs planted at the least cosine, which are of the hardest kind: a
partner in any direction, and one towards another vector.
"""

import numpy as np

# Vectors of a region, on average, and the share of planted pairs that must share one.
REGION_ROWS = 16_384
SHARED = 0.997
# Vectors that pivots are drawn, shifted and settled by, and the most regions of a vector.
DRAWN = 4_096
MOST = 31
# Scores held at once, and steps of shifting.
HELD = 1 << 22
SHIFTS = 6


class Regions:
    def __init__(self, pivots: np.ndarray, shifts: np.ndarray, reach: int) -> None:
        self.pivots, self.shifts, self.reach = pivots, shifts, reach

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float32) @ self.pivots.T - self.shifts

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The regions of unit vectors, smallest first."""
        count, found = len(self.pivots), np.empty((len(vectors), self.reach), np.int32)
        step = max(1, HELD // count)
        for at in range(0, len(vectors), step):
            # The lowest bits of a score hold its region, so that sorting values is enough.
            keys = self.scores(vectors[at : at + step]).astype(np.float64)
            keys.view(np.int64)[...] |= np.arange(count)
            best = np.partition(keys, count - self.reach, axis=1)[:, count - self.reach :]
            found[at : at + step] = np.ascontiguousarray(best).view(np.int64) & ((1 << 29) - 1)
        return np.sort(found, axis=1)


def _spread(drawn: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Directions with the spread of vectors about their mean."""
    centred = drawn - drawn.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    drawn = rng.standard_normal((count, len(axes)), np.float32) @ np.float32(axes * np.sqrt(np.maximum(values, 0))).T
    return drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-30)


def _even(regions: Regions, drawn: np.ndarray) -> None:
    """Shifts scores until the regions hold about as many of the drawn vectors each."""
    total = sum(regions.scores(drawn[at : at + 256]).sum(axis=0) for at in range(0, len(drawn), 256))
    regions.shifts = (total / len(drawn)).astype(np.float32)
    width = float(np.std(regions.scores(drawn[:256])))
    mean = len(drawn) * regions.reach / len(regions.pivots)
    for step in range(SHIFTS):
        held = np.bincount(regions.of(drawn).ravel(), minlength=len(regions.pivots))
        regions.shifts = regions.shifts + np.float32(0.4 * width / (1 + step / 4) * np.log((held + 8) / (mean + 8)))


def planted(drawn: np.ndarray, towards: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors at a cosine of ``least`` from drawn ones, in the directions given."""
    aside = towards - np.einsum("nd,nd->n", towards, drawn)[:, None] * drawn
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0.0)
    found = least * drawn + np.sqrt(max(0.0, 1 - least * least)) * aside
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def learn(drawn: np.ndarray, rows: int, least: float, seed: int = 3) -> Regions | None:
    """Regions for so many vectors, by some drawn from them; none if no number of regions is worth it."""
    rng = np.random.default_rng(seed)
    pairs = [
        planted(drawn, rng.standard_normal(drawn.shape), least),
        planted(drawn, drawn[rng.permutation(len(drawn))], least),
    ]
    size = REGION_ROWS
    while 4 * size <= rows:
        found = _least_reach(drawn, rows, size, pairs, seed)
        if found is not None:
            return found
        # Vectors that lie close need larger regions to share one.
        size *= 4
    return _least_reach(drawn, rows, REGION_ROWS, pairs, seed) if size == REGION_ROWS else None


def _least_reach(drawn: np.ndarray, rows: int, size: int, pairs: list[np.ndarray], seed: int) -> Regions | None:
    """Regions of so many vectors, and of those the ones with the least reach that is enough."""
    low, high, found = 2, MOST, None
    while low <= high:
        reach = (low + high) // 2
        regions = _of_reach(drawn, -(-rows * reach // size), reach, seed)
        if regions is not None and all(_shared(regions, drawn, near) >= SHARED for near in pairs):
            high, found = reach - 1, regions
        else:
            low = reach + 1
    return found


def _of_reach(drawn: np.ndarray, count: int, reach: int, seed: int) -> Regions | None:
    if count < 2 * reach:
        return None
    regions = Regions(_spread(drawn, count, np.random.default_rng(seed)), np.zeros(count, np.float32), reach)
    _even(regions, drawn)
    return regions


def _shared(regions: Regions, vectors: np.ndarray, near: np.ndarray) -> float:
    """The share of vectors that have a region in common with their partner."""
    return (regions.of(vectors)[:, :, None] == regions.of(near)[:, None, :]).any(axis=(1, 2)).mean()
