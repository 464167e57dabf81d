"""Grade differences of near samples, in the arrays of one task.

With the rows in order of grade and cut into parts, a pair of rows of two parts
differs by the higher grade less the lower one, so sums per site and part give
the total over all such pairs. Pairs of one part go to its own parts, and in the
end meet directly. No pair is held, and no sample is copied to its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from corelode.operators.neighbours import EARTH_KM, unit_vectors, within_km

# rows that meet each other directly
DIRECT_ROWS = 8_192
# most parts of a step, and values of one array of sites by parts
MOST_PARTS = 64
STEP_VALUES = 1 << 22
# distances of one numpy pass
PASS_DISTANCES = 1 << 21


def _firsts(sorted_rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    upto = sizes.cumsum()
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


class Neighbourhoods:
    """Places in order of cells (``order``, ``starts``), and for each run of them what is near.

    A cell is a part of a cube whose side is the chord of the distance, so what
    is near lies in the cubes around. Cells that are near as a whole, by their
    centres and radii, are told by number; the places of those in doubt are measured.
    """

    def __init__(self, places: np.ndarray, km: float, whole: bool = True) -> None:
        self.km, self.whole, self.chord = km, whole, 2 * math.sin(min(km / EARTH_KM / 2, math.pi / 2))
        side = max(self.chord * (1 + 1e-6), 1e-9)
        v = unit_vectors(*places.T)
        cells = np.floor(v / side).astype(np.int64)
        order = np.lexsort(cells.T)
        cuts = min(12, max(1, int(math.sqrt(len(places) / len(_firsts(cells[order])) / 8)))) if whole else 1
        if cuts > 1:
            cells = np.concatenate([np.floor(v / (side / cuts)).astype(np.int64), cells], axis=1)
            order = np.lexsort(cells.T)
        cells, v = cells[order], v[order]
        self.order, self.places, self.v, self.starts = order, places[order], v, _firsts(cells)
        self.ends = np.r_[self.starts[1:], len(places)]
        sizes = self.ends - self.starts
        self.centre = np.add.reduceat(v, self.starts) / sizes[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(np.square(v - np.repeat(self.centre, sizes, axis=0)).sum(axis=1), self.starts))
        cubes = cells[self.starts, -3:]
        self.cube_starts = _firsts(cubes)
        self.cube_ends = np.r_[self.cube_starts[1:], len(cubes)]
        self.cubes = {tuple(c): i for i, c in enumerate(cubes[self.cube_starts].tolist())}

    def __iter__(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """A run of places, the cells that are near as a whole, the other places in question and which of them are near."""
        around = range(-1, 2)
        for (x, y, z), cube in self.cubes.items():
            met = [i for dx in around for dy in around for dz in around if (i := self.cubes.get((x + dx, y + dy, z + dz))) is not None]
            cells = _ranges(self.cube_starts[met], self.cube_ends[met])
            mine = np.arange(self.cube_starts[cube], self.cube_ends[cube])
            inside = np.zeros((len(mine), len(cells)), bool)
            doubt = ~inside
            if self.whole:
                gap = np.sqrt(np.square(self.centre[mine][:, None] - self.centre[cells]).sum(axis=2))
                reach = self.radius[mine][:, None] + self.radius[cells]
                inside = gap + reach <= self.chord * (1 - 1e-6)
                doubt = ~inside & (gap - reach <= self.chord * (1 + 1e-6) + 1e-12)
            for row, cell in enumerate(mine):
                others = _ranges(self.starts[cells[doubt[row]]], self.ends[cells[doubt[row]]])
                step = max(1, PASS_DISTANCES // (len(others) + 1))
                for at in range(self.starts[cell], self.ends[cell], step):
                    run = slice(at, min(at + step, self.ends[cell]))
                    if len(others):
                        (near,) = within_km(self.places[run], self.places[others], [self.km], (self.v[run], self.v[others]))
                    else:
                        near = np.zeros((run.stop - run.start, 0), bool)
                    yield run, cells[inside[row]], others, near


def _leading(values: np.ndarray) -> np.ndarray:
    """For each part the sum of those below less the sum of those above."""
    upto = values.cumsum(axis=1)
    return 2 * upto - values - upto[:, -1:]


def differences(site: np.ndarray, g: np.ndarray, n: np.ndarray, places: np.ndarray, km: float, direct: int = DIRECT_ROWS) -> float:
    """Total grade difference of all near pairs, both ways: rows in order of grade ``g`` stand for ``n`` samples at ``places[site]``."""
    if len(g) <= direct:
        near = Neighbourhoods(places[site], km, whole=False)
        g, n = g[near.order], n[near.order]
        return sum(float(n[run] @ (np.where(met, np.abs(g[run][:, None] - g[others]), 0.0) @ n[others])) for run, _, others, met in near)
    present, site = np.unique(site, return_inverse=True)
    places = places[present]
    near = Neighbourhoods(places, km)
    rank = np.empty(len(present), np.int64)
    rank[near.order] = np.arange(len(present))
    site, sites = rank[site].astype(np.int32), len(present)
    del present, rank
    parts = max(2, min(MOST_PARTS, math.ceil(len(g) / direct), STEP_VALUES // sites))
    edges = np.arange(parts + 1) * len(g) // parts
    slot = site.astype(np.int64) * parts + np.repeat(np.arange(parts), np.diff(edges))
    count, weight = (np.bincount(slot, x, sites * parts).reshape(sites, parts) for x in (n, n * (g - g[len(g) // 2])))
    del slot
    total = across(near, count, weight)
    del count, weight
    return total + sum(differences(site[i:j], g[i:j], n[i:j], near.places, km, direct) for i, j in zip(edges[:-1], edges[1:]))


def across(near: Neighbourhoods, count: np.ndarray, weight: np.ndarray) -> float:
    """The differences between different parts, from the samples and their grades by (site, part)."""
    parts = count.shape[1]
    leading = np.concatenate([_leading(count), _leading(weight)], axis=1)
    of_cells = np.add.reduceat(leading, near.starts)
    total = 0.0
    for run, inside, others, met in near:
        sums = met.astype(float) @ leading[others] + of_cells[inside].sum(axis=0)
        total += float((weight[run] * sums[:, :parts]).sum() - (count[run] * sums[:, parts:]).sum())
    return total


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal rows once, with their number, in order of element and grade."""
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()  # a task holds its rows twice at most
    element, y, x, g, _ = columns
    order = np.lexsort((x, y, g, element))
    del element, y, x, g
    for i, c in enumerate(columns):
        columns[i] = c[order]
    element, y, x, g, n = columns
    first = np.flatnonzero(np.r_[True, (element[1:] != element[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1]) | (g[1:] != g[:-1])])
    if len(first) == len(g):
        return element, y, x, g, n
    return element[first], y[first], x[first], g[first], np.add.reduceat(n, first)


def site_sums(batches: Iterable[pa.RecordBatch], part: int, km: float, rows: int) -> Iterator[pa.RecordBatch]:
    """One row per element and site of a part of the samples; an element's first row has the differences inside the part."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        coded = batch.column("Element").dictionary_encode()
        code = np.array([names.setdefault(v, len(names)) for v in coded.dictionary.to_pylist()], np.int32)
        held.append((code[np.asarray(coded.indices)], *[np.asarray(batch.column(c)) for c in ("latitude", "longitude", "g")], np.ones(len(batch))))
        size += len(batch)
        if size > 2 * rows:  # one sample may be there very often
            held = [_merged(held)]
            size, rows = len(held[0][0]), max(rows, len(held[0][0]))
    if not size:
        return
    element, *columns = _merged(held)
    for name, code in names.items():
        at = slice(*np.searchsorted(element, [code, code + 1]))
        y, x, g, n = (c[at] for c in columns)
        by_site = np.lexsort((x, y))  # keeps the order of grade within a site
        places = np.stack([y, x], axis=1)[by_site]
        first = _firsts(places)
        last = np.r_[first[1:], len(g)] - 1
        site = np.empty(len(g), np.int32)
        site[by_site] = np.repeat(np.arange(len(first)), last - first + 1)
        places, lo, hi = places[first], g[by_site[first]], g[by_site[last]]
        inside = np.zeros(len(first))
        inside[0] = differences(site, g, n, places, km)
        found = [*places.T, np.full(len(first), part, np.int32), np.bincount(site, n), np.bincount(site, n * g), lo, hi, inside]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(first)), *map(pa.array, found)], names=["Element", "latitude", "longitude", "part", "n", "sum", "lo", "hi", "difference"])


def block_differences(a: dict[str, np.ndarray], b: dict[str, np.ndarray], km: float) -> tuple[float, float, float | None]:
    """Differences between different parts, near pairs of samples and the greatest difference of two blocks of sites, one way."""
    parts = np.unique(np.concatenate([a["part"], b["part"]]))

    def by_part(block: dict[str, np.ndarray], sites: slice, name: str) -> np.ndarray:
        upto = np.r_[0, block["sizes"].cumsum()]
        rows = slice(upto[sites.start], upto[sites.stop])
        site = np.repeat(np.arange(sites.stop - sites.start), block["sizes"][sites])
        return np.bincount(site * len(parts) + np.searchsorted(parts, block["part"][rows]), block[name][rows], (sites.stop - sites.start) * len(parts)).reshape(-1, len(parts))

    def runs(block: dict[str, np.ndarray], most: int) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(block["n"]), most):
            run = slice(at, min(at + most, len(block["n"])))
            yield run, np.stack([block["latitude"][run], block["longitude"][run]], axis=1)

    total, pairs, greatest = 0.0, 0.0, -math.inf
    most = max(1, STEP_VALUES // len(parts))
    for there, other in runs(b, most):
        leading = np.concatenate([_leading(by_part(b, there, c)) for c in ("counts", "sums")], axis=1)
        for here, places in runs(a, max(1, min(most, PASS_DISTANCES // len(other)))):
            (near,) = within_km(places, other, [km])
            if not near.any():
                continue
            sums = near.astype(float) @ leading
            total += float((by_part(a, here, "sums") * sums[:, :len(parts)]).sum() - (by_part(a, here, "counts") * sums[:, len(parts):]).sum())
            pairs += float(a["n"][here] @ (near @ b["n"][there]))
            high, low = np.where(near, b["hi"][there], -math.inf).max(axis=1), np.where(near, b["lo"][there], math.inf).min(axis=1)
            met = near.any(axis=1)
            greatest = np.maximum(greatest, np.maximum(high - a["lo"][here], a["hi"][here] - low)[met].max())
    return total, pairs, float(greatest) if pairs else None
