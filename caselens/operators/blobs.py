"""Splitting of merged blobs: summits of a soft map by a merge tree, and the watershed lines between them.

A component of a mask is flooded from above. Voxels enter in falling
probability and join the components of their neighbours (a merge tree by
union-find); where two meet, the summit of the lower one is final: it is a seed
if it rises by h or more above the meeting place. A second flood starts from
the seeds, in the same order, and leaves a line of one voxel where two seeds'
regions meet.

Components come from label(); one of them is a task's group, so a task holds a
component, at most a scan's mask. Components too small to be split never leave
Spark's side.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .volumes import XYZ, component_sizes, label, offsets

#: Heights are compared up to this.
ROUNDING = 1e-12


def neighbours(places: np.ndarray, connectivity: int) -> np.ndarray:
    """places: (n, 3), distinct. For each, the row of the neighbour at each offset, -1 where there is none."""
    low = places.min(axis=0) - 1
    side = places.max(axis=0) - low + 2
    pack = lambda at: (at[:, 2] * side[1] + at[:, 1]) * side[0] + at[:, 0]
    keys = pack(places - low)
    order = np.argsort(keys)
    out = []
    for step in offsets(connectivity):
        wanted = pack(places - low + np.array(step))
        found = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
        out.append(np.where(keys[order[found]] == wanted, order[found], -1))
    return np.stack(out, axis=1)


def summits(p: np.ndarray, near: np.ndarray, h: float) -> np.ndarray:
    """Whether each voxel is a summit: none that is higher can be reached without going down by h or more."""
    root, tops, seed = list(range(len(p))), {}, np.zeros(len(p), bool)

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    entered = np.zeros(len(p), bool)
    for v in np.argsort(-p, kind="stable").tolist():
        entered[v], tops[v] = True, [v]
        for u in near[v].tolist():
            if u < 0 or not entered[u]:
                continue
            a, b = find(v), find(u)
            if a == b:
                continue
            if p[tops[a][0]] < p[tops[b][0]]:
                a, b = b, a
            lower = tops.pop(b)
            root[b] = a
            if p[tops[a][0]] == p[lower[0]]:
                tops[a] += lower
            elif p[lower[0]] - p[v] >= h - ROUNDING:
                seed[lower] = True
    for last in tops.values():
        seed[last] = True
    return seed


def regions(p: np.ndarray, near: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Each voxel's region, flooded in falling probability from seeds (region numbers, 0 for none); 0 on lines and where no flood arrives.

    Of equal probabilities, the one reached first goes first; seeds count as reached in the order of the rows.
    """
    region, line = seeds.copy(), np.zeros(len(p), bool)
    queue = [(-p[v], k, v) for k, v in enumerate(np.flatnonzero(seeds).tolist())]
    heapq.heapify(queue)
    reached = len(queue)
    while queue:
        _, _, v = heapq.heappop(queue)
        around = [u for u in near[v].tolist() if u >= 0]
        if not seeds[v]:
            if region[v] or line[v]:
                continue
            met = {int(region[u]) for u in around if region[u]}
            if len(met) > 1:
                line[v] = True
                continue
            region[v] = met.pop()
        for u in around:
            if not region[u] and not line[u]:
                heapq.heappush(queue, (-p[u], reached, u))
                reached += 1
    return region


def _numbered(seed: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Connected seeds get one number, from 1 in the order of their first rows; 0 elsewhere."""
    out, number = np.zeros(len(seed), np.int64), 0
    for v in np.flatnonzero(seed).tolist():
        if not out[v]:
            number += 1
            out[v], stack = number, [v]
            while stack:
                for u in near[stack.pop()].tolist():
                    if u >= 0 and seed[u] and not out[u]:
                        out[u] = number
                        stack.append(u)
    return out


def cut(places: np.ndarray, p: np.ndarray, h: float, least: int, flood: int) -> np.ndarray:
    """Which voxels of one component stay: all but the lines between regions, if two regions at least have ``least`` voxels."""
    near = neighbours(places, 26)
    seeds = _numbered(summits(p, near, h), near)
    if seeds.max() < 2:
        return np.ones(len(p), bool)
    region = regions(p, near if flood == 26 else neighbours(places, flood), seeds)
    if (np.bincount(region)[1:] >= least).sum() < 2:
        return np.ones(len(p), bool)
    return region > 0


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by([(a, "ascending") for a in XYZ])
    return table, np.stack([table.column(a).to_numpy() for a in XYZ], axis=1).astype(np.int64), table.column("p").to_numpy()


def _each(voxels: DataFrame, keep) -> DataFrame:
    """voxels: case, x, y, z, p, comp. Those of each component that keep(places, p) names."""

    def one(table: pa.Table) -> pa.Table:
        table, places, p = _in_order(table)
        return table.filter(pa.array(keep(places, p)))

    return voxels.groupBy("case", "comp").applyInArrow(one, voxels.schema)


def soft_components(soft: DataFrame, connectivity: int = 26) -> DataFrame:
    """soft: case, x, y, z, p of a mask. With ``comp``, the component by label()."""
    rows = soft.select("case", *XYZ, F.col("p").cast("double").alias("p"))
    return rows.join(label(rows, connectivity), ["case", *XYZ]).select("case", *XYZ, "p", "comp")


def h_maxima(soft: DataFrame, h: float) -> DataFrame:
    """(case, x, y, z, p, comp): the summits of each component of a mask (26-connected) with its probabilities."""
    return _each(soft_components(soft), lambda places, p: summits(p, neighbours(places, 26), h))


def split_blobs(soft: DataFrame, h: float, least: int, flood: int = 6) -> DataFrame:
    """(case, x, y, z) of a mask (soft: case, x, y, z, p) without the lines between the regions of its summits.

    h of 0 and below splits nothing; so do components below twice ``least`` voxels, or whose regions but one are smaller
    than ``least``. ``flood``: the neighbours over which regions grow; a voxel of a split component that hangs on to its
    regions by none of them goes with the lines.
    """
    if h <= 0:
        return soft.select("case", *XYZ)
    marked = soft_components(soft)
    large = component_sizes(marked).filter(F.col("n_voxels") >= 2 * least).select("case", "comp")
    split = _each(marked.join(large, ["case", "comp"], "left_semi"), lambda places, p: cut(places, p, h, least, flood))
    rest = marked.join(large, ["case", "comp"], "left_anti")
    return split.select("case", *XYZ).unionByName(rest.select("case", *XYZ))
