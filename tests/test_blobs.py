"""Summits and watershed lines against their definitions; distances against brute force."""

import math
import random
from itertools import product

import numpy as np
import pytest

from caselens.operators import blobs, volumes as V
from caselens.operators.distances import lower_envelope

SOFT = "case string, x int, y int, z int, p double"
AROUND = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
FACES = [o for o in AROUND if sum(map(abs, o)) == 1]


def step(v, o):
    return tuple(a + b for a, b in zip(v, o))


def reach(start, inside):
    seen, stack = {start}, [start]
    while stack:
        v = stack.pop()
        for o in AROUND:
            u = step(v, o)
            if u not in seen and inside(u):
                seen.add(u)
                stack.append(u)
    return seen


def parts(voxels):
    left, out = set(voxels), []
    while left:
        one = reach(min(left), left.__contains__)
        out.append(one)
        left -= one
    return out


def summits(p, h):
    return {v for v in p if all(p[u] <= p[v] for u in reach(v, lambda u, v=v: u in p and p[u] > p[v] - h + 1e-9))}


def split(p, h, least, faces):
    """Always the highest voxel that a flood has reached, of ties the one reached first; a plain list for a queue."""
    kept = set()
    for one in parts(p):
        seeds = sorted(parts(summits({v: p[v] for v in one}, h)), key=min)
        if len(one) < 2 * least or len(seeds) < 2:
            kept |= one
            continue
        region = {v: k for k, s in enumerate(seeds) for v in s}
        waiting, lines, done = sorted(region), set(), set()
        while waiting:
            v = max(waiting, key=lambda u: p[u])
            waiting.remove(v)
            if v in lines or v in done:
                continue
            near = [u for u in (step(v, o) for o in faces) if u in one]
            if v not in region:
                met = {region[u] for u in near if u in region}
                if len(met) > 1:
                    lines.add(v)
                    continue
                region[v] = met.pop()
            done.add(v)
            waiting += [u for u in near if u not in region and u not in lines]
        sizes = [list(region.values()).count(k) for k in range(len(seeds))]
        kept |= set(region) if sum(n >= least for n in sizes) >= 2 else one
    return kept


def spheres(*centres, radius=3.2):
    """Each lower than the one before; equal summits are two, however shallow the valley."""
    return {v: max(1 - 0.02 * k - math.dist(v, c) / 10 for k, c in enumerate(centres)) for v in product(range(16), repeat=3) if min(math.dist(v, c) for c in centres) <= radius}


def rows(p, case="a"):
    return [(case, *v, value) for v, value in p.items()]


def random_map(seed):
    rng = random.Random(seed)
    return {v: rng.randrange(40, 100) / 100 for v in product(range(9), range(8), range(5)) if rng.random() < 0.45}


def kept(df):
    return {(r.x, r.y, r.z) for r in df.collect()}


MAPS = {"a": random_map(0), "b": random_map(1), "c": random_map(2), "d": spheres((4, 4, 4)), "e": {v: 0.5 for v in product(range(3), repeat=3)}}


@pytest.fixture(scope="module")
def maps(spark):
    return spark.createDataFrame([r for c, p in MAPS.items() for r in rows(p, c)], SOFT)


@pytest.mark.parametrize("h", [0.05, 0.3])
def test_summits_equal_their_definition(maps, h):
    found = blobs.h_maxima(maps, h).collect()
    for c, p in MAPS.items():
        assert {(r.x, r.y, r.z) for r in found if r.case == c} == set().union(*(summits({v: p[v] for v in one}, h) for one in parts(p)))


@pytest.mark.parametrize(("h", "least", "flood"), [(0.1, 1, 6), (0.3, 3, 26)])
def test_lines_equal_a_plain_flood(maps, h, least, flood):
    found = blobs.split_blobs(maps, h, least, flood).collect()
    for c, p in MAPS.items():
        assert {(r.x, r.y, r.z) for r in found if r.case == c} == split(p, h, least, FACES if flood == 6 else AROUND)


def test_merged_spheres_part_at_their_valley(spark):
    p = spheres((4, 4, 4), (9, 4, 4))
    df = spark.createDataFrame(rows(p), SOFT)
    halves = blobs.split_blobs(df, 0.1, 20)
    assert kept(halves) == split(p, 0.1, 20, FACES)
    assert len(p) > halves.count() > 0.8 * len(p)
    assert len(parts(p)) == 1 and len(parts(kept(halves))) == 2
    for h, least in ((0.0, 1), (0.3, 1), (0.1, 140)):  # no valley is as deep; no half is as large
        assert blobs.split_blobs(df, h, least).count() == len(p)


def test_empty_map(maps):
    assert blobs.split_blobs(maps.limit(0), 0.1, 1).count() == 0 == blobs.h_maxima(maps.limit(0), 0.1).count()


def test_envelope_is_the_least_parabola():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        at = np.sort(rng.choice(200, n, replace=False)) * 0.7
        height = rng.choice([0.0, 1e-9, 3.0, 900.0, 1e6], n) * rng.random(n)
        ask = np.arange(-50, 250) * 0.7
        want = ((ask[:, None] - at) ** 2 + height).min(axis=1)
        assert np.allclose(lower_envelope(at, height, ask), want, rtol=1e-12, atol=1e-12)


def test_distances_far_near_and_by_case(spark):
    rng = random.Random(5)
    place = lambda side: tuple(rng.randrange(side) for _ in range(3))
    points = {(c, *place(side)) for c, side in (("a", 30), ("b", 4), ("c", 200)) for _ in range(60)}
    targets = {(c, *(x + away for x in place(side))) for c, side, away in (("a", 30, 0), ("b", 9, 3000), ("d", 5, 0)) for _ in range(40)} | {("c", 7, 9, 11)}
    size = {"a": (1.0, 1.0, 1.0), "b": (0.4, 0.9, 3.0), "c": (1.0, 0.3, 2.0), "d": (1.0, 1.0, 1.0)}
    table = lambda v: spark.createDataFrame(sorted(v), "case string, x int, y int, z int")
    sizes = spark.createDataFrame([(c, *v) for c, v in size.items()], "case string, vx double, vy double, vz double")
    got = {(r.case, r.x, r.y, r.z): r.distance for r in V.nearest_distance(table(points), table(targets), sizes).collect()}
    gap = lambda c, u, v: math.dist([a * s for a, s in zip(u, size[c])], [a * s for a, s in zip(v, size[c])])
    assert got.keys() == points
    for (c, *v), d in got.items():
        assert math.isclose(d, min(gap(c, v, t[1:]) for t in targets if t[0] == c), rel_tol=1e-12)
