"""Affine maps as columns: flat arrays of 12 doubles, the rows of a 3 x 4 matrix from indexes to mm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(values: list[list[Column]]) -> Column:
    return F.array(*(v for row in values for v in row))


def _entries(m: Column) -> list[list[Column]]:
    return [[F.get(m, F.lit(4 * i + j)) for j in range(4)] for i in range(3)]


def apply(m: Column, at: list[Column]) -> list[Column]:
    """The three coordinates of the place that an index maps to."""
    return [sum((row[j] * at[j] for j in range(3)), row[3]) for row in _entries(m)]


def compose(outer: Column, inner: Column) -> Column:
    """First the inner map, then the outer one."""
    a, b = _entries(outer), _entries(inner)
    product = lambda i, j: a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j]
    return _rows([[product(i, j) if j < 3 else product(i, 3) + a[i][3] for j in range(4)] for i in range(3)])


def inverse(m: Column) -> Column:
    """The map back, by cofactors; NULL for maps without one."""
    a = _entries(m)
    minor = lambda i, j: (  # noqa: E731  signed, since the other rows and columns are taken in cyclic order
        a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    )
    det = F.nullif(sum((a[0][j] * minor(0, j) for j in (1, 2)), a[0][0] * minor(0, 0)), F.lit(0.0))
    back = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    out = [[*row, -(row[0] * a[0][3] + row[1] * a[1][3] + row[2] * a[2][3])] for row in back]
    return F.when(det.isNotNull(), _rows(out))


def from_quaternion(b: Column, c: Column, d: Column, sizes: list[Column], handed: Column, offset: list[Column]) -> Column:
    """A rotation by the unit quaternion (a, b, c, d) with a >= 0, after voxel sizes, the third axis turned round where handed is -1."""
    a = F.sqrt(F.greatest(1.0 - (b * b + c * c + d * d), F.lit(0.0)))
    turn = [
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ]
    side = [sizes[0], sizes[1], sizes[2] * handed]
    return _rows([[turn[i][j] * side[j] for j in range(3)] + [offset[i]] for i in range(3)])


def from_axes(directions: Column, sizes: list[Column], origin: Column) -> Column:
    """From the unit vectors of the three axes, one after the other (nine numbers), voxel sizes and the first voxel's place."""
    return _rows([[F.get(directions, F.lit(3 * j + i)) * sizes[j] for j in range(3)] + [F.get(origin, F.lit(i))] for i in range(3)])


def lps_to_ras(m: Column) -> Column:
    """From axes to the left, back and head to axes to the right, front and head."""
    a = _entries(m)
    return _rows([[-v for v in a[0]], [-v for v in a[1]], a[2]])


def between(target: Column, source: Column) -> Column:
    """From the target grid's indexes to the source grid's, if both map theirs to one space."""
    return compose(inverse(source), target)
