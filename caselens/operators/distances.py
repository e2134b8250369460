"""Exact distances between sparse point sets of volumes: a separable distance transform, line by line.

The squared distance to the nearest target is a minimum over z of a minimum over
y of a minimum over x. Each pass deals lines of one axis over tasks; on a line,
every source is a parabola, and the lower envelope of them answers all places
asked for in one sweep. Only places on the way to a point are computed: x of
the points on lines with targets, then (x, y) of the points, then the points.
The cost does not depend on how far points and targets lie apart. A task holds
batches of lines, no volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stash

#: A table of places asked for is broadcast if it has at most so many.
BROADCAST_PLACES = 1_000_000


def lower_envelope(at: np.ndarray, height: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """For each place asked for, the least (ask - at)^2 + height over sources with distinct, rising places."""
    kept, since = [], []  # sources of the envelope, and where each becomes the lowest
    for i in range(len(at)):
        cross = -np.inf
        while kept:
            j = kept[-1]
            cross = ((height[i] - height[j]) / (at[i] - at[j]) + at[i] + at[j]) / 2
            if cross > since[-1]:
                break
            kept.pop()
            since.pop()
            cross = -np.inf
        kept.append(i)
        since.append(cross)
    places, heights = at[kept], height[kept]
    own = np.searchsorted(np.array(since), ask, side="right") - 1
    value = lambda k: (ask - places[k]) ** 2 + heights[k]
    beside = np.minimum(value(np.maximum(own - 1, 0)), value(np.minimum(own + 1, len(kept) - 1)))  # where a crossing is rounded
    return np.minimum(value(own), beside)


def _pass(rows: DataFrame, asked: DataFrame, over: str, line: list[str], by: list[str]) -> DataFrame:
    """rows: line, over, h. Each line's lower envelope at the places (``over``) that asked has for the line's ``by`` columns; h of those."""
    lines = rows.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(over, "h"))).alias("s"))
    lines = lines.join(asked, by).select(*line, F.col(f"s.{over}").alias("at"), F.col("s.h").alias("h"), "ask", "v")
    kind = dict(lines.dtypes)

    def envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h, ask = (batch.column(c) for c in ("at", "h", "ask"))
            edges = [np.asarray(c.offsets) - c.offsets[0].as_py() for c in (at, ask)] if batch.num_rows else []
            at, h, ask = (c.flatten().to_numpy().astype(float) for c in (at, h, ask))
            v, out = batch.column("v").to_numpy(), np.zeros(len(ask))
            for i in range(batch.num_rows):
                (a, b), (c, d) = (e[i : i + 2] for e in edges)
                out[c:d] = lower_envelope(at[a:b] * v[i], h[a:b], ask[c:d] * v[i])
            columns = [*(batch.column(c) for c in line), batch.column("ask")]
            found = pa.ListArray.from_arrays(pa.array(edges[1] if batch.num_rows else [0], pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*line, "ask", "h"])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in line), f"ask {kind['ask']}", "h array<double>"])
    found = lines.mapInArrow(envelopes, schema).select(*line, F.explode(F.arrays_zip("ask", "h")).alias("p"))
    return found.select(*line, F.col("p.ask").alias(over), F.col("p.h").alias("h"))


def squared_distances(points: DataFrame, targets: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z, h): for each point, the squared distance in mm to the nearest target of its keys; points without targets are left out.

    keys hold ``case``; sizes has vx, vy and vz of each case.
    """
    points = stash(points.select(*keys, "x", "y", "z").distinct().join(sizes.select("case", "vx", "vy", "vz"), "case"))
    rows = targets.select(*keys, "x", "y", "z").distinct().withColumn("h", F.lit(0.0))
    for k, over in enumerate("xyz"):
        by = [*keys, *"xyz"[:k]]
        asked = points.groupBy(*by).agg(F.sort_array(F.collect_set(over)).alias("ask"), F.first(f"v{over}").alias("v"))
        if k < 2:
            asked = stash(asked)
            if (asked.agg(F.sum(F.size("ask"))).first()[0] or 0) <= BROADCAST_PLACES:
                asked = F.broadcast(asked)
        rows = _pass(rows, asked, over, [*by, *"xyz"[k + 1 :]], by)
    return rows.select(*keys, "x", "y", "z", "h")
