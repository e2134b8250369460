"""Streams: windows with watermarks, sessions, resumable incremental work, and request post-processing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema, file_format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(file_format).load(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; rows later than the watermark are dropped. Works on streams and tables alike."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total",
    )


def session_windows(events: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of each key that end after a gap."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n",
    )


#: A state store that keeps its keys on disk and not in memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """Queries started inside keep their state in such stores; those that run already keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def incremental(source: DataFrame, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process what is new and append it by key; a key that an earlier batch has written is not written again.

    The checkpoint remembers what was read, and a state store which keys have come: a batch probes it for its own keys, and
    what was written is never read. A batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    with state_store(source.sparkSession):
        new = source.dropDuplicates([key])
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve(requests: DataFrame, request: str, p: str, threshold: float, least: int, connectivity: int = 26) -> DataFrame:
    """Requests' soft maps (request, x, y, z, p) to what is served: the mask at the threshold without small components, and a flat map where it is empty.

    (request, x, y, z, p): the voxels of the mask; requests whose mask is empty get one row without a place and with their mean p.
    """
    from ..operators.volumes import drop_small, label

    above = requests.filter(F.col(p) >= threshold)
    mask = drop_small(label(above.select(F.col(request).alias("case"), "x", "y", "z"), connectivity), least).withColumnRenamed("case", request)
    kept = above.join(mask.select(request, "x", "y", "z"), [request, "x", "y", "z"], "left_semi").select(request, "x", "y", "z", p)
    means = requests.groupBy(request).agg(F.avg(p).alias(p))
    flat = means.join(kept.select(request).distinct(), request, "left_anti")
    nowhere = F.lit(None).cast("int")
    return kept.unionByName(flat.select(request, *(nowhere.alias(a) for a in "xyz"), p))


def postprocess(requests: DataFrame, p: str, threshold: float, n_voxels: Column, least: int) -> DataFrame:
    """Requests (case, comp, p ...) reduced to the voxels that are served: at or above the threshold, in components that are large enough."""
    return requests.filter((F.col(p) >= threshold) & (n_voxels >= least))
