"""Streams of changes: new versions of files, and counts over windows with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_versions(manifest: DataFrame, key: str = "relative_path", digest: str = "file_hash") -> DataFrame:
    """The rows of a stream of manifest rows whose content was not seen under its key before.

    The state holds one entry for each version of a file, partitioned by both columns.
    """
    return manifest.dropDuplicates([key, digest])


def windowed_counts(stream: DataFrame, time: str, by: str, window: str, lateness: str) -> DataFrame:
    """window_start, ``by`` and the number of rows; a window closes once the watermark passes its end."""
    found = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("window_start"), by, "n")


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> bool:
    """Give what is new in a stream to ``apply``, batch by batch, and return when all of it is done (or the time is up).

    A batch is repeated after a failure with the same number, so ``apply`` must be able to see it twice; what was done is
    kept in ``checkpoint``, so the next call begins behind it. One call at a time holds a checkpoint.
    """
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return bool(query.awaitTermination(timeout)) if timeout is not None else query.awaitTermination() is None
