"""Streams of resources: incremental loading, stored searches, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store, latest


def load_stream(store: Store, resource_type: str, contents: DataFrame, checkpoint: str):
    """A query that appends a stream of (id, content, lastUpdated) to a type's log. A batch that runs again after a failure is not
    appended twice: its rows' version ids are hashes, and those that the log has are left out."""

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", F.sha2(F.concat_ws("|", "id", "lastUpdated", "content"), 256).alias("versionId"), "content", "lastUpdated").dropDuplicates(["id", "versionId"])
        store.append_rows(resource_type, rows.join(store.log(resource_type).select("id", "versionId"), ["id", "versionId"], "left_anti"))

    return contents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each id of a stream of versions; its state is one row an id. For the output modes update and complete."""
    return latest(versions)


def matching(stream: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a stream that a table of stored searches asks for."""
    return stream.join(stored.select(*on).distinct(), on, "left_semi")


def window_counts(events: DataFrame, *, time: str = "ts", by: list[str] | None = None, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window; rows later than `late` are dropped from a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w, *(by or [])).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, *, time: str = "ts", by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
