"""Tables of a resource type, and the catalog of types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound


@dataclass(frozen=True)
class ResourceFrame:
    """main: a row for each resource, with id, versionId, content, lastUpdated, deleted and its search columns.
    references: resourceId, targetType, targetId, code, referenceRaw. lookups: by table name. timestamps: main columns of that type."""

    resource_type: str
    main: DataFrame
    references: DataFrame | None = None
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    timestamps: frozenset[str] = frozenset()
    history: DataFrame | None = None

    def live(self) -> DataFrame:
        return self.main.where(F.col("deleted") == 0)


class Catalog:
    """Frames by type; a frame may be given as a function, called when it is first needed."""

    def __init__(self, frames: dict[str, ResourceFrame | Callable[[], ResourceFrame]] | None = None):
        self._frames = dict(frames or {})

    def add(self, frame: ResourceFrame) -> None:
        self._frames[frame.resource_type] = frame

    def find(self, resource_type: str) -> ResourceFrame | None:
        found = self._frames.get(resource_type)
        if callable(found):
            found = self._frames[resource_type] = found()
        return found

    def frame(self, resource_type: str) -> ResourceFrame:
        if (found := self.find(resource_type)) is None:
            raise NotFound(f"no table for {resource_type}")
        return found

    def types(self) -> list[str]:
        return sorted(self._frames)
