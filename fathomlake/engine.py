"""Startup: from definitions to a store whose tables and indexes agree with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .operators.store import Store
from .plans import schema
from .plans.registry import Registry
from .sources.definitions import Definitions
from .sources.state import State


@dataclass
class Engine:
    store: Store
    registry: Registry
    packages: schema.Packages
    status: str  # new, upgrade or consistent
    deltas: list[schema.Delta]

    def reindex(self) -> dict[str, int]:
        """Runs the pending jobs, each one job of Spark over its type; counts by status."""
        self.packages.run_jobs(self.store.rebuild)
        return self.packages.job_counts()


def initialize(spark: SparkSession, root: str, definitions: Definitions | Registry, *, package: str = "default", version: str = "1", **store) -> Engine:
    """Starts on a folder: its packages are read, the schema of the definitions is compared with the active one, and what changed is
    registered, with a reindex job for each type whose expressions changed. Jobs that an earlier start left behind are pending again."""
    registry = definitions if isinstance(definitions, Registry) else definitions.registry()
    packages = schema.Packages(State(spark, f"{root.rstrip('/')}/state/packages"))
    status, deltas = packages.initialize(package, version, schema.snapshot(registry))
    return Engine(Store(spark, root, registry, **store), registry, packages, status, deltas)
