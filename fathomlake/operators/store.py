"""A versioned store: an append-only log of resource versions in Parquet.

Every write, of however many resources and types, is one new file of the log, which appears as a whole or not at all. The current
state of a type is the latest version of each id. `compact` writes that with its search columns, reference edges and lookup
rows; later reads take them from there and index only what was appended since. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Gone, NotFound, PreconditionFailed, VersionConflict
from ..functions import extract
from ..plans.model import SearchRequest
from ..plans.parser import parse_search
from ..plans.registry import Registry
from ..sources.frames import Catalog, ResourceFrame
from ..sources.state import complete, names_in
from .search import Searcher

#: Shares of the ids in which a bulk load counts its versions.
SHARES = 4096
TOUCHED = "resourceType string, id string, versionSeq long"
LOG = "versionSeq long, id string, versionId string, content string, lastUpdated string, deleted int, versionNumber int"


def latest(log: DataFrame, key: str = "id", order: str = "versionSeq") -> DataFrame:
    """The last version of each key, by one aggregation with partial maxima."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(key, "v.*")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class Store:
    def __init__(self, spark: SparkSession, root: str, registry: Registry, *, clock: Callable[[], str] = now, new_id: Callable[[], str] = lambda: str(uuid.uuid4()), extractor: Callable | None = None):
        self.extractor = extractor
        self.spark, self.root, self.registry, self.clock, self.new_id = spark, root.rstrip("/"), registry, clock, new_id

    @property
    def path(self) -> str:
        return f"{self.root}/log"

    def files(self, path: str) -> list[str]:
        return names_in(self.spark, path)

    def log(self, resource_type: str) -> DataFrame:
        if not self.files(self.path):
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG + ", resourceType string").parquet(self.path)
        return rows.where(F.col("resourceType") == resource_type).drop("resourceType")

    def state(self, resource_type: str) -> DataFrame:
        return latest(self.log(resource_type))

    def derived(self, rows: DataFrame, resource_type: str) -> DataFrame:
        return extract.index_contents(rows, resource_type, self.registry, self.extractor)

    def indexed(self, resource_type: str) -> DataFrame:
        """The state with all that is derived from the contents: what was compacted, and the ids that have changed since, indexed now."""
        log, folder = self.log(resource_type), f"{self.root}/index/{resource_type}"
        done = complete(self.spark, folder)
        if not done:
            return self.derived(latest(log), resource_type)
        kept = self.spark.read.parquet(f"{folder}/{done[-1]}")
        newer = log.where(F.col("versionSeq") > int(done[-1].partition("-")[0]))
        if self.files(f"{self.root}/touched"):
            touched = self.spark.read.schema(TOUCHED).parquet(f"{self.root}/touched").where(F.col("resourceType") == resource_type)
            newer = newer.unionByName(log.join(touched.select("id", "versionSeq").distinct(), ["id", "versionSeq"], "left_semi"))
        changed = self.derived(latest(newer), resource_type)
        return kept.join(changed.select("id"), "id", "left_anti").unionByName(changed, allowMissingColumns=True)

    def frame(self, resource_type: str) -> ResourceFrame:
        """The type's tables as of now; deleted resources have no edges and no lookup rows."""
        indexed = self.indexed(resource_type)
        live = indexed.where("deleted = 0")
        lookups = {t: extract.lookups_from(live, t, resource_type) for t in extract.LOOKUP_SCHEMAS}
        return ResourceFrame(resource_type, indexed.drop("__edges", "__lookups"), extract.edges_from(live), lookups, history=self.log(resource_type))

    def catalog(self) -> Catalog:
        return Catalog({t: (lambda t=t: self.frame(t)) for t in self.registry.types()})

    def searcher(self, **options) -> Searcher:
        return Searcher(self.catalog(), self.registry, **options)

    def find(self, resource_type: str, query, limit: int) -> list[dict]:
        request = query if isinstance(query, SearchRequest) else parse_search(resource_type, query, self.registry)
        request.count = limit
        return [json.loads(r["content"]) for r in self.searcher().page(request).select("content").collect()]

    # reads

    def _row(self, resource_type: str, id: str):
        return latest(self.log(resource_type).where(F.col("id") == id)).first()

    def read(self, resource_type: str, id: str) -> dict:
        row = self._row(resource_type, id)
        if row is None:
            raise NotFound(f"{resource_type}/{id}")
        if row["deleted"]:
            raise Gone(f"{resource_type}/{id}")
        return json.loads(row["content"])

    def read_version(self, resource_type: str, id: str, version: str) -> dict:
        """A version's content, also that of a deletion."""
        row = self.log(resource_type).where((F.col("id") == id) & (F.col("versionId") == version)).first()
        if row is None:
            raise NotFound(f"{resource_type}/{id}/_history/{version}")
        return json.loads(row["content"])

    def history(self, resource_type: str, id: str | None = None, *, since: str | None = None, cursor: int | None = None, limit: int | None = None) -> DataFrame:
        """Versions of one resource or of a type, latest first; from `since` on, before `cursor` (a versionSeq)."""
        return history_page(self.log(resource_type), id, since=since, cursor=cursor, limit=limit)

    # writes

    def last(self, resource_type: str) -> int:
        return self.log(resource_type).agg(F.max("versionSeq").alias("m")).first()["m"] or 0

    def _append(self, resource_type: str, rows: Iterable[tuple]) -> None:
        """rows: (id, versionId, content, lastUpdated, deleted, versionNumber)."""
        self.append_all({resource_type: rows})

    def append_all(self, pending: dict[str, Iterable[tuple]]) -> None:
        """Rows of several types, in one file."""
        batch = [(start + k, *r, kind) for kind, rows in pending.items() for start in [self.last(kind)] for k, r in enumerate(rows, 1)]
        if batch:
            self.spark.createDataFrame(batch, LOG + ", resourceType string").coalesce(1).write.mode("append").parquet(self.path)

    def _stamped(self, resource: dict, id: str) -> tuple[dict, str, str]:
        version, at = self.new_id(), self.clock()
        return resource | {"id": id, "meta": (resource.get("meta") or {}) | {"versionId": version, "lastUpdated": at}}, version, at

    def load(self, resource_type: str, contents: DataFrame) -> None:
        """Bulk create: contents has id and content (JSON). New ids only count if absent; versions get their numbers in one job."""
        fresh = contents.groupBy("id").agg(F.min("content").alias("content")).join(self.state(resource_type).select("id"), "id", "left_anti")
        self.append_rows(resource_type, fresh.select("id", F.sha2(F.concat_ws("|", "id", "content"), 256).alias("versionId"), "content", F.lit(self.clock()).alias("lastUpdated")))

    def append_rows(self, resource_type: str, rows: DataFrame) -> None:
        """First versions (id, versionId, content, lastUpdated), in one job."""
        # unique and increasing numbers that only depend on the rows, so that a lost task gives the same again; dense ones would need one order of all
        share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
        number = (F.row_number().over(Window.partitionBy(share).orderBy("id", "lastUpdated", "versionId")) - 1) * SHARES + share + self.last(resource_type) + 1
        rows = rows.select(number.cast("long").alias("versionSeq"), "id", "versionId", "content", "lastUpdated", F.lit(0).alias("deleted"), F.lit(1).alias("versionNumber"), F.lit(resource_type).alias("resourceType"))
        rows.write.mode("append").parquet(self.path)

    def create(self, resource_type: str, resource: dict, *, id: str | None = None, if_none_exist=None) -> tuple[dict, bool]:
        """(resource, whether it was created). if_none_exist: a query; one match is returned, several are an error."""
        if if_none_exist is not None:
            found = self.find(resource_type, if_none_exist, 2)
            if len(found) > 1:
                raise PreconditionFailed("several resources match")
            if found:
                return found[0], False
        stamped, version, at = self._stamped(resource, id or resource.get("id") or self.new_id())
        self._append(resource_type, [(stamped["id"], version, json.dumps(stamped), at, 0, 1)])
        return stamped, True

    def update(self, resource_type: str, resource: dict, *, if_match: str | None = None, upsert: bool = False) -> tuple[dict, bool]:
        """(resource, whether it was created). With upsert an absent or deleted resource is created."""
        row = self._row(resource_type, resource["id"])
        if row is None or row["deleted"]:
            if not upsert:
                raise (NotFound if row is None else Gone)(f"{resource_type}/{resource['id']}")
        elif if_match is not None and if_match.removeprefix('W/"').rstrip('"') != row["versionId"]:
            raise VersionConflict(f"{resource_type}/{resource['id']} is at {row['versionId']}")
        created = row is None or bool(row["deleted"])
        stamped, version, at = self._stamped(resource, resource["id"])
        self._append(resource_type, [(stamped["id"], version, json.dumps(stamped), at, 0, row["versionNumber"] + 1 if row else 1)])
        return stamped, created

    def delete(self, resource_type: str, id: str) -> None:
        """A deletion is a version that keeps the content."""
        row = self._row(resource_type, id)
        if row is None:
            raise NotFound(f"{resource_type}/{id}")
        if row["deleted"]:
            raise Gone(f"{resource_type}/{id}")
        self._append(resource_type, [(id, self.new_id(), row["content"], self.clock(), 1, row["versionNumber"] + 1)])

    def conditional_update(self, resource_type: str, query, resource: dict) -> tuple[dict, bool]:
        found = self.find(resource_type, query, 2)
        if len(found) > 1:
            raise PreconditionFailed("several resources match")
        return self.update(resource_type, resource | {"id": found[0]["id"]}) if found else self.create(resource_type, resource)

    def conditional_delete(self, resource_type: str, query) -> int:
        """Deletes up to a page of matches in one append; their number."""
        found = self.find(resource_type, query, 1000)
        ids = [r["id"] for r in found]
        rows = latest(self.log(resource_type).where(F.col("id").isin(ids))).collect() if ids else []
        if rows:
            self._append(resource_type, [(r["id"], self.new_id(), r["content"], self.clock(), 1, r["versionNumber"] + 1) for r in rows])
        return len(rows)

    def compact(self, resource_type: str) -> ResourceFrame:
        """Indexes what was appended since the last time, in one job, and reads from there. Reads go on from the folder before until it is done."""
        seq = self.last(resource_type)
        target = f"{self.root}/index/{resource_type}/{seq:019d}"
        if seq and "_SUCCESS" not in self.files(target):
            self.indexed(resource_type).sortWithinPartitions("id").write.mode("overwrite").parquet(target)
        return self.frame(resource_type)

    def rebuild(self, resource_type: str) -> int:
        """Indexes a type anew as a whole, as after a change of its parameters; the number of its resources. Reads go on from the folder before until it is done."""
        log, folder = self.log(resource_type), f"{self.root}/index/{resource_type}"
        seq = self.last(resource_type)
        again = sum(name.startswith(f"{seq:019d}-") for name in self.files(folder))
        target = f"{folder}/{seq:019d}-{again:09d}"  # after what was compacted at that version, in order of names
        self.derived(latest(log), resource_type).sortWithinPartitions("id").write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target).count()

    def reindex(self, resource_type: str, id: str) -> bool:
        """Has one resource indexed anew by reads, as after a change of its parameters. False if it is absent or deleted."""
        row = self._row(resource_type, id)
        if row is None or row["deleted"]:
            return False
        self.spark.createDataFrame([(resource_type, id, row["versionSeq"])], TOUCHED).coalesce(1).write.mode("append").parquet(f"{self.root}/touched")
        return True

    def scan(self, resource_type: str, after: str | None = None, limit: int = 100) -> DataFrame:
        """The next live resources by id, for work in batches: id and content."""
        rows = self.state(resource_type).where("deleted = 0")
        rows = rows if after is None else rows.where(F.col("id") > after)
        return rows.select("id", "content").orderBy("id").limit(limit)


def history_page(log: DataFrame, id: str | None = None, *, since: str | None = None, cursor: int | None = None, limit: int | None = None, by: str = "versionSeq") -> DataFrame:
    """Versions, latest first: by versionSeq, or by lastUpdated and then versionSeq."""
    if id is not None:
        log = log.where(F.col("id") == id)
    if since is not None:
        log = log.where(F.col("lastUpdated") >= since)
    if cursor is not None:
        log = log.where(F.col("versionSeq") < cursor)
    log = log.orderBy(*[F.col(c).desc() for c in dict.fromkeys((by, "versionSeq"))])
    return log if limit is None else log.limit(limit)
