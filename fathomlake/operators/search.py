"""Execution of a search: filters, order, page, total, includes. Everything but the page size is a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import reference_edges, wildcard_references
from ..plans.compiler import Compiler, apply
from ..plans.model import Include, SearchRequest
from ..plans.registry import Registry
from ..sources.frames import Catalog

#: Resources that includes may add, and rounds of :iterate.
INCLUDE_CAP, ITERATE_DEPTH = 1000, 3


@dataclass
class SearchResult:
    page: DataFrame
    included: DataFrame | None = None  # resourceType, id, content
    total: int | None = None


class Searcher:
    def __init__(self, catalog: Catalog, registry: Registry, *, strict: bool = True, lookup_wildcards: bool = False):
        self.catalog, self.registry = catalog, registry
        self.compiler = Compiler(registry, catalog, strict=strict, lookup_wildcards=lookup_wildcards)

    def matches(self, request: SearchRequest) -> DataFrame:
        """All live rows that satisfy the request, unordered."""
        frame = self.catalog.frame(request.resource_type)
        rows = frame.live()
        if request.compartment:
            rows = rows.where(F.array_contains("compartments", request.compartment))
        if request.project:
            rows = rows.where(F.col("projectId") == request.project)
        return apply(rows, self.compiler.predicates(request.resource_type, request.params))

    def order(self, request: SearchRequest) -> list[Column]:
        """The sort rules that name a known parameter, else latest first; ties by id, so that pages are the same each time."""
        found = [(self.registry.get(request.resource_type, r.code), r.descending) for r in request.sort]
        columns = [F.col(p.order_column).desc() if down else F.col(p.order_column).asc() for p, down in found if p]
        return [*(columns or [F.col("lastUpdated").desc()]), F.col("id").asc()]

    def page(self, request: SearchRequest) -> DataFrame:
        """The asked page: one TakeOrderedAndProject."""
        rows = self.matches(request).orderBy(*self.order(request))
        rows = rows.offset(request.offset) if request.offset else rows
        return rows.limit(request.page_size)

    def page_in_two_phases(self, request: SearchRequest) -> DataFrame:
        """The same page, its wide columns read for the page's rows alone: keys first, then a join of at most a page of ids."""
        keys = self.page(request).select("id")
        rows = self.catalog.frame(request.resource_type).main.join(F.broadcast(keys), "id")  # a page holds at most MAX_COUNT keys
        return rows.orderBy(*self.order(request))

    def count(self, request: SearchRequest) -> DataFrame:
        return self.matches(request).agg(F.count(F.lit(1)).alias("count"))

    def search(self, request: SearchRequest) -> SearchResult:
        page = self.page(request)
        included = None
        if request.include or request.revinclude:
            included = self.included(request, page)
        total = self.count(request).first()["count"] if request.total == "accurate" else None
        return SearchResult(page, included, total)

    def content(self, resource_type: str, ids: DataFrame) -> DataFrame:
        """resourceType, id, content of the live resources whose id is among ids."""
        rows = self.catalog.frame(resource_type).live().select("id", "content")
        return rows.join(F.broadcast(ids.select("id").distinct()) if ids.isLocal() else ids.select("id").distinct(), "id", "left_semi").select(F.lit(resource_type).alias("resourceType"), "id", "content")

    def edges(self, source: str, include: Include) -> DataFrame | None:
        frame = self.catalog.find(source)
        if frame is None or frame.references is None:
            return None
        edges = frame.references
        if not include.wildcard:
            edges = edges.where(F.col("code") == include.code)
        return edges.where(F.col("targetType") == include.target) if include.target else edges

    def references(self, source: str, ids: DataFrame, include: Include) -> DataFrame | None:
        """targetType, targetId of what an include follows from ids (column id; at most a page or INCLUDE_CAP). A wildcard also follows references
        at any depth of their contents, whether or not a parameter indexes them; no other contents are searched for those."""
        ids = F.broadcast(ids.select(F.col("id").alias("resourceId")).distinct())
        edges = self.edges(source, include)
        if edges is not None:
            edges = edges.join(ids, "resourceId", "left_semi").select("targetType", "targetId")
        if not include.wildcard or (frame := self.catalog.find(source)) is None:
            return edges
        contents = frame.live().select(F.col("id").alias("resourceId"), "content").join(ids, "resourceId", "left_semi")
        found = contents.select(F.explode(wildcard_references(F.col("content"))).alias("r")).select(reference_edges(F.col("r")).alias("e")).where(F.col("e").isNotNull()).select("e.*")
        if include.target:
            found = found.where(F.col("targetType") == include.target)
        return found if edges is None else edges.unionByName(found)

    def targets(self, source: str, sources: DataFrame, include: Include) -> DataFrame | None:
        """What rows of a type (column id) refer to: resourceType, id, content."""
        reached = self.references(source, sources, include)
        if reached is None:
            return None
        kinds = [include.target] if include.target else self.target_types(source, include)
        found = [self.content(k, reached.where(F.col("targetType") == k).select(F.col("targetId").alias("id"))) for k in kinds if self.catalog.find(k)]
        return reduce(DataFrame.unionByName, found) if found else None

    def target_types(self, source: str, include: Include) -> list[str]:
        param = None if include.wildcard else self.registry.get(source, include.code)
        return list(param.targets) if param and param.targets else self.catalog.types()

    def forward(self, source: str, page: DataFrame, include: Include) -> DataFrame | None:
        """_include: one join for each target type; with :iterate, what was reached is followed up to ITERATE_DEPTH rounds."""
        return self.reached(source, page, include) if include.iterate else self.targets(source, page, include)

    def reached(self, source: str, page: DataFrame, include: Include) -> DataFrame | None:
        """The rounds of :iterate. Each is one query over the edges of the types that the last one reached; its ids, at most
        INCLUDE_CAP in all rounds, the first by type and id, come to the driver, so that no plan holds that of the round before."""
        spark, seen = page.sparkSession, set()
        fresh = {source: [r["id"] for r in page.select("id").collect()]}  # at most MAX_COUNT
        for _ in range(ITERATE_DEPTH):
            parts = []
            for kind, ids in fresh.items():
                if include.wildcard or include.source in ("*", kind):
                    found = self.references(kind, spark.createDataFrame([(i,) for i in ids], "id string"), include)
                    parts += [found] if found is not None else []
            if not parts or len(seen) >= INCLUDE_CAP:
                break
            found = reduce(DataFrame.unionByName, parts).where(F.col("targetType").isin(self.catalog.types())).distinct()
            found = found.orderBy("targetType", "targetId").limit(INCLUDE_CAP + len(seen)).collect()
            new = [(r["targetType"], r["targetId"]) for r in found if (r["targetType"], r["targetId"]) not in seen][: INCLUDE_CAP - len(seen)]
            seen |= set(new)
            fresh = {kind: [i for k, i in new if k == kind] for kind in sorted({k for k, _ in new})}
        kinds = sorted({k for k, _ in seen})
        parts = [self.content(kind, spark.createDataFrame([(i,) for k, i in sorted(seen) if k == kind], "id string")) for kind in kinds]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def reverse(self, resource_type: str, page: DataFrame, include: Include) -> DataFrame | None:
        """_revinclude: resources of the source type that refer to rows of the page."""
        edges = self.edges(include.source, include)
        if edges is None:
            return None
        edges = edges.where(F.col("targetType") == resource_type)
        ids = edges.join(F.broadcast(page.select(F.col("id").alias("targetId")).distinct()), "targetId", "left_semi").select(F.col("resourceId").alias("id"))
        return self.content(include.source, ids)

    def included(self, request: SearchRequest, page: DataFrame) -> DataFrame | None:
        """Each included resource once; those of _include are at most INCLUDE_CAP, the first by type and id."""
        kind = request.resource_type
        forward = [x for i in request.include if i.wildcard or i.source == kind if (x := self.forward(kind, page, i)) is not None]
        reverse = [x for i in request.revinclude if (x := self.reverse(kind, page, i)) is not None]
        parts = []
        if forward:
            parts.append(reduce(DataFrame.unionByName, forward).dropDuplicates(["resourceType", "id"]).orderBy("resourceType", "id").limit(INCLUDE_CAP))
        parts += reverse
        return reduce(DataFrame.unionByName, parts).dropDuplicates(["resourceType", "id"]) if parts else None


def resources(rows: DataFrame) -> DataFrame:
    """Rows whose content is a live, readable JSON object."""
    return rows.where((F.col("deleted") == 0) & (F.col("content") != "") & F.try_parse_json(F.col("content")).isNotNull())


def stream(rows: DataFrame):
    """Contents one by one, fetched a partition at a time."""
    for r in resources(rows).select("content").toLocalIterator(prefetchPartitions=True):
        yield r["content"]
