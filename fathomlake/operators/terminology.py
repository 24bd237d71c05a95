"""Code systems, value sets, concept trees and conformance indexes as DataFrames keyed for lookups and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = "system string, code string, display string"
VALUE_SETS = "url string, version string, name string, content string"
CONCEPTS = "system string, code string, parent string, display string, level int"


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those of new whose key it lacks; of new rows with the same key, the least by content."""
    rest = [c for c in table.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("v")).select(*keys, "v.*") if rest else new.select(*keys).distinct()
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new in place of those with the same key."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def kept(rows: DataFrame) -> DataFrame:
    """rows without what they were made from, where the session has a checkpoint folder to keep them in."""
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows


class Table:
    """A keyed table that is replaced as a whole by each change."""

    def __init__(self, spark: SparkSession, schema: str, keys: list[str]):
        self.keys, self.rows = keys, spark.createDataFrame([], schema)

    def insert(self, new: DataFrame) -> int:
        fresh = kept(insert_ignore(self.rows.limit(0), new.select(*self.rows.columns), self.keys).join(self.rows.select(*self.keys), self.keys, "left_anti"))
        self.rows = kept(self.rows.unionByName(fresh))
        return fresh.count()

    def put(self, new: DataFrame) -> None:
        self.rows = kept(upsert(self.rows, new.select(*self.rows.columns), self.keys))

    def where(self, **values) -> DataFrame:
        rows = self.rows
        for k, v in values.items():
            rows = rows.where(F.col(k) == v)
        return rows

    def remove(self, **values) -> None:
        rows, keep = self.rows, None
        for k, v in values.items():
            test = ~F.col(k).eqNullSafe(F.lit(v))
            keep = test if keep is None else keep | test
        self.rows = rows.where(keep) if keep is not None else rows.limit(0)

    def clear(self) -> None:
        self.rows = self.rows.limit(0)

    def count(self) -> int:
        return self.rows.count()


class Terminology:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.codes = Table(spark, CODES, ["system", "code"])
        self.value_sets = Table(spark, VALUE_SETS, ["url", "version"])
        self.concepts = Table(spark, CONCEPTS, ["system", "code"])
        self.expansions = Table(spark, "url string, version string, expansion string, expandedAt string", ["url", "version"])

    def lookup(self, system: str, code: str) -> str | None:
        row = self.codes.where(system=system, code=code).select("display").first()
        return row["display"] if row else None

    def lookup_by_code(self, code: str) -> DataFrame:
        return self.codes.where(code=code).orderBy("system")

    def versions(self, url: str) -> DataFrame:
        return self.value_sets.where(url=url).orderBy("version")

    def keep_expansion(self, url: str, version: str, expansion: str, at: str) -> None:
        """Keeps a value set's expansion (JSON) in place of an earlier one."""
        self.expansions.put(self.spark.createDataFrame([(url, version, expansion, at)], self.expansions.rows.schema))

    def expansion(self, url: str, version: str) -> str | None:
        row = self.expansions.where(url=url, version=version).first()
        return row["expansion"] if row else None

    def forget_expansion(self, url: str, version: str | None = None) -> None:
        """Of one version, or of all."""
        self.expansions.remove(**({"url": url} if version is None else {"url": url, "version": version}))

    def tree(self, system: str) -> DataFrame:
        return self.concepts.where(system=system).orderBy("level", "code")

    def children(self, system: str, parent: str) -> DataFrame:
        return self.concepts.where(system=system, parent=parent).orderBy("code")

    def descendants(self, system: str, code: str) -> DataFrame:
        """All concepts below one, each once, by one join a level, until a level has nothing new."""
        rows = self.concepts.where(system=system)
        level, found = kept(rows.where(F.col("parent") == code)), rows.limit(0)
        while not level.isEmpty():
            found = kept(found.unionByName(level))
            below = rows.join(level.select(F.col("code").alias("parent")).distinct(), "parent", "left_semi").select(*rows.columns)
            level = kept(below.join(found.select("code"), "code", "left_anti").select(*rows.columns))
        return found


class Conformance:
    """Indexes of an implementation guide's definitions."""

    def __init__(self, spark: SparkSession):
        self.resources = Table(spark, "ig string, resourceType string, resourceId string, url string, name string, baseType string", ["ig", "resourceType", "resourceId"])
        self.structures = Table(spark, "id string, ig string, url string, type string, kind string, baseDefinition string, derivation string", ["id"])
        self.elements = Table(spark, "structureId string, path string, id string, min int, max string, types string", ["structureId", "id"])
        self.parameters = Table(spark, "ig string, code string, type string, base string, expression string, url string", ["ig", "url"])

    def structure(self, *, id: str | None = None, url: str | None = None):
        """A structure's row by id or url, else None."""
        return self.structures.where(**{k: v for k, v in (("id", id), ("url", url)) if v is not None}).orderBy("id").first()

    def structures_of(self, type: str) -> DataFrame:
        return self.structures.where(type=type).orderBy("id")

    def derived_from(self, base: str) -> DataFrame:
        return self.structures.where(baseDefinition=base).orderBy("id")

    def parameters_of(self, ig: str) -> DataFrame:
        return self.parameters.where(ig=ig).orderBy("code", "url")

    def parameters_named(self, code: str) -> DataFrame:
        return self.parameters.where(code=code).orderBy("ig", "url")

    def elements_like(self, structure: str, pattern: str) -> DataFrame:
        return self.elements.where(structureId=structure).where(F.col("path").like(pattern)).orderBy("path")

    def index(self, ig: str) -> DataFrame:
        """bucket and its entries: profiles, extensions, value sets, code systems, search parameters."""
        kind = F.col("resourceType")
        bucket = F.when((kind == "StructureDefinition") & (F.col("baseType") == "Extension"), "extensions").when(kind == "StructureDefinition", "profiles").when(kind == "ValueSet", "valueSets").when(kind == "CodeSystem", "codeSystems").when(kind == "SearchParameter", "searchParameters")
        rows = self.resources.where(ig=ig).withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
        return rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("name", "resourceId", "url"))).alias("entries"), F.count("*").alias("n"))


def import_guide(conformance: Conformance, terminology: Terminology, spark: SparkSession, ig: str, entries: Iterable[dict], *, elements_of: Callable[[dict], list[tuple]] = lambda r: [], concepts_of: Callable[[dict], list[tuple]] | None = None) -> dict:
    """Sorts a guide's resources into the indexes; an entry that can't be read is reported and the rest goes on."""
    rows: dict[str, list[tuple]] = {k: [] for k in ("resources", "structures", "elements", "parameters", "concepts")}
    errors = []
    for r in entries:
        try:
            kind, id = r["resourceType"], r["id"]
            rows["resources"].append((ig, kind, id, r.get("url"), r.get("name"), r.get("type")))
            if kind == "StructureDefinition":
                rows["structures"].append((id, ig, r.get("url"), r.get("type"), r.get("kind"), r.get("baseDefinition"), r.get("derivation")))
                rows["elements"] += elements_of(r)
            elif kind == "SearchParameter":
                rows["parameters"].append((ig, r["code"], r["type"], ",".join(r.get("base") or []), r.get("expression"), r.get("url")))
            elif kind == "CodeSystem":
                rows["concepts"] += (concepts_of or flatten_concepts)(r)
        except Exception as e:
            errors.append({"id": r.get("id") if isinstance(r, dict) else None, "error": repr(e)})
    targets = {"resources": conformance.resources, "structures": conformance.structures, "elements": conformance.elements, "parameters": conformance.parameters, "concepts": terminology.concepts}
    for name, found in rows.items():
        if found:
            targets[name].put(spark.createDataFrame(found, targets[name].rows.schema))
    return {name: len(found) for name, found in rows.items()} | {"errors": errors}


def flatten_concepts(system: dict) -> list[tuple]:
    """(system, code, parent, display, level) of a nested concept list, without recursion."""
    out, todo = [], [(c, None, 0) for c in reversed(system.get("concept") or [])]
    while todo:
        c, parent, level = todo.pop()
        out.append((system.get("url"), c["code"], parent, c.get("display"), level))
        todo += [(x, c["code"], level + 1) for x in reversed(c.get("concept") or [])]
    return out
