"""Queries that go through the store, transactions, schemas, terminology and bundles, and the same in DuckDB's SQL.

Each fills a store of its own from a synthetic table, in the cluster's checkpoint folder, or this machine's where none is set.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import initialize
from .functions import extract
from .operators import bundles, transactions
from .operators.store import Store
from .operators.terminology import CONCEPTS, Terminology
from .plans import schema
from .plans.parser import parse_search
from .plans.registry import Registry

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AT = "2024-05-05T00:00:00.000Z"


def _query(sql: str):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def people() -> Registry:
    r = Registry()
    r.define("name", "string", ["Person"], "Person.name")
    r.define("active", "token", ["Person"], "Person.active")
    r.define("segment", "token", ["Person"], "Person.segment")
    r.define("balance", "number", ["Person"], "Person.balance")
    r.define("country", "reference", ["Person"], "Person.country", ["Land"])
    r.define("identifier", "token", ["Person"], "Person.identifier")
    r.define("telecom", "token", ["Person"], "Person.telecom")
    r.define("address", "string", ["Person"], "Person.address")
    r.define("title", "string", ["Land"], "Land.title")
    return r


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as Person resources."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("id", F.col("c_custkey").cast("string"))
    part = lambda i: F.split("c_name", "#").getItem(i)
    resource = F.struct(
        F.lit("Person").alias("resourceType"), "id", F.struct(F.lit("urn:load").alias("source"), F.array(F.struct(F.lit("urn:tag").alias("system"), F.col("c_mktsegment").alias("code"))).alias("tag"), F.array(F.lit("urn:profile:person")).alias("profile"), F.array(F.struct(F.lit("urn:sec").alias("system"), F.lit("R").alias("code"))).alias("security")).alias("meta"),
        F.array(F.struct(part(1).alias("family"), F.array(part(0)).alias("given"))).alias("name"), F.lit(True).alias("active"), F.struct(F.array(F.struct(F.lit("urn:segment").alias("system"), F.col("c_mktsegment").alias("code"))).alias("coding")).alias("segment"),
        F.col("c_acctbal").alias("balance"), F.struct(F.concat(F.lit("Land/"), F.col("c_nationkey").cast("string")).alias("reference")).alias("country"), F.array(F.struct(F.lit("urn:key").alias("system"), F.col("id").alias("value"))).alias("identifier"),
        F.array(F.struct(F.lit("phone").alias("system"), F.concat(F.lit("+"), "id").alias("value"))).alias("telecom"), F.array(F.struct(F.col("c_mktsegment").alias("city"), F.lit("X").alias("country"))).alias("address"),
    )
    return c.select("id", F.to_json(resource).alias("content"))


def new_store(spark: SparkSession, sf_dir: str | None = None) -> Store:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    ids = itertools.count(1)
    store = Store(spark, f"{shared}/stores/{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="store-"), people(), clock=lambda: AT, new_id=lambda: f"new{next(ids)}")
    if sf_dir:
        store.load("Person", contents(spark, sf_dir))
    return store


def person(store: Store, id: str, **changes) -> dict:
    return store.read("Person", id) | changes


def matches(store: Store, query) -> DataFrame:
    s = store.searcher()
    return s.matches(parse_search("Person", query, s.registry)).select("id")


ID = "CAST(c_custkey AS VARCHAR) AS id"


@_query(f"SELECT {ID}, CASE WHEN c_custkey = 5 THEN 2 ELSE 1 END AS versionNumber FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'new-one', 1")
def w01_w03_w05_store_writes(spark, sf_dir):
    """Create, update and delete on a loaded store, then its live state."""
    store = new_store(spark, sf_dir)
    store.create("Person", {"resourceType": "Person", "active": False}, id="new-one")
    store.update("Person", person(store, "5", active=False))
    store.delete("Person", "7")
    return store.state("Person").where("deleted = 0").select("id", "versionNumber")


@_query(f"SELECT {ID} FROM customer WHERE c_custkey NOT IN (7, 8)")
def f27_search_without_deleted(spark, sf_dir):
    store = new_store(spark, sf_dir)
    for id in ("7", "8"):
        store.delete("Person", id)
    return matches(store, {})


@_query(f"SELECT {ID}, c_acctbal AS balance FROM customer WHERE c_custkey = 12")
def sc06_store_read(spark, sf_dir):
    r = new_store(spark, sf_dir).read("Person", "12")
    return spark.createDataFrame([(r["id"], float(r["balance"]))], "id string, balance double")


@_query("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(versionNumber, active)")
def sc07_version_reads(spark, sf_dir):
    store = new_store(spark, sf_dir)
    for active in (False, True):
        store.update("Person", person(store, "9", active=active))
    versions = store.history("Person", "9").select("versionNumber", "versionId").collect()  # three
    return spark.createDataFrame([(v["versionNumber"], store.read_version("Person", "9", v["versionId"])["active"]) for v in versions], "versionNumber int, active boolean")


@_query(f"SELECT {ID}, c_custkey IN (3, 4) AS changed FROM customer WHERE c_custkey <> 6")
def m11_compact_then_write(spark, sf_dir):
    """Reads from the compacted tables and of what was written since."""
    store = new_store(spark, sf_dir)
    store.update("Person", person(store, "3", balance=-1e9))
    store.compact("Person")
    store.update("Person", person(store, "4", balance=-1e9))
    store.delete("Person", "6")
    store.reindex("Person", "9")
    low = matches(store, {"balance": "lt-1000000"}).withColumn("changed", F.lit(True))
    return matches(store, {}).join(low, "id", "left").na.fill(False, ["changed"])


@_query(f"SELECT {ID} FROM (SELECT c_custkey FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 30)")
def o10_keyset_scan(spark, sf_dir):
    store, after, parts = new_store(spark, sf_dir), None, []
    for _ in range(3):
        rows = store.scan("Person", after, 10).collect()  # a batch of ten
        parts += [(r["id"],) for r in rows]
        after = rows[-1]["id"]
    return spark.createDataFrame(parts, "id string")


@_query(f"SELECT 'Person' AS resourceType, {ID} FROM customer UNION ALL SELECT 'Person', 'new1' UNION ALL SELECT 'Land', 'new2'")
def w10_transaction(spark, sf_dir):
    """Two types written by one transaction, and one that fails and leaves nothing."""
    store = new_store(spark, sf_dir)
    entry = lambda urn, r: {"fullUrl": f"urn:uuid:{urn}", "resource": r, "request": {"method": "POST", "url": r["resourceType"]}}
    transactions.transaction(store, {"entry": [entry("p", {"resourceType": "Person", "country": {"reference": "urn:uuid:l"}}), entry("l", {"resourceType": "Land", "title": "T"})]})
    transactions.transaction(store, {"entry": [entry("q", {"resourceType": "Land", "title": "U"}), {"request": {"method": "GET", "url": "Person/absent"}}]})
    return store.state("Person").select(F.lit("Person").alias("resourceType"), "id").unionByName(store.state("Land").select(F.lit("Land").alias("resourceType"), "id"))


@_query("SELECT * FROM (VALUES ('201', 'Person/new1'), ('204', NULL), ('404', NULL)) t(status, location)")
def w11_batch(spark, sf_dir):
    store = new_store(spark, sf_dir)
    ask = lambda method, url, r=None: {"request": {"method": method, "url": url}, "resource": r}
    out = transactions.batch(store, {"entry": [ask("POST", "Person", {"resourceType": "Person"}), ask("DELETE", "Person/2"), ask("GET", "Person/absent")]})
    return spark.createDataFrame([(e["response"]["status"], e["response"].get("location")) for e in out["entry"]], "status string, location string")


@_query("SELECT count(*) AS n FROM customer WHERE c_custkey % 400 = 1")
def w09_conditional_delete(spark, sf_dir):
    store = new_store(spark, sf_dir)
    ids = [str(r["c_custkey"]) for r in spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 400 = 1").select("c_custkey").limit(1000).collect()]
    return spark.createDataFrame([(store.conditional_delete("Person", {"_id": ",".join(ids)}),)], "n long")


SEARCHES = {
    "f25_source": ({"_source": "urn:load"}, "true"),
    "f25_security": ({"_security": "urn:sec|R"}, "true"),
    "f25_tag": ({"_tag": "urn:tag|BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "f13_profile": ({"_profile": "urn:profile:person"}, "true"),
    "p10_last_updated": ({"_lastUpdated": "ge2024-05-05"}, "true"),
    "x03_token_concept": ({"segment": "urn:segment|FURNITURE"}, "c_mktsegment = 'FURNITURE'"),
    "x04_boolean_token": ({"active": "true"}, "true"),
    "x06_number": ({"balance": "gt5000"}, "c_acctbal > 5000"),
    "x08_name_rows": ({"name": "00000001"}, "split_part(c_name, '#', 2) LIKE '00000001%'"),
    "x10_reference": ({"country": "Land/3"}, "c_nationkey = 3"),
    "x11_identifier": ({"identifier": "urn:key|12"}, "c_custkey = 12"),
    "x13_address": ({"address": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "f19_token_not_in_or": ({"segment:not": "FURNITURE,BUILDING"}, "c_mktsegment NOT IN ('FURNITURE', 'BUILDING')"),
}


def _search(key: str, query: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matches(new_store(spark, sf_dir), query)

    _QUERIES[key], _SQL[key] = run, f"SELECT {ID} FROM customer WHERE {where}"


for _key, (_ask, _where) in SEARCHES.items():
    _search(_key, _ask, _where)


@_query(f"SELECT {ID}, split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1) AS sort_text, 'urn:segment|' || c_mktsegment AS segment, 'Land/' || c_nationkey AS country, c_acctbal AS balance FROM customer")
def x07_x12_indexed_columns(spark, sf_dir):
    """The search columns that the extractor derives from contents: sort text of a name, token, reference, number."""
    rows = extract.index_contents(contents(spark, sf_dir), "Person", people())
    return rows.select("id", F.col("__nameSort").alias("sort_text"), F.col("__segment")[0].alias("segment"), "country", "balance")


@_query(f"SELECT CAST(c_custkey AS VARCHAR) AS resourceId, 'Land' AS targetType, CAST(c_nationkey AS VARCHAR) AS targetId, 'country' AS code FROM customer")
def x14_edges_of_contents(spark, sf_dir):
    return extract.edges_from(extract.index_contents(contents(spark, sf_dir), "Person", people())).select("resourceId", "targetType", "targetId", "code")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS resourceId, split_part(c_name, '#', 1) AS given, split_part(c_name, '#', 2) AS family FROM customer")
def x15_lookup_rows(spark, sf_dir):
    rows = extract.index_contents(contents(spark, sf_dir), "Person", people())
    return extract.lookups_from(rows, "HumanName", "Person").select("resourceId", "given", "family")


@_query("SELECT * FROM (VALUES ('orders', 'completed', (SELECT count(*) FROM orders)), ('part', 'completed', (SELECT count(*) FROM part)), ('absent', 'failed', 0)) t(name, status, processed)")
def a03_job_counts(spark, sf_dir):
    """Reindex jobs of a package, run over whole tables; one of them fails."""
    p = schema.Packages()
    for table in ("orders", "part", "absent"):
        p.schedule(table)
    p.run_jobs(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet").count())
    assert p.job_counts() == {"pending": 0, "running": 0, "completed": 2, "failed": 1}
    return spark.createDataFrame([(j["table"], j["status"], j["processed"]) for j in p.jobs], "name string, status string, processed long")


@_query("SELECT * FROM (VALUES (1, 'base@1', 'new'), (2, 'base@3', 'upgrade')) t(number, name, status)")
def a04_next_version(spark, sf_dir):
    """Schema versions that starts of a package make: a consistent one makes none."""
    p, r = schema.Packages(), people()
    first = schema.snapshot(r)
    found = [p.initialize("base", "1", first)[0], p.initialize("base", "2", first)[0]]
    r.define("added", "string", ["Land"], "Land.added")
    found.append(p.initialize("base", "3", schema.snapshot(r))[0])
    status = [s for s in found if s != "consistent"]
    return spark.createDataFrame([(v.number, v.name, s) for v, s in zip(p.versions, status, strict=True)], "number int, name string, status string")


def nations(spark: SparkSession, sf_dir: str) -> Terminology:
    t = Terminology(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    below = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("geo").alias("system"), F.col("n_name").alias("code"), F.col("r_name").alias("parent"), F.col("n_name").alias("display"), F.lit(2).alias("level"))
    regions = read("region").select(F.lit("geo").alias("system"), F.col("r_name").alias("code"), F.lit("WORLD").alias("parent"), F.col("r_name").alias("display"), F.lit(1).alias("level"))
    world = spark.createDataFrame([("geo", "WORLD", None, "World", 0)], CONCEPTS)
    t.concepts.put(below.unionByName(regions).unionByName(world))
    t.codes.insert(read("nation").select(F.lit("geo").alias("system"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("display")))
    return t


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS display FROM nation WHERE n_nationkey IN (0, 5, 24) UNION ALL SELECT 'none', NULL")
def t02_lookup(spark, sf_dir):
    t = nations(spark, sf_dir)
    return spark.createDataFrame([(c, t.lookup("geo", c)) for c in ("0", "5", "24", "none")], "code string, display string")


@_query("SELECT n_name AS code, r_name AS parent, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD', 1 FROM region UNION ALL SELECT 'WORLD', NULL, 0")
def t04_concept_tree(spark, sf_dir):
    return nations(spark, sf_dir).tree("geo").select("code", "parent", "level")


@_query("SELECT n_name AS code, 2 AS level FROM nation UNION ALL SELECT r_name, 1 FROM region")
def t04_descendants(spark, sf_dir):
    return nations(spark, sf_dir).descendants("geo", "WORLD").select("code", "level")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'match' AS mode, 'base/Order/' || o_orderkey AS fullUrl FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20) UNION SELECT CAST(o_custkey AS VARCHAR), 'include', 'base/Customer/' || o_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20)")
def pr04_search_entries(spark, sf_dir):
    from .operators.search import Searcher
    from .sources import tables

    s = Searcher(tables.catalog(spark, sf_dir), tables.registry())
    result = s.search(parse_search("Order", {"status": "F", "_sort": "-total", "_include": "Order:subject"}, s.registry))
    return bundles.search_entries(result, "Order", "base").select("id", "mode", "fullUrl")


@_query("SELECT * FROM (VALUES ('DELETE', '204'), ('PUT', '200'), ('POST', '201')) t(method, status)")
def pr06_history_entries(spark, sf_dir):
    store = new_store(spark, sf_dir)
    store.update("Person", person(store, "11", active=False))
    store.delete("Person", "11")
    return bundles.history_entries(store.history("Person", "11"), "Person").select("method", "status")


@_query("SELECT * FROM (VALUES ('self', 'Order?status=F&_count=20&_offset=40'), ('next', 'Order?status=F&_count=20&_offset=60')) t(relation, url)")
def o11_page_links(spark, sf_dir):
    from .sources import tables

    request = parse_search("Order", {"status": "F", "_count": "20", "_offset": "40"}, tables.registry())
    return spark.createDataFrame([(x["relation"], x["url"]) for x in bundles.page_links("Order", {"status": "F"}, request, 20)], "relation string, url string")


@_query("SELECT * FROM (VALUES ('Agent', 3), ('Bot', 3), ('ClientApplication', 3), ('Project', 3), ('User', 3)) t(kind, parameters)")
def m14_platform_parameters(spark, sf_dir):
    r = schema.load_platform(Registry())
    return spark.createDataFrame([(kind, len(r.params(kind))) for kind in r.types()], "kind string, parameters int")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, concat_ws('~', 'urn:key|' || c_custkey, '|' || c_custkey, 'urn:tag|' || c_mktsegment, '|' || c_mktsegment, 'urn:sec|R', '|R') AS tokens FROM customer")
def a06_shared_tokens(spark, sf_dir):
    rows = extract.index_contents(contents(spark, sf_dir), "Person", people())
    return rows.select("id", F.array_join(extract.shared_tokens(F.col("__identifier"), F.col("___tag"), F.col("___security")), "~").alias("tokens"))


@_query("WITH p AS (SELECT * FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 30) SELECT DISTINCT 'Land' AS resourceType, CAST(c_nationkey AS VARCHAR) AS id FROM p")
def j08_include_any_depth(spark, sf_dir):
    """References below elements that no parameter indexes."""
    store, c = new_store(spark), spark.read.parquet(f"{sf_dir}/customer.parquet")
    land = F.struct(F.concat(F.lit("Land/"), F.col("c_nationkey").cast("string")).alias("reference"))
    resource = F.struct(F.col("c_acctbal").alias("balance"), F.array(F.struct(F.struct(land.alias("inner")).alias("outer"))).alias("extension"))
    store.load("Person", c.select(F.col("c_custkey").cast("string").alias("id"), F.to_json(resource).alias("content")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    store.load("Land", n.select(F.col("n_nationkey").cast("string").alias("id"), F.to_json(F.struct(F.col("n_name").alias("title"))).alias("content")))
    s = store.searcher()
    request = parse_search("Person", "_sort=-balance&_count=30&_include=*", s.registry)
    return s.included(request, s.page(request)).select("resourceType", "id")


@_query("SELECT * FROM (VALUES ('new', 0), ('consistent', 0), ('upgrade', 1)) t(status, pending) UNION ALL SELECT 'found', count(*)::INT FROM customer WHERE c_mktsegment = 'FURNITURE'")
def m13_startup(spark, sf_dir):
    """Three starts on one folder, each with packages read from it; the last adds a parameter, whose column is filled by its job."""
    store, rows = new_store(spark, sf_dir), []
    first, more = people(), people()
    more.define("city", "string", ["Person"], "Person.address.city")
    store.compact("Person")
    for version, registry in (("1", first), ("1", first), ("2", more)):
        engine = initialize(spark, store.root, registry, package="base", version=version)
        rows.append((engine.status, engine.packages.job_counts()["pending"]))
    assert engine.reindex() == {"pending": 0, "running": 0, "completed": 1, "failed": 0}
    s = engine.store.searcher()
    rows.append(("found", s.count(parse_search("Person", "city=FURNITURE", s.registry)).first()["count"]))
    return spark.createDataFrame(rows, "status string, pending int")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
