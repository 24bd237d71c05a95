"""Queries of the search engine and its store over the synthetic tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store_queries
from .functions import extract
from .operators.search import Searcher
from .operators.store import history_page, latest
from .operators.terminology import insert_ignore
from .plans.model import Include
from .plans.parser import parse_search
from .sources import tables
from .streaming.incremental import session_counts, window_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _searcher(spark: SparkSession, sf_dir: str, **options) -> Searcher:
    return Searcher(tables.catalog(spark, sf_dir), tables.registry(), **options)


def _search(key: str, kind: str, query: dict, shown: list[str], sql: str, *, page: bool = False, **fields) -> None:
    """Registers a search. All its matches, or with page its page, by the columns shown."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _searcher(spark, sf_dir)
        request = parse_search(kind, query, s.registry)
        for k, v in fields.items():
            setattr(request, k, v)
        return (s.page(request) if page else s.matches(request)).select(*shown)

    _QUERIES[key], _SQL[key] = run, sql


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


P, O, C = ["p_partkey"], ["o_orderkey"], ["c_custkey"]
part = lambda where: f"SELECT p_partkey FROM part WHERE {where}"
order = lambda where: f"SELECT o_orderkey FROM orders WHERE {where}"
customer = lambda where: f"SELECT c_custkey FROM customer WHERE {where}"

_search("s05_live_scan", "Part", {}, P, part("true"))
_search("s06_point_read", "Order", {"_id": "77"}, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
_search("f03_string_prefix", "Part", {"name": "COLD"}, P, part("lower(p_name) LIKE 'cold%'"))
_search("f04_string_exact", "Part", {"name:exact": "cold widget"}, P, part("p_name = 'cold widget'"))
_search("f05_string_contains", "Part", {"name:contains": "WIDG"}, P, part("lower(p_name) LIKE '%widg%'"))
for _p, _op in {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "sa": ">", "eb": "<"}.items():
    _search(f"f06_date_{_p}", "Order", {"date": f"{_p}1997-01-15"}, O, order(f"o_orderdate {_op} TIMESTAMP '1997-01-15'"))
    _search(f"f08_number_{_p}", "Part", {"size": f"{_p}24"}, P, part(f"p_size {_op} 24"))
_search("f07_date_ap", "Order", {"date": "ap1997-01-15"}, O, order("o_orderdate BETWEEN TIMESTAMP '1997-01-14' AND TIMESTAMP '1997-01-16'"))
_search("f09_number_ap", "Customer", {"balance": "ap2000"}, C, customer(f"c_acctbal BETWEEN {2000 * 0.9!r}::DOUBLE AND {2000 * 1.1!r}::DOUBLE"))
_search("f10_ne_or", "Part", {"size": "ne10,ne20"}, P, part("p_size <> 10 OR p_size <> 20"))
_search("f11_reference", "Order", {"subject": "Customer/5,Customer/9"}, O, order("o_custkey IN (5, 9)"))
_search("f12_reference_overlap", "Order", {"related": "Customer/5,Customer/9"}, O, order("list_has_any(['Customer/' || o_custkey], ['Customer/5', 'Customer/9'])"))
_search("f13_uri", "Part", {"uri": "urn:type:ECONOMY"}, P, part("'urn:type:' || p_type = 'urn:type:ECONOMY'"))
_TOKENS = "['urn:status|' || o_orderstatus, '|' || o_orderstatus]"
_search("f14_token_exact", "Order", {"status": "urn:status|F"}, O, order(f"list_has_any({_TOKENS}, ['urn:status|F'])"))
_search("f14_token_no_system", "Order", {"status": "|O"}, O, order(f"list_has_any({_TOKENS}, ['|O'])"))
_search("f15_token_system", "Order", {"status": "urn:status|"}, O, order("true"))
_search("f16_token_bare", "Order", {"status": "P,F"}, O, order("o_orderstatus IN ('P', 'F')"))
_search("f17_token_not", "Order", {"status:not": "F"}, O, order("NOT o_orderstatus = 'F'"))
_search("f18_token_text", "Order", {"priority:text": "URN:priority|1"}, O, order("lower('urn:priority|' || o_orderpriority) LIKE 'urn:priority|1%'"))
_search("f20_lookup_prefix", "Customer", {"name": "customer#00000001"}, C, customer("EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey = customer.c_custkey AND lower(n.c_name) LIKE 'customer#00000001%')"))
_search("f20_lookup_contains", "Customer", {"name:contains": "00012"}, C, customer("lower(c_name) LIKE '%00012%'"))
_search("f21_name_exact", "Customer", {"name:exact": "000000012"}, C, customer("split_part(c_name, '#', 2) = '000000012' OR split_part(c_name, '#', 1) = '000000012'"))
_search("f24_missing", "Order", {"note:missing": "true"}, O, order("nullif(o_orderpriority, '5-LOW') IS NULL"))
_search("f24_not_missing", "Order", {"note:missing": "false"}, O, order("nullif(o_orderpriority, '5-LOW') IS NOT NULL"))
_search("f28_compartment", "Order", {}, O, order("list_contains([CAST(o_custkey AS VARCHAR)], '7')"), compartment="7")
_search("f29_tenant", "Order", {"status": "F"}, O, order("o_custkey % 3 = 1 AND o_orderstatus = 'F'"), project="p1")
_search("f30_and", "Order", {"status": "F", "date": ["ge1996-01-01", "lt1998-01-01"], "total": "gt100000"}, O, order("o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice > 100000"))
_search("j02_chain_number", "Order", {"subject:Customer.balance": "gt5000"}, O, order("EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)"))
_search("j02_chain_token", "Order", {"subject:Customer.segment": "FURNITURE"}, O, order("EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'FURNITURE')"))
_search("j02_chain_name", "Order", {"subject:Customer.name": "customer#00000001"}, O, order("EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND lower(c_name) LIKE 'customer#00000001%')"))
_search("o01_sort_multi", "Order", {"status": "F", "_sort": "-total,date", "_count": "50"}, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 50", page=True)
_search("o02_default_order", "Order", {}, O, "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20", page=True)
_search("o03_nulls_first", "Order", {"_sort": "note", "_count": "30"}, O, "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderpriority, '5-LOW') NULLS FIRST, CAST(o_orderkey AS VARCHAR) LIMIT 30", page=True)
_search("o05_offset", "Order", {"_sort": "date", "_count": "25", "_offset": "40"}, O, "SELECT o_orderkey FROM orders ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 40", page=True)
_search("x02_json_number", "Event", {"k": "gt50"}, ["event_id"], "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")

_PAGE = "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50"
_ASK = {"status": "F", "_sort": "-total", "_count": "50"}


@_query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def a01_count(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.count(parse_search("Order", {"status": "F"}, s.registry))


def _included(spark, sf_dir, kind, query):
    s = _searcher(spark, sf_dir)
    request = parse_search(kind, query, s.registry)
    return s.included(request, s.page(request)).select("resourceType", "id")


@_query(f"WITH p AS ({_PAGE}) SELECT DISTINCT 'Customer' AS resourceType, CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN p ON c_custkey = o_custkey")
def j06_include(spark, sf_dir):
    return _included(spark, sf_dir, "Order", _ASK | {"_include": "Order:subject"})


@_query(f"WITH p AS ({_PAGE}) SELECT DISTINCT 'Customer' AS resourceType, CAST(o_custkey AS VARCHAR) AS id FROM p")
def j07_include_target(spark, sf_dir):
    return _included(spark, sf_dir, "Order", _ASK | {"_include": "Order:subject:Customer"})


@_query(f"WITH p AS ({_PAGE}) SELECT DISTINCT 'Customer' AS resourceType, CAST(o_custkey AS VARCHAR) AS id FROM p")
def j08_include_wildcard(spark, sf_dir):
    return _included(spark, sf_dir, "Order", _ASK | {"_include": "*"})


@_query(f"""WITH p AS ({_PAGE}), c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN p ON c_custkey = o_custkey), n AS (SELECT DISTINCT n_nationkey, n_regionkey FROM nation JOIN c ON n_nationkey = c_nationkey)
SELECT 'Customer' AS resourceType, CAST(c_custkey AS VARCHAR) AS id FROM c UNION SELECT 'Nation', CAST(n_nationkey AS VARCHAR) FROM n UNION SELECT 'Region', CAST(n_regionkey AS VARCHAR) FROM n""")
def j09_include_iterate(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    request = parse_search("Order", _ASK, s.registry)
    return s.forward("Order", s.page(request), Include("*", wildcard=True, iterate=True)).select("resourceType", "id")


@_query("WITH p AS (SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 20) SELECT DISTINCT 'Order' AS resourceType, CAST(o_orderkey AS VARCHAR) AS id FROM orders JOIN p ON o_custkey = c_custkey")
def j10_revinclude(spark, sf_dir):
    return _included(spark, sf_dir, "Customer", {"segment": "FURNITURE", "_sort": "-balance", "_revinclude": "Order:subject"})


@_query(f"SELECT o_orderkey, o_totalprice FROM ({_PAGE})")
def j12_two_phase(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.page_in_two_phases(parse_search("Order", _ASK, s.registry)).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, 'urn:status|' || o_orderstatus AS token FROM orders UNION ALL SELECT o_orderkey, '|' || o_orderstatus FROM orders")
def x05_token_strings(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.explode(extract.token_strings(F.lit("urn:status"), F.col("o_orderstatus"))).alias("token"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS resourceId, 'Customer' AS targetType, CAST(o_custkey AS VARCHAR) AS targetId FROM orders")
def x14_reference_edges(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = extract.reference_edges(F.concat(F.lit("https://host/base/Customer/"), F.col("o_custkey").cast("string")))
    return o.select(F.col("o_orderkey").cast("string").alias("resourceId"), e.alias("e")).select("resourceId", "e.*")


@_query("WITH h AS (SELECT o_orderkey, sha256('urn:status|' || o_orderstatus) AS h FROM orders) SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS token FROM h")
def x16_token_hash(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", extract.token_hash(F.lit("urn:status"), F.col("o_orderstatus")).alias("token"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x02_json_extract(spark, sf_dir):
    """By the generic extractor: whole contents, read without a schema."""
    from .plans.registry import Registry

    r = Registry()
    r.define("k", "number", ["Event"], "Event.k")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("string").alias("id"), F.col("props").alias("content"))
    return extract.index_contents(e, "Event", r).select("event_id", F.col("k").cast("long").alias("k"))


def _versions(spark, sf_dir):
    """Events as versions of their user: the kind error deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("versionSeq"), F.col("user_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastUpdated"), F.col("props").alias("content"), (F.col("event_type") == "error").cast("int").alias("deleted"))


@_query("SELECT event_id AS versionSeq, CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id = 13 AND event_id < 900 ORDER BY event_id DESC LIMIT 10")
def o07_instance_history(spark, sf_dir):
    return history_page(_versions(spark, sf_dir), "13", cursor=900, limit=10).select("versionSeq", "id")


@_query("SELECT event_id AS versionSeq, CAST(user_id AS VARCHAR) AS id FROM events WHERE ts >= TIMESTAMP '2024-01-02' ORDER BY event_id DESC LIMIT 40")
def o08_type_history(spark, sf_dir):
    return history_page(_versions(spark, sf_dir), since="2024-01-02T00:00:00.000Z", limit=40).select("versionSeq", "id")


@_query("SELECT event_id AS versionSeq, CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id = 13 ORDER BY ts DESC, event_id DESC LIMIT 10")
def o09_history_by_time(spark, sf_dir):
    return history_page(_versions(spark, sf_dir), "13", limit=10, by="lastUpdated").select("versionSeq", "id")


_LATEST = "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS versionSeq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events"


@_query(f"SELECT id, versionSeq FROM ({_LATEST}) WHERE r = 1")
def w06_latest_version(spark, sf_dir):
    return latest(_versions(spark, sf_dir)).select("id", "versionSeq")


@_query("SELECT DISTINCT p_brand AS code, 'brand' AS system, min(p_type) OVER (PARTITION BY p_brand) AS display FROM part WHERE p_brand <> 'Brand#13' UNION ALL SELECT 'Brand#13', 'brand', 'first'")
def t01_insert_ignore(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("brand").alias("system"), F.col("p_brand").alias("code"), F.col("p_type").alias("display"))
    return insert_ignore(spark.createDataFrame([("brand", "Brand#13", "first")], "system string, code string, display string"), p, ["system", "code"])


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumbling_counts(spark, sf_dir):
    return window_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), by=["event_type"]).select(F.col("window.start").alias("start"), "event_type", "n")


@_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def st_session_counts(spark, sf_dir):
    return session_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), by=["user_id"]).select("user_id", F.col("session_window.start").alias("start"), "n")


@_query(f"SELECT o_orderkey, o_totalprice FROM ({_PAGE})")
def flagship_search(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.page(parse_search("Order", "status=F&_sort=-total&_count=50", s.registry)).select("o_orderkey", "o_totalprice")


def queries() -> dict[str, Query]:
    return _QUERIES | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | store_queries.oracle_sql()
