"""The synthetic tables as resource types: what a search on them means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import token_strings
from ..plans.model import SearchParam
from ..plans.registry import Registry
from .frames import Catalog, ResourceFrame


def registry() -> Registry:
    r = Registry()
    col = lambda kind, code, type, column=None, array=False, targets=(): r.bind(kind, SearchParam(code, type, "column", column or code, array, targets=tuple(targets)))
    token = lambda kind, code: r.bind(kind, SearchParam(code, "token", "token-column", code, True))
    r.bind("Customer", SearchParam("name", "string", "lookup-table", "name"))
    col("Customer", "balance", "number")
    token("Customer", "segment")
    col("Customer", "nation", "reference", targets=["Nation"])
    token("Order", "status")
    token("Order", "priority")
    col("Order", "date", "date")
    col("Order", "total", "quantity")
    col("Order", "subject", "reference", targets=["Customer"])
    col("Order", "related", "reference", array=True, targets=["Customer"])
    col("Order", "note", "string")
    for code in ("name", "brand", "type"):
        col("Part", code, "string")
    col("Part", "size", "number")
    col("Part", "uri", "uri")
    col("Nation", "name", "string")
    col("Nation", "region", "reference", targets=["Region"])
    col("Region", "name", "string")
    token("Event", "type")
    col("Event", "date", "date")
    col("Event", "value", "quantity")
    col("Event", "k", "number")
    col("Event", "subject", "reference", targets=["Customer"])
    return r


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    ref = lambda kind, c: F.concat(F.lit(kind + "/"), text(c))
    base = lambda df, id, at=None: df.withColumns({"id": text(id), "versionId": F.lit("1"), "lastUpdated": F.lit("2024-01-01T00:00:00.000Z") if at is None else F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "deleted": F.lit(0)})

    def with_token(df: DataFrame, name: str, system: str, c: str) -> DataFrame:
        return df.withColumns({f"__{name}": token_strings(F.lit(system), F.col(c)), f"__{name}Sort": F.concat(F.lit(system + "|"), F.col(c))})

    def edges(df: DataFrame, id: str, kind: str, c: str, code: str) -> DataFrame:
        return df.select(text(id).alias("resourceId"), F.lit(kind).alias("targetType"), text(c).alias("targetId"), F.lit(code).alias("code"), ref(kind, c).alias("referenceRaw"))

    def customer() -> ResourceFrame:
        c = read("customer")
        main = with_token(base(c, "c_custkey"), "segment", "urn:segment", "c_mktsegment").withColumns({"balance": F.col("c_acctbal"), "__nameSort": F.col("c_name"), "nation": ref("Nation", "c_nationkey"), "content": F.to_json(F.struct("c_custkey", "c_name"))})
        names = c.select(text("c_custkey").alias("resourceId"), F.col("c_name").alias("name"), F.substring_index("c_name", "#", 1).alias("given"), F.substring_index("c_name", "#", -1).alias("family"))
        return ResourceFrame("Customer", main, edges(c, "c_custkey", "Nation", "c_nationkey", "nation"), {"HumanName": names})

    def order() -> ResourceFrame:
        o = read("orders")
        main = with_token(with_token(base(o, "o_orderkey", F.col("o_orderdate")), "status", "urn:status", "o_orderstatus"), "priority", "urn:priority", "o_orderpriority")
        main = main.withColumns({"date": F.col("o_orderdate"), "total": F.col("o_totalprice"), "subject": ref("Customer", "o_custkey"), "related": F.array(ref("Customer", "o_custkey")), "note": F.nullif("o_orderpriority", F.lit("5-LOW")), "compartments": F.array(text("o_custkey")), "projectId": F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(3)).cast("string")), "content": F.to_json(F.struct("o_orderkey", "o_custkey"))})
        return ResourceFrame("Order", main, edges(o, "o_orderkey", "Customer", "o_custkey", "subject"), timestamps=frozenset({"date"}))

    def part() -> ResourceFrame:
        p = base(read("part"), "p_partkey").withColumns({"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("double"), "uri": F.concat(F.lit("urn:type:"), F.col("p_type")), "content": F.to_json(F.struct("p_partkey", "p_name"))})
        return ResourceFrame("Part", p)

    def nation() -> ResourceFrame:
        n = read("nation")
        main = base(n, "n_nationkey").withColumns({"name": F.col("n_name"), "region": ref("Region", "n_regionkey"), "content": F.to_json(F.struct("n_nationkey", "n_name"))})
        return ResourceFrame("Nation", main, edges(n, "n_nationkey", "Region", "n_regionkey", "region"))

    def region() -> ResourceFrame:
        return ResourceFrame("Region", base(read("region"), "r_regionkey").withColumns({"name": F.col("r_name"), "content": F.to_json(F.struct("r_regionkey", "r_name"))}))

    def event() -> ResourceFrame:
        e = read("events")
        main = with_token(base(e, "event_id", F.col("ts")), "type", "urn:event", "event_type").withColumns({"date": F.col("ts"), "k": F.get_json_object("props", "$.k").cast("double"), "subject": ref("Customer", "user_id"), "content": F.col("props")})
        return ResourceFrame("Event", main, edges(e, "event_id", "Customer", "user_id", "subject"), timestamps=frozenset({"date"}))

    return Catalog({"Customer": customer, "Order": order, "Part": part, "Nation": nation, "Region": region, "Event": event})
