"""Bundles: result sets as documents, with links between pages."""

from __future__ import annotations

import json
from collections.abc import Iterable
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import SearchRequest
from .search import SearchResult


def search_entries(result: SearchResult, resource_type: str, base: str = "") -> DataFrame:
    """fullUrl, mode ("match" or "include"), resourceType, id, content."""
    rows = result.page.select(F.lit(resource_type).alias("resourceType"), F.col("id"), F.col("content"), F.lit("match").alias("mode"))
    if result.included is not None:
        rows = rows.unionByName(result.included.withColumn("mode", F.lit("include")))
    return rows.withColumn("fullUrl", F.concat(F.lit(base.rstrip("/") + "/" if base else ""), F.col("resourceType"), F.lit("/"), F.col("id")))


def page_links(base: str, query: dict, request: SearchRequest, found: int) -> list[dict[str, str]]:
    """A link to this page, and to the next if this one is full."""
    size, at = request.page_size, request.offset or 0
    url = lambda offset: base + "?" + urlencode([*((k, v) for k, vs in query.items() if k not in ("_offset", "_count") for v in ([vs] if isinstance(vs, str) else vs)), ("_count", size), *([("_offset", offset)] if offset else [])])
    links = [{"relation": "self", "url": url(at)}]
    if size > 0 and found >= size:
        links.append({"relation": "next", "url": url(at + size)})
    return links


def search_bundle(result: SearchResult, request: SearchRequest, base: str = "", query: dict | None = None) -> dict:
    entries = [{"fullUrl": r["fullUrl"], "resource": json.loads(r["content"]), "search": {"mode": r["mode"]}} for r in search_entries(result, request.resource_type, base).collect()]
    found = sum(e["search"]["mode"] == "match" for e in entries)
    bundle = {"resourceType": "Bundle", "type": "searchset", "entry": entries}
    if result.total is not None:
        bundle["total"] = result.total
    if query is not None:
        bundle["link"] = page_links(f"{base.rstrip('/')}/{request.resource_type}" if base else request.resource_type, query, request, found)
    return bundle


def history_entries(history: DataFrame, resource_type: str) -> DataFrame:
    """resourceType, id, method, url, status, etag, lastModified, content (null for a deletion), in the order of versions, latest first."""
    gone = F.col("deleted") == 1
    first = F.col("versionNumber") == 1
    return history.select(
        "versionSeq", "id", F.when(gone, "DELETE").when(first, "POST").otherwise("PUT").alias("method"), F.concat(F.lit(resource_type + "/"), F.col("id")).alias("url"),
        F.when(gone, "204").when(first, "201").otherwise("200").alias("status"), F.concat(F.lit('W/"'), F.col("versionId"), F.lit('"')).alias("etag"), F.col("lastUpdated").alias("lastModified"), F.when(~gone, F.col("content")).alias("content"),
    ).orderBy(F.col("versionSeq").desc())


def history_bundle(rows: Iterable, total: int | None = None) -> dict:
    entries = [
        {"fullUrl": r["url"], "request": {"method": r["method"], "url": r["url"]}, "response": {"status": r["status"], "etag": r["etag"], "lastModified": r["lastModified"]}} | ({"resource": json.loads(r["content"])} if r["content"] else {})
        for r in rows
    ]
    return {"resourceType": "Bundle", "type": "history", "total": len(entries) if total is None else total, "entry": entries}
