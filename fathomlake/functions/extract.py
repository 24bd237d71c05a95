"""From a JSON resource to its search columns, reference edges and lookup rows.

Resources have no schema in common, so each is read once, by an Arrow function over batches of contents; what it returns has a
fixed schema for a resource type. Expressions over columns (`token_strings`, `reference_edges`, `token_hash`) serve typed tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import SearchParam
from ..plans.registry import Registry, fragments

UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


def path_of(expression: str, resource_type: str) -> list[str] | None:
    """Steps below the resource, of the first alternative that begins with its type; calls on the way are left out."""
    found = fragments(expression, resource_type)
    return [step.partition("[")[0] for step in found[0].split(".")[1:] if step] if found else None


def values_at(node: Any, path: list[str]) -> list[Any]:
    """All values at a path; arrays are flattened at every step."""
    found = [node]
    for step in [*path, None]:
        flat: list[Any] = []
        while found:
            x = found.pop(0)
            if isinstance(x, list):
                found = x + found
            elif x is not None:
                flat.append(x)
        if step is None:
            return flat
        found = [x[step] for x in flat if isinstance(x, dict) and x.get(step) is not None]
    return found


def tokens_of(value: Any) -> list[tuple[str | None, str, str | None]]:
    """(system, code, display) of a boolean, string, coding, concept or identifier."""
    if isinstance(value, bool):
        return [(None, "true" if value else "false", None)]
    if isinstance(value, str):
        return [(None, value, None)]
    if not isinstance(value, dict):
        return []
    if isinstance(value.get("coding"), list):
        found = [(c.get("system"), c["code"], c.get("display") or value.get("text")) for c in value["coding"] if isinstance(c, dict) and c.get("code")]
        return found or ([(None, value["text"], value["text"])] if value.get("text") else [])
    if value.get("code") and isinstance(value["code"], str):
        return [(value.get("system"), value["code"], value.get("display"))]
    if isinstance(value.get("value"), str):
        return [(value.get("system"), value["value"], None)]
    return [(None, value["text"], value["text"])] if value.get("text") else []


def token_texts(tokens) -> list[str]:
    """system|code and |code of a token with a system, |code of one without."""
    return [s for system, code, _ in tokens for s in ([f"{system}|{code}"] if system else []) + [f"|{code}"]]


def token_sort(tokens) -> str | None:
    for system, code, display in tokens[:1]:
        return display or (f"{system}|{code}" if system else code)
    return None


def _joined(*parts: Any) -> str:
    return " ".join(s for p in parts for s in (p if isinstance(p, list) else [p]) if isinstance(s, str) and s)


def sort_text(value: Any) -> str | None:
    """A string, a person's name (family first), an address or a contact's value as text."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        if "family" in value or "given" in value:
            return _joined(value.get("family"), value.get("given")) or value.get("text")
        if any(k in value for k in ("line", "city", "state", "postalCode", "country")):
            return _joined(value.get("line"), value.get("city"), value.get("state"), value.get("postalCode"), value.get("country"))
        return value.get("value") or value.get("text")
    return None


def reference_of(value: Any) -> str | None:
    found = value.get("reference") if isinstance(value, dict) else value
    return found if isinstance(found, str) else None


def edge_of(reference: str | None) -> tuple[str, str] | None:
    """Type and id, the last two parts of a reference; not of a contained or urn one."""
    if not reference or reference[0] == "#" or reference.startswith("urn:"):
        return None
    parts = reference.split("/")
    return (parts[-2], parts[-1]) if len(parts) >= 2 and parts[-2][:1].isupper() and parts[-1] else None


def lookup_rows(code: str, value: Any) -> tuple[str, dict[str, str | None]] | None:
    """The lookup table of a complex value, and its row."""
    if not isinstance(value, dict):
        return None
    if code in ("name", "given", "family", "phonetic"):
        given = _joined(value.get("given"))
        return "HumanName", {"name": _joined(value.get("family"), value.get("given"), value.get("text"), value.get("prefix"), value.get("suffix")), "given": given or None, "family": value.get("family")}
    if code.startswith("address"):
        return "Address", {"address": _joined(value.get("text"), value.get("line"), value.get("city"), value.get("state"), value.get("postalCode"), value.get("country")), **{k: value.get(k) for k in ("city", "country", "postalCode", "state", "use")}}
    if code in ("email", "phone", "telecom"):
        return "ContactPoint", {k: value.get(k) for k in ("system", "value", "use")}
    return ("Identifier", {k: value.get(k) for k in ("system", "value")}) if code == "identifier" else None


LOOKUP_SCHEMAS = {"HumanName": ("name", "given", "family"), "Address": ("address", "city", "country", "postalCode", "state", "use"), "ContactPoint": ("system", "value", "use"), "Identifier": ("system", "value")}


def column_values(resource: dict, param: SearchParam, resource_type: str, extract: Callable[[dict, SearchParam], list[Any]] | None = None) -> dict[str, Any]:
    """The search columns of one parameter."""
    path = path_of(param.expression, resource_type)
    found = extract(resource, param) if extract else values_at(resource, path) if path else []
    if param.strategy == "token-column":
        tokens = [t for v in found for t in tokens_of(v)]
        return {param.token_column: token_texts(tokens) or None, param.sort_column: token_sort(tokens)}
    if param.strategy == "lookup-table":
        return {param.sort_column: next((s for v in found if (s := sort_text(v))), None)}
    if param.type == "reference":
        plain = [r for v in found if (r := reference_of(v))]
    elif param.column_type == "double":
        plain = [float(v) for v in found if isinstance(v, int | float) and not isinstance(v, bool)]
    else:
        plain = [v if isinstance(v, str) else json.dumps(v) for v in found if isinstance(v, str | int | float | bool)]
    return {param.column: (plain or None) if param.array else (plain[0] if plain else None)}


def column_fields(param: SearchParam) -> list[T.StructField]:
    text, many = T.StringType(), T.ArrayType(T.StringType())
    if param.strategy == "token-column":
        return [T.StructField(param.token_column, many), T.StructField(param.sort_column, text)]
    if param.strategy == "lookup-table":
        return [T.StructField(param.sort_column, text)]
    one = T.DoubleType() if param.column_type == "double" else text
    return [T.StructField(param.column, T.ArrayType(one) if param.array else one)]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EDGES = T.ArrayType(_strings("targetType", "targetId", "code", "referenceRaw"))
LOOKUP = T.ArrayType(T.StructType([T.StructField("table", T.StringType()), T.StructField("row", T.MapType(T.StringType(), T.StringType()))]))


def index_schema(resource_type: str, registry: Registry) -> T.StructType:
    meta = [T.StructField(n, T.ArrayType(T.StringType())) for n in ("_profile", "___tag", "___security", "compartments")] + [T.StructField(n, T.StringType()) for n in ("_source", "___tagSort", "___securitySort")]
    columns = [f for p in registry.params(resource_type) for f in column_fields(p)]
    return T.StructType([*meta, *columns, T.StructField("__edges", EDGES), T.StructField("__lookups", LOOKUP)])


def index_resource(resource: dict, resource_type: str, registry: Registry, extract=None) -> dict[str, Any]:
    """All that is derived from a resource. extract(resource, parameter) -> values takes the place of the paths, for columns, edges and lookup rows."""
    meta = resource.get("meta") if isinstance(resource.get("meta"), dict) else {}
    out: dict[str, Any] = {"_profile": meta.get("profile") or None, "_source": meta.get("source")}
    for name, column in (("tag", "___tag"), ("security", "___security")):
        tokens = [t for v in meta.get(name) or [] for t in tokens_of(v)]
        out |= {column: token_texts(tokens) or None, column + "Sort": token_sort(tokens)}
    edges, lookups, patients = [], [], [resource["id"]] if resource_type == "Patient" and resource.get("id") else []
    for p in registry.params(resource_type):
        out |= column_values(resource, p, resource_type, extract)
        path = path_of(p.expression, resource_type)
        values = extract(resource, p) if extract else values_at(resource, path) if path else []
        if p.type == "reference":
            for raw in filter(None, map(reference_of, values)):
                if edge := edge_of(raw):
                    edges.append({"targetType": edge[0], "targetId": edge[1], "code": p.code, "referenceRaw": raw})
                    if edge[0] == "Patient" and resource_type != "Patient" and UUID.match(edge[1]) and edge[1] not in patients:
                        patients.append(edge[1])
        if p.strategy == "lookup-table" or p.code == "identifier":
            if path and not extract and not all(isinstance(v, dict) for v in values):  # a part of the complex value: its row is that of the whole
                values = values_at(resource, path[:-1])
            lookups += [{"table": found[0], "row": found[1]} for v in values if (found := lookup_rows(p.code, v))]
    return out | {"compartments": patients or None, "__edges": edges, "__lookups": lookups}


def index_contents(rows: DataFrame, resource_type: str, registry: Registry, extract=None) -> DataFrame:
    """rows (with a content column) and their search columns, __edges and __lookups. Contents that are no JSON object index to nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    derived = index_schema(resource_type, registry)
    kept = [f for f in rows.schema if f.name not in derived.names]
    schema = T.StructType([*kept, *derived])
    arrow = to_arrow_schema(derived)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b.column("content").to_pylist():
                try:
                    resource = json.loads(text or "")
                except ValueError:
                    resource = None
                found.append(index_resource(resource, resource_type, registry, extract) if isinstance(resource, dict) else {})
            columns = [pa.array([[{"table": d["table"], "row": list(d["row"].items())} for d in x.get("__lookups", [])] for x in found], arrow.field("__lookups").type) if f.name == "__lookups" else pa.array([x.get(f.name) for x in found], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *derived.names])

    return rows.select(*[f.name for f in kept]).mapInArrow(run, schema)


def edges_from(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.col("id").alias("resourceId"), F.explode("__edges").alias("e")).select("resourceId", "e.*")


def lookups_from(indexed: DataFrame, table: str, resource_type: str) -> DataFrame:
    rows = indexed.select(F.col("id").alias("resourceId"), F.explode("__lookups").alias("l")).where(F.col("l.table") == table)
    return rows.select("resourceId", F.lit(resource_type).alias("resourceType"), *[F.col("l.row")[c].alias(c) for c in LOOKUP_SCHEMAS[table]]).distinct()


def token_strings(system: Column | None, code: Column) -> Column:
    """The tokens of a typed column: system|code and |code, or |code alone."""
    bare = F.concat(F.lit("|"), code)
    return F.array(bare) if system is None else F.array(F.concat(system, F.lit("|"), code), bare)


def reference_edges(reference: Column) -> Column:
    """struct(targetType, targetId) of a reference column; null for contained, urn and malformed ones."""
    parts = F.split(reference, "/")
    kind, id_ = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.when(~reference.startswith("#") & ~reference.startswith("urn:") & kind.rlike("^[A-Z]") & (id_ != ""), F.struct(kind.alias("targetType"), id_.alias("targetId")))


def token_hash(system: Column, code: Column) -> Column:
    """SHA-256 of system|code, its first 32 digits written as a UUID."""
    h = F.sha2(F.concat_ws("|", system, code), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def shared_tokens(*tokens: Column) -> Column:
    """The tokens of several array columns as one array; null if there are none."""
    found = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in tokens])
    return F.when(F.size(found) > 0, found)


def name_sort(family: Column, given: Column) -> Column:
    return F.concat_ws(" ", family, given)


def wildcard_references(content: Column) -> Column:
    """Every reference at any depth of a JSON text."""
    return F.regexp_extract_all(content, F.lit(r'"reference"\s*:\s*"([^"]+)"'), F.lit(1))
