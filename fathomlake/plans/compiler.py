"""From parsed parameters to predicates: a column expression, or a semi-join with another table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownParameter, UnsupportedModifier
from ..sources.frames import Catalog, ResourceFrame
from .model import ParsedParam, SearchParam
from .registry import Registry

#: Lookup table and column of each code.
LOOKUPS = {
    "name": ("HumanName", "name"), "given": ("HumanName", "given"), "family": ("HumanName", "family"), "phonetic": ("HumanName", "name"),
    "address": ("Address", "address"), "address-city": ("Address", "city"), "address-country": ("Address", "country"), "address-postalcode": ("Address", "postalCode"), "address-state": ("Address", "state"), "address-use": ("Address", "use"),
    "email": ("ContactPoint", "value"), "phone": ("ContactPoint", "value"), "telecom": ("ContactPoint", "value"), "identifier": ("Identifier", "value"),
}
TYPE_MODIFIERS = {"string": {"exact", "contains", "missing"}, "token": {"not", "text", "missing"}}

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "gt": lambda c, v: c > v,
    "le": lambda c, v: c <= v, "ge": lambda c, v: c >= v, "sa": lambda c, v: c > v, "eb": lambda c, v: c < v,
}


@dataclass(frozen=True)
class Col:
    """Rows for which a condition holds."""

    condition: Column


@dataclass(frozen=True)
class Semi:
    """Rows whose id is among those of another table."""

    ids: DataFrame
    key: str


Predicate = Col | Semi


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def text_test(c: Column, value: str, modifier: str | None) -> Column:
    if modifier == "exact":
        return c == value
    return F.lower(c).contains(value.lower()) if modifier == "contains" else F.lower(c).startswith(value.lower())


def begins(value: str):
    return lambda token: token.startswith(value)


def ends(value: str):
    return lambda token: token.endswith(value)


def leading_number(value: str) -> float | str:
    """The number that a value begins with; the value itself if it begins with none."""
    m = re.match(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", value)
    return float(m.group()) if m else value


def day_bounds(value: str) -> tuple[str, str]:
    """A day before and after, as UTC text with milliseconds."""
    t = datetime.fromisoformat(value.replace("Z", "+00:00") if "T" in value else (value + "-01-01")[:10] if len(value) == 4 else value + "-01" if len(value) == 7 else value)
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    show = lambda x: x.strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z"
    return show(t - timedelta(days=1)), show(t + timedelta(days=1))


class Compiler:
    """Compiles the parameters of one resource type. Strict: what is unknown raises; else it does not filter."""

    def __init__(self, registry: Registry, catalog: Catalog, *, strict: bool = True, lookup_wildcards: bool = False):
        self.registry, self.catalog, self.strict, self.lookup_wildcards = registry, catalog, strict, lookup_wildcards

    def predicates(self, resource_type: str, params: list[ParsedParam]) -> list[Predicate]:
        """In the order that suits execution: conditions first, semi-joins last."""
        found = [x for p in params if (x := self.predicate(resource_type, p)) is not None]
        return sorted(found, key=lambda x: isinstance(x, Semi))

    def predicate(self, resource_type: str, p: ParsedParam) -> Predicate | None:
        frame = self.catalog.frame(resource_type)
        if p.chain:
            return self.chained(frame, p)
        param = self.registry.get(resource_type, p.code)
        if param is None:
            if self.strict:
                raise UnknownParameter(f"{resource_type} has no search parameter {p.code}")
            return None
        if self.strict and p.modifier and p.modifier not in TYPE_MODIFIERS.get(param.type, {"missing"}) and not (param.strategy == "lookup-table" and p.modifier in ("exact", "contains")):
            raise UnsupportedModifier(f"{p.code}:{p.modifier}")
        if p.modifier == "missing":
            empty = F.col(param.physical).isNull()
            return Col(any_of([empty if v == "true" else ~empty for v in p.values]))
        if param.strategy == "lookup-table":
            return self.lookup(frame, param, p)
        return Col(self.condition(frame, param, p))

    def condition(self, frame: ResourceFrame, param: SearchParam, p: ParsedParam) -> Column:
        if param.strategy == "token-column":
            return self.token(param, p)
        c = F.col(param.column)
        if param.type in ("reference", "uri"):
            return F.arrays_overlap(c, F.array(*[F.lit(v) for v in p.values])) if param.array else c.isin(*p.values)
        if param.type == "string" and not param.array:
            return any_of([text_test(c, v, p.modifier) for v in p.values])
        one = lambda x: any_of([self.compare(x, param, p, v, frame.timestamps) for v in p.values])
        return F.exists(c, one) if param.array else one(c)

    def compare(self, c: Column, param: SearchParam, p: ParsedParam, value: str, timestamps: frozenset[str]) -> Column:
        if param.type == "string":
            return text_test(c, value, p.modifier)
        prefix = p.prefix or "eq"
        if param.type in ("number", "quantity"):
            v = leading_number(value)
            if prefix == "ap" and not isinstance(v, str):
                return c.between(v * 0.9, v * 1.1)
            return COMPARE.get(prefix, COMPARE["eq"])(c, F.lit(v))
        if param.type == "date":
            shown = (lambda x: F.lit(x.rstrip("Z").replace("T", " ")).cast("timestamp_ntz")) if param.column in timestamps else F.lit
            if prefix == "ap":
                low, high = day_bounds(value)
                return c.between(shown(low), shown(high))
            return COMPARE[prefix](c, shown(value))
        return COMPARE.get(prefix, COMPARE["eq"])(c, F.lit(value))

    def token(self, param: SearchParam, p: ParsedParam) -> Column:
        if p.modifier == "text":
            return any_of([F.lower(F.col(param.sort_column)).startswith(v.lower()) for v in p.values])
        c, tests = F.col(param.token_column), []
        exact = [v for v in p.values if "|" in v and not v.endswith("|")]
        if exact:
            tests.append(F.arrays_overlap(c, F.array(*[F.lit(v) for v in exact])))
        tests += [F.exists(c, begins(v) if v.endswith("|") else ends("|" + v)) for v in p.values if v not in exact and v != "|"]
        if not tests:
            return F.lit(True)
        return ~F.coalesce(any_of(tests), F.lit(False)) if p.modifier == "not" else any_of(tests)

    def lookup(self, frame: ResourceFrame, param: SearchParam, p: ParsedParam) -> Predicate:
        table, column = LOOKUPS.get(param.code, (None, None))
        rows = frame.lookups.get(table) if table else None
        if rows is None:
            return Col(any_of([text_test(F.col(param.sort_column), v, p.modifier) for v in p.values]))
        return Semi(rows.where(any_of([self.lookup_test(table, column, v, p.modifier) for v in p.values])).select("resourceId"), "resourceId")

    def lookup_test(self, table: str, column: str, value: str, modifier: str | None) -> Column:
        c = F.col(column)
        if modifier == "exact":
            return (F.col("family") == value) | (F.col("given") == value) if (table, column) == ("HumanName", "name") else c == value
        if self.lookup_wildcards:
            return F.lower(c).like(("%" if modifier == "contains" else "") + value.lower() + "%")
        return text_test(c, value, modifier)

    def chained(self, frame: ResourceFrame, p: ParsedParam) -> Predicate | None:
        target = self.catalog.find(p.chain.target_type)
        inner = self.registry.get(p.chain.target_type, p.chain.code) if target else None
        if inner is None or frame.references is None:
            if self.strict:
                raise UnknownParameter(f"{p.code}:{p.chain.target_type}.{p.chain.code}")
            return None
        found = self.predicate(p.chain.target_type, ParsedParam(p.chain.code, p.values, inner.type, p.prefix, p.modifier))
        rows = apply(target.live(), [found]).select(F.col("id").alias("targetId"))
        edges = frame.references.where((F.col("code") == p.code) & (F.col("targetType") == p.chain.target_type)).select("resourceId", "targetId")
        return Semi(edges.join(rows, "targetId", "left_semi").select("resourceId"), "resourceId")


def apply(rows: DataFrame, predicates: list[Predicate | None]) -> DataFrame:
    """rows that satisfy all predicates: one filter of the conditions, then a left semi-join for each table."""
    conditions = [x.condition for x in predicates if isinstance(x, Col)]
    if conditions:
        rows = rows.where(reduce(lambda a, b: a & b, conditions))
    for x in predicates:
        if isinstance(x, Semi):
            rows = rows.join(x.ids.withColumnRenamed(x.key, "id"), "id", "left_semi")
    return rows
