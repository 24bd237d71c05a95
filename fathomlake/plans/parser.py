"""From query-string parameters to a SearchRequest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from urllib.parse import parse_qsl

from ..errors import UnknownParameter
from .model import MAX_COUNT, PREFIX_TYPES, PREFIXES, Chain, Include, ParsedParam, SearchRequest, SortRule
from .registry import SPECIAL, Registry

#: Accepted, without effect on which rows are found.
IGNORED = frozenset({"_summary", "_elements", "_contained", "_containedType", "_format", "_pretty"})


def split_key(key: str) -> tuple[str, str | None, Chain | None]:
    """code, code:modifier or code:Type.param (a chain, if what follows the colon has a dot)."""
    code, _, rest = key.partition(":")
    if "." in rest:
        kind, _, inner = rest.partition(".")
        return code, None, Chain(kind, inner)
    return code, rest or None, None


def split_values(value: str) -> list[str]:
    """Alternatives between commas; a backslash makes a comma part of the value. Empty ones are dropped."""
    out, now, escaped = [], [], False
    for ch in value:
        if escaped:
            now.append(ch if ch == "," else "\\" + ch)
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == ",":
            out.append("".join(now))
            now = []
        else:
            now.append(ch)
    out.append("".join(now) + "\\" * escaped)
    return [v for v in out if v]


def split_prefix(values: Sequence[str], kind: str) -> tuple[str | None, tuple[str, ...]]:
    """The first prefix found holds for all values; each loses its own."""
    if kind not in PREFIX_TYPES:
        return None, tuple(values)
    found, bare = None, []
    for v in values:
        if len(v) > 2 and v[:2] in PREFIXES:
            found, v = found or v[:2], v[2:]
        bare.append(v)
    return found, tuple(bare)


def parse_include(value: str, iterate: bool = False) -> Include | None:
    if value == "*":
        return Include("*", wildcard=True, iterate=iterate)
    parts = value.split(":")
    return Include(parts[0], parts[1], parts[2] if len(parts) > 2 else None, iterate) if len(parts) >= 2 and parts[0] and parts[1] else None


def parse_sort(value: str) -> list[SortRule]:
    return [SortRule(v.lstrip("-"), v.startswith("-")) for v in (x.strip() for x in value.split(",")) if v.lstrip("-")]


def _whole(value: str) -> int | None:
    try:
        n = int(value)
    except ValueError:
        return None
    return n if n >= 0 else None


def parse_search(resource_type: str, query: Mapping[str, str | Sequence[str] | None] | str, registry: Registry | None = None) -> SearchRequest:
    """A mapping or a query string; a list of values means that each must hold. With a registry, unknown codes raise."""
    if isinstance(query, str):
        merged: dict[str, list[str]] = {}
        for k, v in parse_qsl(query, keep_blank_values=True):
            merged.setdefault(k, []).append(v)
        query = merged
    request = SearchRequest(resource_type)
    for key, given in query.items():
        for value in [given] if isinstance(given, str) or given is None else given:
            if value:
                _one(request, key, value, registry)
    return request


def _one(request: SearchRequest, key: str, value: str, registry: Registry | None) -> None:
    code, modifier, chain = split_key(key)
    if code == "_count":
        n = _whole(value)
        request.count = request.count if n is None else min(n, MAX_COUNT)
    elif code == "_offset":
        n = _whole(value)
        request.offset = request.offset if n is None else n
    elif code == "_total":
        request.total = value if value in ("none", "estimate", "accurate") else request.total
    elif code == "_sort":
        request.sort += parse_sort(value)
    elif code in ("_include", "_revinclude"):
        if found := parse_include(value, modifier == "iterate"):
            (request.include if code == "_include" else request.revinclude).append(found)
    elif code in IGNORED:
        return
    else:
        param = registry.get(request.resource_type, code) if registry else SPECIAL.get(code)
        if registry and param is None and chain is None and code not in SPECIAL:
            raise UnknownParameter(f"{request.resource_type} has no search parameter {code}")
        kind = param.type if param else "string"
        if chain and registry and (inner := registry.get(chain.target_type, chain.code.partition(":")[0])):
            kind = inner.type
        prefix, values = split_prefix(split_values(value), kind)
        if not values:
            return
        parsed = ParsedParam(code, values, kind if not chain else (param.type if param else "reference"), prefix, modifier, chain)
        if chain and ":" in chain.code:  # a modifier of the inner parameter
            inner_code, _, inner_modifier = chain.code.partition(":")
            parsed = replace(parsed, chain=Chain(chain.target_type, inner_code), modifier=inner_modifier)
        request.params.append(parsed)
