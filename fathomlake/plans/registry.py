"""Search parameters by resource type: how each is stored, and whether it repeats."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .model import SearchParam

#: Codes that live in lookup tables if their expression leads there, and what leads there.
LOOKUP_CODES = frozenset("name given family phonetic address address-city address-country address-postalcode address-state address-use email phone telecom".split())
LOOKUP_PATHS = (".name", ".given", ".family", ".address", ".telecom")
#: Codes that have fixed columns, and kinds that have none.
FIXED_CODES = frozenset("_id _lastUpdated _profile _compartment _source _version".split())
UNSTORED_TYPES = frozenset({"composite", "special"})
COLUMN_TYPES = {"date": "string", "number": "double", "quantity": "double"}

#: Parameters of every type, on fixed columns.
SPECIAL = {
    "_id": SearchParam("_id", "uri", "column", "id"),
    "_lastUpdated": SearchParam("_lastUpdated", "date", "column", "lastUpdated"),
    "_source": SearchParam("_source", "uri", "column", "_source"),
    "_profile": SearchParam("_profile", "uri", "column", "_profile", array=True),
    "_tag": SearchParam("_tag", "token", "token-column", "_tag", array=True),
    "_security": SearchParam("_security", "token", "token-column", "_security", array=True),
}


def camel(code: str) -> str:
    """birth-date -> birthDate"""
    return re.sub(r"-([a-z])", lambda m: m.group(1).upper(), code)


def without_calls(path: str, names: Iterable[str] = ("where", "as", "ofType", "resolve")) -> str:
    """The path without .name(...) for the names given; brackets may nest."""
    for name in names:
        while (at := path.find(f".{name}(")) >= 0:
            depth, end = 0, len(path)
            for i in range(at + len(name) + 1, len(path)):
                depth += (path[i] == "(") - (path[i] == ")")
                if depth == 0:
                    end = i + 1
                    break
            path = path[:at] + path[end:]
    return path


def fragments(expression: str, resource_type: str) -> list[str]:
    """The alternatives of an expression that belong to a type, as plain dotted paths."""
    out = []
    for part in expression.split("|"):
        path = re.sub(r"\s+as\s+\w+", "", without_calls(part.strip().lstrip("(").strip())).rstrip(") ").strip()
        if path.split(".")[0].split("[")[0] == resource_type:
            out.append(path)
    return out


def is_array(expression: str, resource_type: str, repeating: frozenset[str]) -> bool:
    """Whether any element on the way repeats; an index into it undoes that."""
    for path in fragments(expression, resource_type):
        if "[0]" in path:
            continue
        steps = path.split(".")
        if any(".".join(steps[: k + 1]) in repeating for k in range(1, len(steps))):
            return True
    return False


def strategy_of(code: str, kind: str, expression: str) -> str:
    if code in LOOKUP_CODES and any(p in expression.lower() for p in LOOKUP_PATHS):
        return "lookup-table"
    return "token-column" if kind == "token" else "column"


class Registry:
    """Parameters by type and code. `repeating` holds the element paths that may occur more than once."""

    def __init__(self, repeating: Iterable[str] = ()):
        self.repeating = frozenset(repeating)
        self._params: dict[str, dict[str, SearchParam]] = {}

    def define(self, code: str, type: str, base: Iterable[str], expression: str = "", target: Iterable[str] = ()) -> None:
        """Binds a definition for each base type; kinds and codes without a column of their own are passed over."""
        if type in UNSTORED_TYPES or code in FIXED_CODES:
            return
        for t in base:
            if t in ("Resource", "DomainResource"):
                continue
            strategy = strategy_of(code, type, expression)
            array = type == "token" or is_array(expression, t, self.repeating)
            self.bind(t, SearchParam(code, type, strategy, camel(code), array, expression, COLUMN_TYPES.get(type, "string"), tuple(target)))

    def bind(self, resource_type: str, param: SearchParam) -> None:
        self._params.setdefault(resource_type, {})[param.code] = param

    def declare(self, resource_type: str) -> None:
        """A type that has tables, be it without parameters."""
        self._params.setdefault(resource_type, {})

    def get(self, resource_type: str, code: str) -> SearchParam | None:
        return SPECIAL.get(code) or self._params.get(resource_type, {}).get(code)

    def params(self, resource_type: str) -> list[SearchParam]:
        return list(self._params.get(resource_type, {}).values())

    def types(self) -> list[str]:
        return sorted(self._params)
