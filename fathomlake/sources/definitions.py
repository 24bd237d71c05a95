"""Definitions as plain resources (JSON objects): structures, value sets, code systems, search parameters."""

from __future__ import annotations

from collections.abc import Iterable

from ..plans.registry import Registry


class Definitions:
    """Reads definitions by url, and makes the registry of their search parameters. A bundle counts as its entries; of one url the last counts."""

    def __init__(self, resources: Iterable[dict] = ()):
        self._by_url: dict[tuple[str, str], dict] = {}
        self._parameters: dict[tuple[str, str], dict] = {}
        for r in resources:
            self.add(r)

    def add(self, resource: dict) -> None:
        kind = resource.get("resourceType")
        if kind == "Bundle":
            for entry in resource.get("entry") or []:
                if isinstance(entry.get("resource"), dict):
                    self.add(entry["resource"])
        elif kind == "SearchParameter":
            for base in resource.get("base") or []:
                self._parameters[base, resource["code"]] = resource
        elif resource.get("url"):
            self._by_url[kind, resource["url"]] = resource

    def structure(self, url: str) -> dict | None:
        return self._by_url.get(("StructureDefinition", url))

    def value_set(self, url: str) -> dict | None:
        return self._by_url.get(("ValueSet", url))

    def code_system(self, url: str) -> dict | None:
        return self._by_url.get(("CodeSystem", url))

    def parameters(self, resource_type: str) -> list[dict]:
        return [p for (base, _), p in self._parameters.items() if base == resource_type]

    def resource_types(self) -> list[str]:
        """Types with tables: those of concrete resource structures, and the bases of parameters."""
        structures = [d for (kind, _), d in self._by_url.items() if kind == "StructureDefinition"]
        abstract = {d.get("type") for d in structures if d.get("abstract")} | {"Resource", "DomainResource"}
        return sorted({d["type"] for d in structures if d.get("kind") == "resource" and d.get("type")} - abstract | {base for base, _ in self._parameters} - abstract)

    def repeating(self) -> set[str]:
        """Paths of elements that may occur more than once."""
        structures = [d for (kind, _), d in self._by_url.items() if kind == "StructureDefinition"]
        return {e["path"] for d in structures for e in (d.get("snapshot") or {}).get("element") or [] if e.get("path") and str(e.get("max", "1")) not in ("0", "1")}

    def registry(self) -> Registry:
        out = Registry(self.repeating())
        for base in self.resource_types():
            out.declare(base)
            for p in self.parameters(base):
                out.define(p["code"], p["type"], [base], p.get("expression") or "", p.get("target") or [])
        return out
