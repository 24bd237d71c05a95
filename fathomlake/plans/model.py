"""The request model: what a search asks, before it is bound to tables."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values of the query language.
PREFIXES = ("eq", "ne", "lt", "gt", "le", "ge", "sa", "eb", "ap")
PREFIX_TYPES = frozenset({"number", "date", "quantity"})
MODIFIERS = frozenset({"exact", "contains", "missing", "not", "text", "above", "below", "in", "not-in", "of-type"})
DEFAULT_COUNT, MAX_COUNT = 20, 1000


@dataclass(frozen=True)
class SearchParam:
    """A search parameter bound to its storage: `column` holds its values, or their tokens, or their sort text."""

    code: str
    type: str
    strategy: str  # "column", "token-column" or "lookup-table"
    column: str
    array: bool = False
    expression: str = ""
    column_type: str = "string"
    targets: tuple[str, ...] = ()

    @property
    def token_column(self) -> str:
        return f"__{self.column}"

    @property
    def sort_column(self) -> str:
        return f"__{self.column}Sort"

    @property
    def physical(self) -> str:
        return {"column": self.column, "token-column": self.token_column}.get(self.strategy, self.sort_column)

    @property
    def order_column(self) -> str:
        return self.column if self.strategy == "column" else self.sort_column


@dataclass(frozen=True)
class Chain:
    target_type: str
    code: str


@dataclass(frozen=True)
class ParsedParam:
    code: str
    values: tuple[str, ...]
    type: str = "string"
    prefix: str | None = None
    modifier: str | None = None
    chain: Chain | None = None


@dataclass(frozen=True)
class SortRule:
    code: str
    descending: bool = False


@dataclass(frozen=True)
class Include:
    source: str
    code: str | None = None
    target: str | None = None
    iterate: bool = False
    wildcard: bool = False


@dataclass
class SearchRequest:
    resource_type: str
    params: list[ParsedParam] = field(default_factory=list)
    count: int | None = None
    offset: int | None = None
    sort: list[SortRule] = field(default_factory=list)
    total: str | None = None
    include: list[Include] = field(default_factory=list)
    revinclude: list[Include] = field(default_factory=list)
    compartment: str | None = None
    project: str | None = None

    @property
    def page_size(self) -> int:
        return DEFAULT_COUNT if self.count is None else min(self.count, MAX_COUNT)
