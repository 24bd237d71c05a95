"""A cache of resources and a log of searches, both on the driver and bounded."""

from __future__ import annotations

import time
from collections import OrderedDict, deque
from collections.abc import Callable


class Cache:
    """At most `size` entries, each for `ttl` seconds; "lru" and "fifo" say which goes when it is full, "ttl" that none does."""

    def __init__(self, size: int = 1000, ttl: float = 60.0, policy: str = "lru", clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.policy, self.clock = size, ttl, policy, clock
        self.entries: OrderedDict[tuple[str, str], tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, kind: str, id: str):
        found = self.entries.get((kind, id))
        if found is None or found[0] <= self.clock():
            self.entries.pop((kind, id), None)
            self.misses += 1
            return None
        self.hits += 1
        if self.policy == "lru":
            self.entries.move_to_end((kind, id))
        return found[1]

    def put(self, kind: str, id: str, value) -> None:
        self.entries.pop((kind, id), None)
        while self.policy != "ttl" and len(self.entries) >= self.size:
            self.entries.popitem(last=False)
        self.entries[(kind, id)] = (self.clock() + self.ttl, value)

    def invalidate(self, kind: str, id: str | None = None) -> None:
        for key in [k for k in self.entries if k[0] == kind and id in (None, k[1])]:
            del self.entries[key]

    def sweep(self) -> int:
        old = [k for k, (until, _) in self.entries.items() if until <= self.clock()]
        for k in old:
            del self.entries[k]
        return len(old)

    def stats(self) -> dict:
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses}


class SearchLog:
    """The last `size` searches; those of `slow_ms` or more are marked."""

    def __init__(self, size: int = 100, slow_ms: float = 1000.0, on_log: Callable[[dict], None] | None = None):
        self.rows: deque[dict] = deque(maxlen=size)
        self.slow_ms, self.on_log = slow_ms, on_log

    def add(self, resource_type: str, ms: float, results: int) -> dict:
        row = {"resourceType": resource_type, "ms": ms, "results": results, "slow": ms >= self.slow_ms}
        self.rows.append(row)
        if self.on_log:
            self.on_log(row)
        return row

    def slow(self) -> list[dict]:
        return [r for r in self.rows if r["slow"]]

    def stats(self) -> dict:
        times = [r["ms"] for r in self.rows]
        return {"count": len(times), "avg": round(sum(times) / len(times)) if times else 0, "max": max(times, default=0), "min": min(times, default=0), "slow": len(self.slow())}
