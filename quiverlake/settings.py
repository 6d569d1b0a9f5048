"""Settings of a service over the engine, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from quiverlake.plans.engine import EngineOptions


@dataclass(frozen=True)
class Tenant:
    """A key, and the collection it opens."""

    api_key: str
    collection_id: str


@dataclass(frozen=True)
class Settings:
    root: str = "quiverlake-data"
    collection_id: str = "documents"
    host: str = "parquet"
    host_url: str | None = None
    host_table: str = "documents"
    api_key: str | None = None
    tenants: tuple[Tenant, ...] = field(default=())
    rate_limit: int = 0
    auto_flush_seconds: float = 0.0
    auto_flush_rows: int = 10_000
    ivf_auto_threshold: int | None = 50_000

    def options(self) -> EngineOptions:
        return EngineOptions(flush_threshold=self.auto_flush_rows or None, ivf_auto_threshold=self.ivf_auto_threshold)

    def collection_of(self, api_key: str | None) -> str | None:
        """The collection that a key opens; None if it opens none. Without keys all open the one collection."""
        for t in self.tenants:
            if t.api_key == api_key:
                return t.collection_id
        return self.collection_id if (self.api_key is None and not self.tenants) or (self.api_key is not None and api_key == self.api_key) else None


def parse_tenants(text: str) -> tuple[Tenant, ...]:
    """``key:collection,key:collection``; blanks around parts do not matter, empty parts neither."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, colon, name = (x.strip() for x in part.partition(":"))
        if not (key and colon and name):
            raise ValueError(f"tenant {part!r} is not key:collection")
        out.append(Tenant(key, name))
    return tuple(out)


def settings(values: Mapping[str, str], prefix: str = "QUIVERLAKE_") -> Settings:
    """Settings by name, upper case behind the prefix; ``none`` or nothing turns an optional number off."""
    got = {}
    for f in fields(Settings):
        raw = values.get(prefix + f.name.upper())
        if raw is None:
            continue
        if f.name == "tenants":
            got[f.name] = parse_tenants(raw)
        elif f.name == "ivf_auto_threshold":
            got[f.name] = None if raw.strip().lower() in ("", "none", "0") else int(raw)
        else:
            kind = type(f.default)
            got[f.name] = kind(raw) if kind in (int, float) else raw
    return Settings(**got)
