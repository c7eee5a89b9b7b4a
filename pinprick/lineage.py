"""Metadata of datasets: an immutable record that operations extend."""

from __future__ import annotations

import json
import tomllib
import uuid
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime, timezone


@dataclass(frozen=True)
class Metadata:
    identifier: str = field(default_factory=lambda: uuid.uuid4().hex)
    comment: str = ""
    source: str = "unknown"
    state: str = "raw"
    file_path: str = ""
    file_type: str = ""
    creation_time: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    history: tuple[tuple[str, str], ...] = ()
    ancestor_identifiers: tuple[str, ...] = ()
    units: dict[str, str] = field(default_factory=dict)
    extra: dict[str, str] = field(default_factory=dict)

    def after(self, name: str, **parameters) -> "Metadata":
        """The record of what the operation makes of this dataset."""
        return replace(self, identifier=uuid.uuid4().hex, state="modified", history=(*self.history, (name, json.dumps(parameters, default=str))), ancestor_identifiers=(*self.ancestor_identifiers, self.identifier))

    @staticmethod
    def from_dict(values: dict) -> "Metadata":
        """Known fields; everything else goes to ``extra``."""
        known = {f.name for f in fields(Metadata)}
        own = {k: v for k, v in values.items() if k in known}
        own["history"] = tuple(tuple(h) for h in own.get("history", ()))
        own["ancestor_identifiers"] = tuple(own.get("ancestor_identifiers", ()))
        return Metadata(**own | {"extra": {**own.get("extra", {}), **{k: str(v) for k, v in values.items() if k not in known}}})

    @staticmethod
    def from_toml(text: str) -> "Metadata":
        return Metadata.from_dict(tomllib.loads(text))

    def merged(self, other: "Metadata | dict | str | None") -> "Metadata":
        """This record with the other's values (a record, a dict or TOML text) over it."""
        if other is None:
            return self
        values = tomllib.loads(other) if isinstance(other, str) else asdict(other) if isinstance(other, Metadata) else other
        return Metadata.from_dict(asdict(self) | values)

    def scheme(self) -> dict[str, str]:
        return {f.name: str(f.type) for f in fields(self)}

    def __str__(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in asdict(self).items() if v not in ("", (), {}))
