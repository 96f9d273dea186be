"""Configuration and small records on the driver: what a project declares, and the overlay of a change that isn't sealed yet."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ledgerline.operators.rules import Rule, unsupported_in


class ConfigError(ValueError):
    """A declaration that can't be used. It is never taken for an empty one."""


@dataclass(frozen=True)
class Config:
    """What reading gave: status is missing, invalid or ok."""

    status: str
    value: Any = None
    error: str | None = None
    sha256: str | None = None


def read_config(path: str) -> Config:
    """A YAML file; never raises for what is in it."""
    import yaml

    try:
        raw = Path(path).read_bytes()
    except OSError:
        return Config("missing")
    try:
        return Config("ok", yaml.safe_load(raw), sha256=hashlib.sha256(raw).hexdigest())
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        return Config("invalid", error=str(e), sha256=hashlib.sha256(raw).hexdigest())


def languages(config: Config, detected: list[str]) -> list[str]:
    """The declared languages, or those found in the files where none are declared."""
    own = config.value.get("languages") if config.status == "ok" and isinstance(config.value, dict) else None
    if own is None:
        return sorted(set(detected))
    if not isinstance(own, list) or not all(isinstance(x, str) and x for x in own):
        raise ConfigError("languages must be a list of names")
    return sorted(set(own))


def file_kind_rules(config: Config) -> list[tuple[str, str]]:
    """(glob, kind), in order."""
    own = (config.value or {}).get("file_kinds", []) if config.status == "ok" else []
    if not isinstance(own, list) or not all(isinstance(x, dict) and isinstance(x.get("pattern"), str) and x.get("kind") in ("production", "test", "generated", "auxiliary") for x in own):
        raise ConfigError("file_kinds must be a list of pattern and kind")
    return [(x["pattern"], x["kind"]) for x in own]


@dataclass(frozen=True)
class GateConfig:
    rules: list[Rule] = field(default_factory=list)
    paths: list[tuple[str, str, float]] = field(default_factory=lambda: [("**", "default", 1.0)])


def _rules(value: Any, level: str, label: str) -> list[Rule]:
    if value is None:
        return []
    if not isinstance(value, list):
        raise ConfigError(f"{label} must be a list")
    out = []
    for i, x in enumerate(value):
        if not isinstance(x, dict):
            raise ConfigError(f"{label}[{i}] must be a mapping")
        name, condition = x.get("name"), x.get("condition")
        if not all(isinstance(v, str) and v.strip() for v in (name, condition)):
            raise ConfigError(f"{label}[{i}] requires name and condition")
        if bad := unsupported_in(condition):
            raise ConfigError(f"{label}[{i}]: {', '.join(bad)} can't be gated on")
        out.append(Rule(name, condition, level))
    return out


def gate_config(config: Config) -> GateConfig:
    """The gate's rules and path classes; a missing file has defaults, an invalid one is an error."""
    if config.status == "missing":
        return GateConfig()
    if config.status == "invalid":
        raise ConfigError(config.error or "it can't be parsed")
    own = config.value or {}
    if not isinstance(own, dict):
        raise ConfigError("it must be a mapping")
    gate = own.get("gate") or {}
    paths = [(x["pattern"], x["name"], float(x.get("weight", 1.0))) for x in own.get("paths") or [{"pattern": "**", "name": "default"}]]
    return GateConfig(_rules(gate.get("block"), "block", "block") + _rules(gate.get("warn"), "warn", "warn"), paths)


def atomic_write(path: str, data: bytes) -> bool:
    """Write a file whole, or not at all; whether anything changed."""
    own = Path(path)
    if own.exists() and own.read_bytes() == data:
        return False
    own.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=own.parent)
    with os.fdopen(handle, "wb") as out:
        out.write(data)
    os.replace(temporary, own)
    return True


def write_edges(path: str, edges: list[dict[str, str]]) -> bool:
    """Implicit edges as YAML, each once and in order; what `implicit_edges` wouldn't read is an error."""
    import yaml

    keys = ("from", "to", "via", "type", "source", "confidence")
    rows = [{k: e[k] for k in keys if e.get(k) is not None} for e in edges]
    for r in rows:
        if not all(isinstance(r.get(k), str) and r[k] for k in keys[:4]) or r.get("confidence", "low") not in ("low", "confirmed") or any(p.startswith("/") or ".." in p.split("/") for p in (r["from"], r["to"])):
            raise ConfigError(f"malformed edge {r!r}")
    unique = sorted({tuple(sorted(r.items())): r for r in rows}.values(), key=lambda r: tuple(r.get(k, "") for k in keys))
    return atomic_write(path, yaml.safe_dump({"edges": unique}, sort_keys=False, allow_unicode=True).encode())


class PendingChange:
    """The one change that is under way: written if it differs, sealed into history only with the evidence that it was written with."""

    FIELDS = {"entry_id": str, "timestamp": str, "deltas": list, "evidence": list}

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.path = self.root / "pending" / "diff.json"

    def checked(self, value: Any) -> dict:
        """A record with the fields that it must have."""
        if not isinstance(value, dict) or any(not isinstance(value.get(k), t) for k, t in self.FIELDS.items()):
            raise ConfigError("a pending change needs entry_id, timestamp, deltas and evidence")
        if any(not isinstance(d, dict) or not isinstance(d.get("file"), str) or not isinstance(d.get("delta_i"), (int, float)) for d in value["deltas"]):
            raise ConfigError("a delta needs file and delta_i")
        if any(not isinstance(e, dict) or not isinstance(e.get("file"), str) or not isinstance(e.get("sha256"), str) for e in value["evidence"]):
            raise ConfigError("evidence needs file and sha256")
        return value

    def read(self) -> dict | None:
        return self.checked(json.loads(self.path.read_text())) if self.path.exists() else None

    def write(self, value: dict) -> bool:
        """Whether anything but the time has changed."""
        own, old = self.checked(value), self.read()
        if old is not None and {**old, "timestamp": ""} == {**own, "timestamp": ""}:
            return False
        return atomic_write(str(self.path), json.dumps(own, sort_keys=True).encode())

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)

    @staticmethod
    def signature(evidence: list[dict]) -> str:
        return "|".join(sorted({f"{e['file']}:{e['sha256']}" for e in evidence}))

    def seal(self, staged: list[dict]) -> str:
        """Move the change to history: missing, mismatch (other evidence) or finalized. A change that is there already is kept as it is."""
        own = self.read()
        if own is None:
            return "missing"
        if self.signature(own["evidence"]) != self.signature(staged):
            return "mismatch"
        target = self.root / "history" / f"{own['entry_id']}.json"
        if not target.exists():
            atomic_write(str(target), json.dumps(own, sort_keys=True).encode())
        self.clear()
        return "finalized"
