"""Configuration as validated dataclasses, read from and written to YAML."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import asdict, dataclass, field, is_dataclass, replace
from types import UnionType
from typing import Union, get_args, get_origin, get_type_hints

import yaml

_NAME = re.compile(r"\w{1,64}")


def _between(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")


@dataclass(frozen=True)
class LogPattern:
    name: str
    regex: str
    event_type: str = "unknown"
    priority: int = 100

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"pattern name {self.name!r} must be 1 to 64 word characters")
        _between("priority", self.priority, 1, 999)
        try:
            compiled = re.compile(self.regex)
        except re.error as e:
            raise ValueError(f"pattern {self.name}: {e}") from e
        if "timestamp" not in compiled.groupindex:
            raise ValueError(f"pattern {self.name}: a group named timestamp is required")


@dataclass(frozen=True)
class FilterRule:
    regex: str
    include: bool
    priority: int = 100


@dataclass(frozen=True)
class Transform:
    """``kind``: extract (fields), replace (replacement), strip, collapse (max_length, annotation) or compact_hex (none)."""

    kind: str
    regex: str
    priority: int = 100
    fields: tuple[str, ...] = ()
    replacement: str = ""
    max_length: int | None = None
    annotation: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("extract", "replace", "strip", "collapse", "compact_hex"):
            raise ValueError(f"unknown transform {self.kind}")
        re.compile(self.regex)


@dataclass(frozen=True)
class GroupRule:
    name: str
    start: str
    continuation: tuple[str, ...] = ()
    time_window_ms: int | None = None


@dataclass(frozen=True)
class LogSettings:
    """Bounds of the log pipeline; a source may have its own rules beside them."""

    time_window_ms: int = 500
    max_group_lines: int = 100
    max_continuation_lines: int = 500
    dedup_threshold: int = 3
    line_filters: tuple[FilterRule, ...] = ()
    event_filters: tuple[FilterRule, ...] = ()
    transforms: tuple[Transform, ...] = ()
    group_rules: tuple[GroupRule, ...] = ()
    severity_map: tuple[tuple[str, str], ...] = ()
    keep_unmatched: bool = True
    fallback_detect: str = ""
    fallback_filters: tuple[FilterRule, ...] = ()

    def __post_init__(self) -> None:
        _between("time_window_ms", self.time_window_ms, 10, 300_000)
        _between("max_group_lines", self.max_group_lines, 10, 10_000)
        _between("max_continuation_lines", self.max_continuation_lines, 10, 10_000)
        _between("dedup_threshold", self.dedup_threshold, 2, 1000)


@dataclass(frozen=True)
class Source:
    pattern: str
    type: str = "documentation"
    description: str = ""
    log_patterns: tuple[LogPattern, ...] = ()
    log_settings: LogSettings | None = None

    def __post_init__(self) -> None:
        if len(self.log_patterns) > 50:
            raise ValueError("at most 50 log patterns for a source")
        names = [p.name for p in self.log_patterns]
        if len(set(names)) != len(names):
            raise ValueError("log pattern names must differ")


@dataclass(frozen=True)
class Project:
    name: str
    base_path: str
    description: str = ""
    sources: tuple[Source, ...] = ()
    removed: bool = False


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing"
    dims: int = 64
    instruction: str = ""
    batch: int = 256


@dataclass(frozen=True)
class Rerank:
    enabled: bool = False
    model: str = "words"
    overfetch_factor: int = 4

    def __post_init__(self) -> None:
        _between("overfetch_factor", self.overfetch_factor, 1, 100)


@dataclass(frozen=True)
class Storage:
    path: str = "./index"
    prefix: str = "project"


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedding: Embedding = field(default_factory=Embedding)
    reranker: Rerank = field(default_factory=Rerank)
    storage: Storage = field(default_factory=Storage)
    discovery_ignore: tuple[str, ...] = ("arch",)
    projects: tuple[Project, ...] = ()
    log_settings: LogSettings = field(default_factory=LogSettings)
    excluded_dirs: tuple[str, ...] = ("node_modules", "venv", ".venv", "bin", "obj", "build", "dist", "__pycache__", ".vs", ".git")

    def active(self) -> list[Project]:
        return [p for p in self.projects if not p.removed]


def validate_path(path: str) -> str:
    """A relative path inside a project; raises ValueError otherwise."""
    if not path or not path.strip():
        raise ValueError("a path is required")
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path) or ".." in re.split(r"[\\/]", path):
        raise ValueError(f"path {path!r} must stay inside the project")
    return path


def clamp_k(k: int, most: int = 20) -> int:
    return max(1, min(most, k))


def validate_severity(severity: str) -> str:
    """One of the levels, whatever its case; raises ValueError otherwise."""
    if severity.lower() not in ("debug", "info", "warning", "error", "critical"):
        raise ValueError(f"unknown severity {severity}")
    return severity.lower()


def validate_query(query: str, most: int = 1000) -> str:
    if not query or not query.strip():
        raise ValueError("a query is required")
    if len(query) > most:
        raise ValueError(f"a query has at most {most} characters")
    return query.strip()


def _built(kind, raw):
    """A value of a type hint from plain lists and mappings; unknown keys are an error, missing ones take defaults."""
    origin, inside = get_origin(kind), get_args(kind)
    if origin in (Union, UnionType):
        return None if raw is None else _built(next(a for a in inside if a is not type(None)), raw)
    if origin is tuple:
        parts = [inside[0]] * len(raw or ()) if inside[-1] is Ellipsis else inside
        return tuple(_built(k, x) for k, x in zip(parts, raw or ()))
    if is_dataclass(kind):
        hints = get_type_hints(kind)
        if more := set(raw) - set(hints):
            raise ValueError(f"unknown settings {sorted(more)} of {kind.__name__}")
        return kind(**{k: _built(hints[k], v) for k, v in raw.items()})
    return raw


def _resolved(path: str) -> str:
    return os.path.expanduser(os.path.expandvars(path))


def load(path: str) -> Config:
    """A configuration from YAML; variables and ``~`` in paths are resolved."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    chunks = raw.pop("chunking", {})
    raw |= {f"chunk_{k}": v for k, v in chunks.items()}
    made = _built(Config, raw)
    projects = tuple(replace(p, base_path=_resolved(p.base_path)) for p in made.projects)
    return replace(made, projects=projects, storage=replace(made.storage, path=_resolved(made.storage.path)))


def save(config: Config, path: str) -> None:
    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

    whole = plain(asdict(config))
    out = {"chunking": {"size": whole.pop("chunk_size"), "overlap": whole.pop("chunk_overlap")}, **whole}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(out, f, sort_keys=False, allow_unicode=True)


def locate(environ: dict[str, str], template: str | None = None) -> str:
    """The configuration file in force, made where there is none: named by TIDEMARK_CONFIG, or in the user's
    configuration folder, from a template or with defaults."""
    if named := environ.get("TIDEMARK_CONFIG"):
        return _resolved(named)
    home = environ.get("XDG_CONFIG_HOME") or os.path.join(environ.get("HOME", "~"), ".config")
    path = os.path.join(_resolved(home), "tidemark", "config.yaml")
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if template and os.path.exists(template):
            shutil.copyfile(template, path)
        else:
            save(Config(), path)
    return path
