"""The extension contract. A lens is one viewpoint on the business: it turns
staged tables into KPI frames and KPI frames into decision items.

A lens builds lazy DataFrames for all as-of dates at once. Nothing in this
module touches data; Spark plans all lenses of a run together.
"""

from __future__ import annotations

import importlib
import os
import tomllib
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.decisions import Localizer
from ..operators.periods import Anchors

Tables = Mapping[str, DataFrame]
Sections = dict[str, DataFrame]


@dataclass(frozen=True)
class Param:
    """A tunable value. ``runtime`` ones change detection only, so stored KPIs
    can be judged again; the others change what is computed."""

    key: str
    default: float
    min: float
    max: float
    step: float
    runtime: bool = True


@dataclass(frozen=True)
class DataSource:
    """An extra table: its declared columns and how to read it."""

    name: str
    schema: T.StructType
    read: Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Lens:
    id: str
    title: Mapping[str, str]
    compute: Callable[[Tables, Anchors, Mapping[str, float]], Sections]
    detect: Callable[[Sections, Mapping[str, Column], Sequence[str]], DataFrame]
    params: tuple[Param, ...] = ()
    data_sources: tuple[DataSource, ...] = ()
    # Sections that are read more than once: by the rules and by reports.
    shared: tuple[str, ...] = ()
    localizers: Mapping[str, Localizer] = field(default_factory=dict)
    # KPI history as ``as_of, series, value`` and the series of an item.
    trend: Callable[[Sections], DataFrame] | None = None
    series: Callable[[Column], Column] | None = None
    headline_metrics: Callable[[Sections, str], DataFrame] | None = None
    strings: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def defaults(self) -> dict[str, float]:
        return {p.key: p.default for p in self.params}

    def runtime_keys(self) -> list[str]:
        return [p.key for p in self.params if p.runtime]


BUILTIN = ("sales", "marketing", "customer", "inventory")

_registered: dict[str, Lens] = {}


def register(lens: Lens) -> Lens:
    _registered[lens.id] = lens
    return lens


def unregister(lens_id: str) -> None:
    _registered.pop(lens_id, None)


def load_lens(name: str) -> Lens:
    """A bare name is a built-in lens, or the one registered in its place; a
    dotted one is a module with ``LENS``."""
    if "." in name:
        found = getattr(importlib.import_module(name), "LENS", None)
        if not isinstance(found, Lens):
            raise ValueError(f"module '{name}' has no LENS = Lens(...)")
        return register(found)
    from .builtin import LENSES

    if name in _registered:
        return _registered[name]  # a lens the caller registered stays
    if name not in LENSES:
        raise ValueError(f"unknown lens '{name}'; built in are {sorted(LENSES)}")
    return register(LENSES[name])


def load_lenses(names: Iterable[str] = BUILTIN) -> list[Lens]:
    return [load_lens(name) for name in names]


def known_lenses() -> list[Lens]:
    """Built-in lenses first, then those registered by the caller."""
    return list({lens.id: lens for lens in [*load_lenses(), *_registered.values()]}.values())


def localizers() -> dict[str, Localizer]:
    merged: dict[str, Localizer] = {}
    for lens in known_lenses():
        for issue_type, localizer in lens.localizers.items():
            merged.setdefault(issue_type, localizer)
    return merged


def issue_owners() -> dict[str, str]:
    """Issue type to lens id, for items that carry no lens."""
    owners: dict[str, str] = {}
    for lens in known_lenses():
        for issue_type in lens.localizers:
            owners.setdefault(issue_type, lens.id)
    return owners


def label(key: str, lang: str) -> str:
    """A text contributed by a lens; the key itself where there is none."""
    for lens in _registered.values():
        if key in lens.strings:
            return lens.strings[key].get(lang, key)
    return key


def resolve_params(lens: Lens, overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    """Defaults with `overrides` on top; an unknown key is an error."""
    known = lens.defaults()
    unknown = sorted(set(overrides or {}) - set(known))
    if unknown:
        raise ValueError(f"unknown parameters {unknown} for lens '{lens.id}'; known are {sorted(known)}")
    return {**known, **(overrides or {})}


@dataclass(frozen=True)
class Settings:
    enabled: tuple[str, ...] = BUILTIN
    params: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


CONFIG_VARIABLE = "TRADEWIND_CONFIG"
DEFAULT_CONFIG = Path("config/tradewind.toml")


def load_settings(path: Path | None = None) -> Settings:
    """Enabled lenses and parameter overrides; a missing file means defaults."""
    source = path or Path(os.environ.get(CONFIG_VARIABLE, DEFAULT_CONFIG))
    if not source.exists():
        return Settings()
    content = tomllib.loads(source.read_text(encoding="utf-8"))
    return Settings(
        enabled=tuple(content.get("lenses", {}).get("enabled", BUILTIN)),
        params=content.get("params", {}),
    )


def read_sources(spark: SparkSession, path: str, lenses: Iterable[Lens]) -> dict[str, DataFrame]:
    """The extra tables of `lenses`, in their declared columns."""
    from ..sources.storage import declared_columns

    tables: dict[str, DataFrame] = {}
    for lens in lenses:
        for source in lens.data_sources:
            if source.name in tables:
                raise ValueError(f"table '{source.name}' is declared twice")
            tables[source.name] = declared_columns(source.read(spark, path), source.schema)
    return tables
