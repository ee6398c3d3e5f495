"""Point-in-time features: named column builders with dependencies, a matrix over a dense panel, and its use at events.

A feature says when its value of a session is known; a matrix for an entry time moves each feature by that rule, so that
row (symbol, date) holds only what a decision at that time may use.  Building is one pass over one sort: features of one
stage share a select, and a stage's windows share their partitioning with the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w

#: When a value of a session is known, and when a decision is taken.
KNOWN, ENTRY = ("today_open", "today_close", "next_open"), ("open", "close")


@dataclass(frozen=True)
class Feature:
    """``build`` maps nothing to a column over the panel's columns and those of ``needs``."""

    name: str
    build: Callable[[], Column] = field(compare=False)
    known: str = "today_close"
    lookback: int = 1
    needs: tuple[str, ...] = ()
    version: str = "1"

    def __post_init__(self):
        if self.known not in KNOWN:
            raise ValueError(f"{self.name}: known at {self.known!r}, not one of {KNOWN}")


class Registry:
    def __init__(self, features: Iterable[Feature] = ()):
        self._held: dict[str, Feature] = {}
        for f in features:
            self.register(f)

    def register(self, feature: Feature) -> Feature:
        """Registering a name again is fine for the same version and an error for another."""
        held = self._held.setdefault(feature.name, feature)
        if held.version != feature.version:
            raise ValueError(f"{feature.name} is registered as version {held.version}, not {feature.version}")
        return held

    def get(self, name: str) -> Feature:
        if name not in self._held:
            raise KeyError(f"no feature {name!r}; known: {sorted(self._held) or 'none, register the library first'}")
        return self._held[name]

    def stages(self, names: Iterable[str]) -> list[list[Feature]]:
        """The features and what they need, in stages: each needs only earlier ones.  A missing or circular need is an error."""
        depth: dict[str, int] = {}

        def visit(name: str, path: tuple[str, ...]) -> int:
            if name in path:
                raise ValueError("circular: " + " > ".join((*path, name)))
            if name not in depth:
                depth[name] = 1 + max((visit(n, (*path, name)) for n in self.get(name).needs), default=-1)
            return depth[name]

        for name in names:
            visit(name, ())
        return [[self.get(n) for n in sorted(depth) if depth[n] == k] for k in range(max(depth.values(), default=-1) + 1)]


def shift_days(known: str, entry: str) -> int:
    """Sessions by which a value must move to be usable at an entry time: at the open only what is known by the open, at the close all but what the next open tells."""
    if known not in KNOWN or entry not in ENTRY:
        raise ValueError(f"{known!r} at {entry!r}")
    return int(known != "today_open") if entry == "open" else int(known == "next_open")


def matrix(panel: DataFrame, registry: Registry, names: list[str], entry: str = "open", trusted: Column | None = None) -> DataFrame:
    """(symbol, date, features..., trustworthy) of a dense panel: moved by symbol for the entry time.

    trusted: a condition over the panel (not suspended, not at a limit); a null one counts as true.
    """
    rows = panel
    for stage in registry.stages(names):
        rows = rows.select("*", *(f.build().alias(f.name) for f in stage if f.name not in rows.columns))
    moved = []
    for name in names:
        n = shift_days(registry.get(name).known, entry)
        moved.append((F.lag(name, n).over(w.by_symbol()) if n else F.col(name)).alias(name))
    sure = F.lit(True) if trusted is None else F.coalesce(trusted, F.lit(True))
    return rows.select("symbol", "date", *moved, sure.alias("trustworthy"))


def trusted_values(values: DataFrame, names: list[str]) -> DataFrame:
    return values.select("symbol", "date", *(F.when(F.col("trustworthy"), F.col(n)).alias(n) for n in names))


def fingerprint(registry: Registry, names: list[str], entry: str, **about: str) -> str:
    """SHA-1 over a matrix's definition: features with versions, entry time, and what else the caller names (dataset, universe, dates, data version)."""
    parts = [f"{n}@{registry.get(n).version}" for n in sorted(names)] + [f"entry={entry}"] + [f"{k}={v}" for k, v in sorted(about.items())]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()


def entry_of(events: DataFrame) -> str:
    """The one entry time of all events; an error where there is none or several."""
    if "entry" not in events.columns:
        raise ValueError("events have no entry time")
    got = [r[0] for r in events.select("entry").distinct().limit(3).collect()]
    if len(got) != 1 or got[0] not in ENTRY:
        raise ValueError(f"events need one entry time of {ENTRY}, not {got}")
    return got[0]


def attach(events: DataFrame, values: DataFrame, entry: str, names: list[str]) -> DataFrame:
    """Events (event_id, symbol, event_start, entry, ...) with the features of their start; the matrix must be one for the events' entry time."""
    own = entry_of(events)
    if own != entry:
        raise ValueError(f"the features are for entry at the {entry}, the events enter at the {own}")
    right = values.select(F.col("symbol"), F.col("date").alias("event_start"), *names)
    return events.join(right, ["symbol", "event_start"], "left").select(*events.columns, *names)
