"""Names, column resolution and the windows that every operator shares."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Identity of an event; every other column is data.
KEYS = ("case_id", "timestamp", "event_id")
FIELDS = ("case_id", "timestamp", "activity", "resource")
REQUIRED = ("case_id", "timestamp", "activity")


@dataclass(frozen=True)
class SourceNames:
    """What raw logs call the four known fields; the XES names by default."""

    case_id: str = "case:concept:name"
    timestamp: str = "time:timestamp"
    activity: str = "concept:name"
    resource: str = "org:resource"

    def to_dict(self) -> dict[str, str]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


_default = SourceNames()


def set_global_config(**names: str) -> None:
    """Sets what raw logs call some of the fields, for calls without a mapping."""
    global _default
    if unknown := set(names) - set(FIELDS):
        raise ValueError(f"unknown fields {sorted(unknown)}; there are {list(FIELDS)}")
    _default = replace(_default, **names)


def reset_global_config() -> None:
    global _default
    _default = SourceNames()


def get_global_config() -> SourceNames:
    return _default


def resolve(columns: Iterable[str], mapping: Mapping[str, str] | None = None, names: SourceNames | None = None) -> dict[str, str]:
    """Source column -> field. A field comes from the mapping, else its source name, else a column of its own name."""
    columns, mapping = list(columns), dict(mapping or {})
    if unknown := set(mapping) - set(FIELDS):
        raise ValueError(f"unknown fields in the mapping: {sorted(unknown)}")
    if missing := [c for c in mapping.values() if c not in columns]:
        raise ValueError(f"columns of the mapping that aren't there: {missing}")
    found: dict[str, str] = {}
    for field in FIELDS:
        source = mapping.get(field) or next((c for c in ((names or _default).to_dict()[field], field) if c in columns), None)
        if source is not None:
            found[source] = field
        elif field in REQUIRED:
            raise ValueError(f"no column for {field}: name it in the mapping, or set its source name")
    return found


def normalize_columns(df: DataFrame, mapping: Mapping[str, str] | None = None, names: SourceNames | None = None) -> DataFrame:
    """df with the known fields under their own names. A column that had such a name and isn't the field's source goes."""
    found = resolve(df.columns, mapping, names)
    clash = [f for s, f in found.items() if s != f and f in df.columns and f not in found]
    return df.drop(*clash).withColumnsRenamed(found)


def by_case(case: str = "case_id") -> WindowSpec:
    """All events of the row's case."""
    return Window.partitionBy(case)


def in_order(case: str = "case_id", timestamp: str = "timestamp", event: str = "event_id") -> WindowSpec:
    """The case's events in time; unparsed times last, ties by event."""
    return Window.partitionBy(case).orderBy(F.col(timestamp).asc_nulls_last(), F.col(event).asc_nulls_last())


def prefix(length: int | None = None) -> WindowSpec:
    """The case's events up to the row's, at most `length` of them."""
    start = Window.unboundedPreceding if length is None or length > sys.maxsize // 2 else 1 - length
    return in_order().rowsBetween(start, Window.currentRow)


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but the keys."""
    return [c for c in df.columns if c not in KEYS]


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)
