"""Choosing features by name, and the small checks that go with it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Registry:
    """Named column builders. targets: names that look ahead and must not be features."""

    def __init__(self, features: dict[str, Callable], targets: Iterable[str] = ()):
        self.features, self.targets = dict(features), frozenset(targets)


def ensure_list(x: object) -> list:
    return [x] if isinstance(x, str | int) else list(x)


def resolve_features(registry: Registry, selection: str | Iterable[str] | None) -> list[tuple[str, Callable]]:
    """None: nothing; "all": everything in the registry's order; a name or several: these, each once."""
    if not isinstance(registry, Registry):
        raise TypeError(f"{registry!r} has no registry of features")
    if selection is None:
        return []
    names = list(registry.features) if selection == "all" else list(dict.fromkeys(ensure_list(selection)))
    if ahead := [n for n in names if n in registry.targets]:
        raise ValueError(f"{ahead} are targets: they look ahead, so that a model would see what it is to predict")
    if unknown := [n for n in names if n not in registry.features]:
        raise ValueError(f"unknown features {unknown}; there are {list(registry.features)}")
    return [(n, registry.features[n]) for n in names]


def validate_columns(columns: Iterable[str], required: Iterable[str]) -> list[str]:
    required = list(required)
    if missing := [c for c in required if c not in set(columns)]:
        raise ValueError(f"missing columns: {missing}")
    return required


def infer_column_types(df: DataFrame, int_as_cat: bool = False) -> tuple[list[str], list[str], list[str]]:
    """(categorical, numeric, time) columns by their types; booleans and text are categorical."""
    cat, num, time = [], [], []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            time.append(field.name)
        elif isinstance(kind, T.IntegralType):
            (cat if int_as_cat else num).append(field.name)
        elif isinstance(kind, T.NumericType):
            num.append(field.name)
        else:
            cat.append(field.name)
    return cat, num, time
