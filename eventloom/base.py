"""What own stages build on: parameters, fitted state, checked names, and the cardinality of results."""

from __future__ import annotations

import inspect
from collections.abc import Iterable

from pyspark.sql import DataFrame

from eventloom.eventlog import to_event_log
from eventloom.schema import KEYS


class NotFittedError(ValueError):
    pass


class Parameterized:
    """Parameters are what __init__ takes and keeps under the same names: they can be read, set and cloned."""

    @classmethod
    def parameter_names(cls) -> tuple[str, ...]:
        return tuple(p for p in inspect.signature(cls.__init__).parameters if p != "self") if cls.__init__ is not object.__init__ else ()

    def get_params(self) -> dict[str, object]:
        return {p: getattr(self, p) for p in self.parameter_names()}

    def set_params(self, **params: object) -> Parameterized:
        if unknown := set(params) - set(self.parameter_names()):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        for name, value in params.items():
            setattr(self, name, value)
        return self

    def clone(self) -> Parameterized:
        """The same parameters, not fitted."""
        return type(self)(**self.get_params())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


def checked_names(made: Iterable[str], declared: Iterable[str] | None, who: object) -> None:
    """ValueError where a stage makes other columns than it declares."""
    made = list(made)
    if declared is not None and made != list(declared):
        raise ValueError(f"{type(who).__name__} made {made} and declares {list(declared)}")


class BaseProcessTransformer(Parameterized):
    """A stage of one's own: write _fit(df) and _transform(df), which get canonical logs.

    The result has a row for each event: the keys, then the columns that names_out declares; None: any.
    """

    #: "event" or "case": what the result has a row for.
    cardinality = "event"
    names_out: tuple[str, ...] | None = None

    def get_feature_names_out(self) -> list[str] | None:
        return None if self.names_out is None else list(self.names_out)

    def keys_out(self) -> tuple[str, ...]:
        return KEYS if self.cardinality == "event" else KEYS[:1]

    def fit(self, log) -> BaseProcessTransformer:
        df = to_event_log(log)
        self.feature_names_in_ = [c for c in df.columns if c not in KEYS]
        self.n_features_in_ = len(self.feature_names_in_)
        self._fit(df)
        self.fitted_ = True
        return self

    def transform(self, log) -> DataFrame:
        if not getattr(self, "fitted_", False):
            raise NotFittedError(f"{type(self).__name__} isn't fitted yet")
        out = self._transform(to_event_log(log))
        keys = self.keys_out()
        if lacking := [k for k in keys if k not in out.columns]:
            raise ValueError(f"{type(self).__name__} made no {lacking}")
        checked_names((c for c in out.columns if c not in keys), self.get_feature_names_out(), self)
        return out

    def fit_transform(self, log) -> DataFrame:
        return self.fit(log).transform(log)

    def _fit(self, df: DataFrame) -> None:
        pass

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class CaseLevelTransformer(BaseProcessTransformer):
    """A stage whose result has a row for each case: case_id, then what names_out declares.

    Nothing that needs events can follow it: such a result is no event log, and to_event_log, which every stage calls,
    raises a ValueError that says so.
    """

    cardinality = "case"
