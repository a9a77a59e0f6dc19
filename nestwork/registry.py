"""Filters and strategies by the names that a configuration gives them.

A name is one that was registered, one of the built-in ones, or ``package.module:attribute`` of
importable code. The class names of the default implementations are accepted with any package before
them. An unknown name raises: a configured rule that is not applied would give wrong documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from importlib import import_module
from typing import Any

from pyspark.sql import types as T

from .operators.filters import Filter, skip_unchanged
from .streaming.queueing import Strategy, medium

#: ``(entity, type of its values, the topic's settings) -> filter``
FilterMaker = Callable[[str, T.StructType, Mapping[str, Any]], Filter]

_filters: dict[str, FilterMaker] = {}
_strategies: dict[str, Strategy] = {}


def register_filter(name: str, make: FilterMaker) -> None:
    _filters[name] = make


def register_strategy(name: str, strategy: Strategy) -> None:
    _strategies[name] = strategy


def _default(entity: str, schema: T.StructType, config: Mapping[str, Any]) -> Filter:
    return Filter(config=dict(config))


def _unchanged(entity: str, schema: T.StructType, config: Mapping[str, Any]) -> Filter:
    return skip_unchanged(schema, config.get("filter.ignored.fields") or ())


for _name in ("default", "BaseFilter", "DefaultFilter"):
    register_filter(_name, _default)
register_filter("skip.unchanged", _unchanged)
for _name in ("medium", "QueueingStrategy"):
    register_strategy(_name, medium)


def _find(name: str, known: Mapping[str, Any], what: str) -> Any:
    if name in known:
        return known[name]
    module, colon, attribute = name.partition(":")
    if colon:
        try:
            return getattr(import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            raise ValueError(f"{what} {name!r}: {e}") from e
    last = name.rpartition(".")[2]
    if last in ("BaseFilter", "DefaultFilter", "QueueingStrategy") and last in known:
        return known[last]
    raise ValueError(f"{what} {name!r} is not known; register it or name it as package.module:attribute")


def filter_of(entity: str, schema: T.StructType, config: Mapping[str, Any]) -> Filter:
    """The filter that a topic's ``filter.class`` names; the default one if it names none."""
    name = config.get("filter.class")
    made = _find(str(name), _filters, "filter")(entity, schema, config) if name else _default(entity, schema, config)
    if not isinstance(made, Filter):
        raise ValueError(f"filter {name!r} gives no Filter")
    return made


def strategy_of(config: Mapping[str, Any]) -> Strategy:
    """The strategy that ``queueing.strategy.class`` names; everything is MEDIUM if it names none."""
    name = config.get("queueing.strategy.class")
    return _find(str(name), _strategies, "strategy") if name else medium
