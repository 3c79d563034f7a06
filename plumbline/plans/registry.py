"""Stages by name: readers, filters and writers of pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Filter = Callable[..., DataFrame]
READERS: dict[str, Callable] = {}
FILTERS: dict[str, Filter] = {}
WRITERS: dict[str, Callable] = {}


def reader(name: str) -> Callable:
    return lambda f: READERS.setdefault(name, f)


def stage(name: str) -> Callable[[Filter], Filter]:
    """Registers a filter: a function of a DataFrame of points and options."""
    return lambda f: FILTERS.setdefault(name, f)


def writer(name: str) -> Callable:
    return lambda f: WRITERS.setdefault(name, f)


def registered(name: str) -> bool:
    return name in READERS or name in FILTERS or name in WRITERS
