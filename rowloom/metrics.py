"""Counters of an engine, and measures that a plan takes of the rows that pass through it."""

from __future__ import annotations

import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation


class Metrics:
    """``<kind>.statements``, ``.rows``, ``.seconds`` and ``.errors`` for each kind of statement, ``commit.lost`` for lost races, and so on."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()

    def add(self, name: str, n: float = 1) -> None:
        self.counts[name] += n

    @contextmanager
    def timed(self, kind: str):
        began = time.perf_counter()
        self.add(f"{kind}.statements")
        try:
            yield
        except Exception:
            self.add(f"{kind}.errors")
            raise
        finally:
            self.add(f"{kind}.seconds", time.perf_counter() - began)

    def rows(self) -> list[tuple[str, float]]:
        return sorted((k, float(v)) for k, v in self.counts.items())


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what its next action will have measured: aggregates taken as the rows pass, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, *[m.alias(n) for n, m in measures.items()]), seen
