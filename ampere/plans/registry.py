"""Registry of named queries over the driver tables.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
optional DuckDB SQL string over the same tables. Floating columns listed in
``rounded`` are snapped on both sides to a binary grid, round(x * 2^m) / 2^m
with 2^m >= 10^digits (digits = 6 unless given), so summation order does not
decide the comparison; a binary grid also never meets the exact decimal ties
(x.xxxxxx5) that means of priced quantities produce.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple[str, ...] = ()
    digits: int = DIGITS

    @property
    def scale(self) -> int:
        """Power of two at least 10^digits: scaling by it is exact, and the
        data's decimal quantities never sit on a binary half-way point."""
        return 2 ** math.ceil(self.digits * math.log2(10))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.rounded:
            scale = F.lit(float(self.scale))
            df = df.withColumns({c: F.round(F.col(f"`{c}`") * scale) / scale for c in self.rounded})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounded:
            return self.sql
        scale = f"CAST({self.scale} AS DOUBLE)"
        rep = ", ".join(f'ROUND("{c}" * {scale}) / {scale} AS "{c}"' for c in self.rounded)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) AS _q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, rounded: tuple[str, ...] | list[str] = (), digits: int = DIGITS):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(rounded), digits)
        return fn
    return deco
