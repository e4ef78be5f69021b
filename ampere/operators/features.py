"""Feature construction (E1-E6) and the timestamp merge."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalar import safe_div
from .series import Lag, Rolling, Series, add_lag_features, add_rolling_features, apply_series  # noqa: F401


@dataclass
class FeatureSet:
    features: DataFrame
    feature_names: list[str]
    target_column: str | None = None
    metadata: dict = field(default_factory=dict)


def time_feature_columns(date_column: str, weekend_from: int = 5) -> dict:
    """E1 / F6-F13. Weekday is Monday=1 ... Sunday=7; ``weekend_from=5`` marks
    Friday to Sunday as weekend (the reference's rule), 6 gives Sat-Sun."""
    ts = F.col(date_column)
    hour, month = F.hour(ts), F.month(ts)
    two_pi = F.lit(math.pi * 2)
    dow = (F.weekday(ts) + 1).cast("int")
    return {
        "hour": hour.cast("int"),
        "day_of_week": dow,
        "month": month.cast("int"),
        "day_of_month": F.dayofmonth(ts).cast("int"),
        "day_of_year": F.dayofyear(ts).cast("int"),
        "week_of_year": F.weekofyear(ts).cast("int"),
        "hour_sin": F.sin(two_pi * hour / 24),
        "hour_cos": F.cos(two_pi * hour / 24),
        "month_sin": F.sin(two_pi * month / 12),
        "month_cos": F.cos(two_pi * month / 12),
        "is_weekend": (dow >= weekend_from).cast("tinyint"),
    }


def add_time_features(df: DataFrame, date_column: str = C.DATE_COLUMN, weekend_from: int = 5) -> DataFrame:
    if date_column not in df.columns:
        return df
    return df.withColumns(time_feature_columns(date_column, weekend_from))


def price_feature_columns(columns: Sequence[str]) -> dict:
    """E2 projections (the 24-row volatility is a series op, see create_feature_set)."""
    out = {}
    p1, p2, f1 = F.col(C.PRICE_FIRST), F.col(C.PRICE_SECOND), F.col(C.FORECAST_FIRST)
    if C.PRICE_FIRST in columns and C.PRICE_SECOND in columns:
        out["price_diff"] = p2 - p1
        out["price_diff_pct"] = safe_div(p2 - p1, p1) * 100
    if C.PRICE_FIRST in columns and C.FORECAST_FIRST in columns:
        out["forecast_error_first"] = p1 - f1
        out["forecast_error_pct"] = safe_div(F.abs(p1 - f1), p1) * 100
    return out


def volume_feature_columns(columns: Sequence[str]) -> dict:
    out = {}
    if C.VOLUME_FIRST in columns and C.VOLUME_SECOND in columns:
        out["total_volume"] = F.col(C.VOLUME_FIRST) + F.col(C.VOLUME_SECOND)
        out["volume_ratio"] = safe_div(F.col(C.VOLUME_SECOND), F.col(C.VOLUME_FIRST))
    return out


def system_feature_columns(columns: Sequence[str]) -> dict:
    """Only when both bounds exist."""
    if C.SYSTEM_LOW in columns and C.SYSTEM_HIGH in columns:
        lo, hi = F.col(C.SYSTEM_LOW), F.col(C.SYSTEM_HIGH)
        return {"forecast_system_avg": (lo + hi) / 2, "system_price_spread": hi - lo}
    return {}


def add_price_features(df: DataFrame, s: Series) -> DataFrame:
    df = df.withColumns(price_feature_columns(df.columns))
    if C.PRICE_FIRST in df.columns:
        df = apply_series(df, s, [Rolling(C.PRICE_FIRST, 24, "std", "price_volatility_24h")])
    return df


def add_volume_features(df: DataFrame, s: Series) -> DataFrame:
    df = df.withColumns(volume_feature_columns(df.columns))
    if C.VOLUME_FIRST in df.columns:
        df = apply_series(df, s, [Rolling(C.VOLUME_FIRST, 24, "mean", "volume_rolling_mean_24h")])
    return df


def add_system_price_features(df: DataFrame) -> DataFrame:
    return df.withColumns(system_feature_columns(df.columns))


def feature_ops(columns: Sequence[str], include_lags: bool = True, include_rolling: bool = True,
                lags: Sequence[int] = C.DEFAULT_LAGS, windows: Sequence[int] = C.DEFAULT_ROLLING_WINDOWS,
                exclude_current: bool = False) -> list:
    """All ordered features of E2/E3/E5 as series ops (one shared framing)."""
    ops: list = []
    if C.PRICE_FIRST in columns:
        ops.append(Rolling(C.PRICE_FIRST, 24, "std", "price_volatility_24h"))
    if C.VOLUME_FIRST in columns:
        ops.append(Rolling(C.VOLUME_FIRST, 24, "mean", "volume_rolling_mean_24h"))
    if include_lags:
        for c in (C.PRICE_FIRST, C.PRICE_SECOND):
            if c in columns:
                ops += [Lag(c, n, f"{c}_lag_{n}") for n in lags]
    if include_rolling and C.PRICE_FIRST in columns:
        for n in windows:
            for st in ("mean", "std", "min", "max"):
                ops.append(Rolling(C.PRICE_FIRST, n, st, f"{C.PRICE_FIRST}_rolling_{st}_{n}",
                                   exclude_current=exclude_current))
    return ops


def create_feature_set(df: DataFrame, s: Series | None = None, target_column: str | None = None,
                       include_lags: bool = True, include_rolling: bool = True, include_time: bool = True,
                       date_column: str = C.DATE_COLUMN, weekend_from: int = 5,
                       exclude_current: bool = False) -> FeatureSet:
    """E5: time -> price -> volume -> system -> lags -> rolling, as one plan.

    Column order follows the reference: time, price projections, volatility,
    volume projections, volume rolling mean, system, lags, rolling.
    """
    s = s or Series(order_by=(date_column,))
    cols = list(df.columns)
    out = df
    if include_time and date_column in cols:
        out = out.withColumns(time_feature_columns(date_column, weekend_from))
    proj = {**price_feature_columns(cols), **volume_feature_columns(cols), **system_feature_columns(cols)}
    out = out.withColumns(proj)
    ops = feature_ops(cols, include_lags, include_rolling, exclude_current=exclude_current)
    out = apply_series(out, s, ops)
    order = list(df.columns)
    if include_time and date_column in cols:
        order += list(time_feature_columns(date_column))
    order += list(price_feature_columns(cols))
    if C.PRICE_FIRST in cols:
        order.append("price_volatility_24h")
    order += list(volume_feature_columns(cols))
    if C.VOLUME_FIRST in cols:
        order.append("volume_rolling_mean_24h")
    order += list(system_feature_columns(cols))
    order += [o.name for o in ops if o.name not in order]
    out = out.select(*[F.col(f"`{c}`") for c in order])
    exclude = {date_column, target_column} if target_column else {date_column}
    names = [c for c in order if c not in exclude]
    meta = {"include_lags": include_lags, "include_rolling": include_rolling, "include_time": include_time}
    return FeatureSet(out, names, target_column, meta)


def select_model_features(columns: Sequence[str]) -> list[str]:
    """P5: configured forecast inputs that exist plus names holding one of the
    fixed fragments; sorted for a deterministic order."""
    chosen = {c for c in C.FORECAST_FEATURES if c in columns}
    chosen |= {c for c in columns if any(f in c for f in C.FEATURE_NAME_FRAGMENTS)}
    return sorted(chosen)


def prepare_training_data(df: DataFrame, feature_columns: Sequence[str], target_column: str,
                          drop_na: bool = True) -> tuple[DataFrame, list[str]]:
    """Existing features + target; complete rows only (null test, so a
    NaN is kept as in the reference)."""
    valid = [c for c in feature_columns if c in df.columns]
    if target_column not in df.columns:
        raise ValueError(f"Target column {target_column} not found in DataFrame")
    keep = [c for c in df.columns if c not in valid and c != target_column]
    out = df.select(*[F.col(f"`{c}`") for c in keep + valid + [target_column]])
    if drop_na:
        cond = F.lit(True)
        for c in valid + [target_column]:
            cond = cond & F.col(f"`{c}`").isNotNull()
        out = out.where(cond)
    return out, valid


def merge_datasets(auction: DataFrame, forecast: DataFrame | None = None, system: DataFrame | None = None,
                   date_column: str = C.DATE_COLUMN) -> DataFrame:
    """Left joins on the timestamp; duplicate right names get the
    ``_right`` suffix; duplicate right keys multiply left rows. The planner
    (AQE) picks broadcast or sort-merge from runtime sizes and splits skewed
    join partitions."""
    result = auction
    for right in (forecast, system):
        if right is None or date_column not in right.columns:
            continue
        taken = set(result.columns)
        renamed = right.select(*[F.col(f"`{c}`").alias(c if c == date_column or c not in taken else f"{c}_right")
                                 for c in right.columns])
        result = result.join(renamed, on=date_column, how="left")
    return result
