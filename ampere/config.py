"""Frozen configuration for the market analytics operators.

Everything is passed explicitly; nothing here is mutated at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class ImputationMethod(str, Enum):
    ROLLING_MEAN = "rolling_mean"
    ROLLING_MEDIAN = "rolling_median"
    INTERPOLATE_LINEAR = "interpolate_linear"
    FORWARD_FILL = "forward_fill"
    BACKWARD_FILL = "backward_fill"


class ModelType(str, Enum):
    LINEAR_REGRESSION = "linear_regression"
    RANDOM_FOREST = "random_forest"
    GRADIENT_BOOSTING = "gradient_boosting"
    XGBOOST = "xgboost"
    SVR = "svr"
    ELASTIC_NET = "elastic_net"
    MLP = "mlp"
    LSTM = "lstm"


# Fixed values that must equal the reference for equal results.
DATE_COLUMN = "Date (WET)"
PRICE_FIRST = "price_first_auction"
PRICE_SECOND = "price_second_auction"
VOLUME_FIRST = "traded_volume_first_auction"
VOLUME_SECOND = "traded_volume_second_auction"
FORECAST_FIRST = "price_forecast_first_auction"
SYSTEM_PRICE = "system_price"
SYSTEM_LOW = "forecast_system_price_low"
SYSTEM_HIGH = "forecast_system_price_high"
FORECAST_FEATURES = (
    "demand",
    "within_day_availability",
    "within_day_margin",
    "margin",
    "long_term_wind",
    "long_term_wind_over_demand",
    "long_term_wind_over_margin",
    "long_term_solar",
    "long_term_solar_over_demand",
    "long_term_solar_over_margin",
    "margin_over_demand",
    "snsp_forecast",
    "stack_price",
    "within_day_potential_stack_price",
    "previous_day_ahead_price",
    "previous_continuous_half_hour_vwap",
    "inertia_forecast",
)
AUCTION_NUMERIC = (PRICE_FIRST, PRICE_SECOND, VOLUME_FIRST, VOLUME_SECOND, FORECAST_FIRST)
AUCTION_UNIT_TOKENS = ("GBP", "MW")
FORECAST_UNIT_TOKENS = ("GBP", "MW", "%")
SYSTEM_UNIT_TOKENS = ("GBP",)
AUCTION_FILE = "auction_data.csv"
FORECAST_FILE = "forecast_inputs.csv"
SYSTEM_FILE = "system_prices.csv"
DEFAULT_LAGS = (1, 2, 3, 24, 48, 168)
DEFAULT_ROLLING_WINDOWS = (3, 6, 12, 24)
# Name fragments that select model inputs in the training page.
FEATURE_NAME_FRAGMENTS = ("_lag_", "_rolling_", "hour", "month", "is_weekend")


@dataclass(frozen=True)
class CleaningConfig:
    rolling_window: int = 24
    default_imputation: ImputationMethod = ImputationMethod.ROLLING_MEDIAN
    outlier_std_threshold: float = 3.0
    date_format: str = "d/M/yyyy H:mm"
    imputation_test_size: int = 24


@dataclass(frozen=True)
class TradingConfig:
    transaction_cost: float = 5.0
    max_volume_per_trade: float = 10.0
    price_diff_threshold: float = 10.0


@dataclass(frozen=True)
class ModelConfig:
    test_size: float = 0.2
    forest_trees: int = 100
    forest_depth: int = 10
    boost_iters: int = 100
    boost_depth: int = 5
    boost_step: float = 0.1
    elastic_alpha: float = 1.0
    elastic_l1_ratio: float = 0.5
    lookback: int = 10
    cv_folds: int = 5
    seed: int = 42
    # second-order boosting: squared and absolute regularisation, least hessian of a child, bins
    boost_penalty: float = 1.0
    boost_gain: float = 0.0
    boost_child: float = 1.0
    boost_bins: int = 255
    svr_c: float = 100.0
    svr_epsilon: float = 0.1
    svr_iters: int = 60
    landmarks: int = 256
    hidden_layers: tuple[int, ...] = (100, 50)
    mlp_alpha: float = 1e-4
    mlp_iters: int = 200
    # share of the old state that the recurrent units of each time scale keep, and random mixtures of their inputs
    memories: tuple[float, ...] = (0.0, 0.5, 0.75, 0.9, 0.97, 0.99)
    mixtures: int = 16
    recurrent_ridge: float = 1e-2


@dataclass(frozen=True)
class AppConfig:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    trading: TradingConfig = field(default_factory=TradingConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    date_column: str = DATE_COLUMN


DEFAULT = AppConfig()
