"""Spark-native electricity-market analytics.

Every operator takes and returns a Spark DataFrame. Public surface:
"""

from .config import (DEFAULT, AppConfig, CleaningConfig, ImputationMethod, ModelConfig, ModelType,
                     TradingConfig)
from .operators.clean import (CleaningReport, calculate_data_quality_score, clean_auction_data,
                              clean_forecast_data, clean_system_prices, clean_table, convert_to_numeric,
                              data_quality_score, detect_outliers, fill_missing_values, find_best_imputation_method,
                              get_missing_value_stats, impute_rolling, missing_value_stats, parse_datetime,
                              remove_duplicates)
from .operators.features import (FeatureSet, add_price_features, add_system_price_features, add_time_features,
                                 add_volume_features, create_feature_set, merge_datasets, prepare_training_data,
                                 select_model_features)
from .operators.model import TrainingResult, cross_validate, evaluate, predict, train, train_all
from .operators.series import (Series, add_lag_features, add_rolling_features, apply_series, backward_fill,
                               cumulative_sum, forward_fill, interpolate_linear, lookback_sequences,
                               with_row_index)
from .operators.stats import summary_dashboard
from .operators.trade import (backtest_rows, backtest_totals, calculate_profit, compare_strategies,
                              oracle_backtest, ratio_proxy_backtest, run_backtest, signal_columns, with_signals)
from .sources.csv import (DataLoadResult, load_all_from_directory, load_auction_data, load_csv,
                          load_forecast_inputs, load_system_prices, load_tables, validate_dataframe, write_csv)

__version__ = "0.1.0"

__all__ = [
    "DEFAULT", "AppConfig", "CleaningConfig", "ImputationMethod", "ModelConfig", "ModelType", "TradingConfig",
    "CleaningReport", "calculate_data_quality_score", "clean_auction_data", "clean_forecast_data",
    "clean_system_prices", "get_missing_value_stats", "clean_table", "convert_to_numeric", "data_quality_score",
    "detect_outliers",
    "fill_missing_values", "find_best_imputation_method", "impute_rolling", "missing_value_stats",
    "parse_datetime", "remove_duplicates",
    "FeatureSet", "add_price_features", "add_system_price_features", "add_time_features", "add_volume_features",
    "create_feature_set", "merge_datasets", "prepare_training_data", "select_model_features",
    "TrainingResult", "cross_validate", "evaluate", "predict", "train", "train_all",
    "Series", "add_lag_features", "add_rolling_features", "apply_series", "backward_fill", "cumulative_sum",
    "forward_fill", "interpolate_linear", "lookback_sequences", "with_row_index",
    "summary_dashboard",
    "backtest_rows", "backtest_totals", "calculate_profit", "compare_strategies", "oracle_backtest",
    "ratio_proxy_backtest", "run_backtest", "signal_columns", "with_signals",
    "DataLoadResult", "load_all_from_directory", "load_auction_data", "load_csv", "load_forecast_inputs",
    "load_system_prices", "load_tables", "validate_dataframe", "write_csv",
]
