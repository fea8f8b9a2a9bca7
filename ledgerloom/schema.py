"""Transaction schema, allowed values and the feature catalog."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed values of the enumerated columns.
CHAINS = ["ethereum", "bitcoin", "polygon", "solana", "avalanche", "arbitrum"]
STATUSES = ["confirmed", "failed", "pending"]
EARLIEST_TIMESTAMP = "2015-01-01 00:00:00"
KEY_COLUMNS = ["transaction_hash", "timestamp", "chain"]

TRANSACTION = T.StructType([
    T.StructField("transaction_hash", T.StringType()),
    T.StructField("block_number", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("chain", T.StringType()),
    T.StructField("from_address", T.StringType()),
    T.StructField("to_address", T.StringType()),
    T.StructField("amount_usd", T.DoubleType()),
    T.StructField("gas_fee_usd", T.DoubleType()),
    T.StructField("token_symbol", T.StringType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("_source", T.StringType()),
])

# Row order inside a group: time first, then columns that make the order total.
TIME = "timestamp"
TIES = ["block_number", "transaction_hash"]
ENTITY = "from_address"

# Type names accepted in expected schemas, with the default for a missing column.
TYPE_NAMES: dict[str, tuple[T.DataType, object]] = {
    "float64": (T.DoubleType(), 0.0),
    "int64": (T.LongType(), 0),
    "string": (T.StringType(), ""),
    "object": (T.StringType(), None),
    "bool": (T.BooleanType(), False),
    "datetime64[ns]": (T.TimestampNTZType(), None),
}

# Feature groups and the features each one serves.
FEATURE_GROUPS: dict[str, list[str]] = {
    "transaction_velocity": [
        "txn_count_1h", "txn_count_24h", "txn_count_7d",
        "amount_sum_1h", "amount_sum_24h", "amount_sum_7d",
        "amount_mean_1h", "amount_mean_24h", "amount_mean_7d",
        "unique_recipients_24h", "unique_chains_24h",
    ],
    "amount_statistics": [
        "amount_log", "amount_zscore", "amount_percentile",
        "fee_ratio", "total_cost_usd", "amount_momentum",
        "max_single_txn_7d", "amount_cv_7d",
    ],
    "behavioral": [
        "hour_of_day", "day_of_week", "is_weekend", "is_night",
        "preferred_chain", "preferred_token", "days_since_first_txn",
        "days_since_last_txn", "account_age_days",
    ],
    "risk_signals": [
        "velocity_x_amount", "cross_chain_activity", "high_value_flag",
        "rapid_succession_flag", "dormant_account_flag", "new_address_flag",
        "large_round_amount_flag", "off_hours_large_txn",
    ],
    "network": [
        "unique_counterparties_7d", "counterparty_risk_score_avg",
        "known_risky_address", "mixer_interaction", "exchange_volume_pct",
    ],
}
