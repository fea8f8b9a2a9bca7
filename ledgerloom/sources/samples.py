"""Transaction-shaped views over the sample tables, for queries, tests and benchmarks.

Both texts run unchanged in Spark SQL and DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TX_EVENTS = """
SELECT
  CASE WHEN event_id % 101 = 7 THEN NULL
       WHEN event_id % 89 = 3 THEN concat('0x', md5(cast(event_id - 1 AS string)))
       ELSE concat('0x', md5(cast(event_id AS string))) END            AS transaction_hash,
  event_id                                                             AS block_number,
  CASE WHEN event_id % 103 = 5 THEN NULL ELSE ts END                   AS timestamp,
  CASE WHEN event_id % 107 = 9 THEN 'dogecoin'
       ELSE CASE user_id % 6 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bitcoin' WHEN 2 THEN 'polygon'
                             WHEN 3 THEN 'solana' WHEN 4 THEN 'avalanche' ELSE 'arbitrum' END
  END                                                                  AS chain,
  concat('0x', cast(user_id AS string))                                AS from_address,
  concat('0x', cast((event_id * 7) % 150 AS string))                   AS to_address,
  CASE WHEN event_id % 97 = 11 THEN -value
       WHEN event_id % 113 = 1 THEN NULL ELSE value END                AS amount_usd,
  value * 0.01 + 0.5                                                   AS gas_fee_usd,
  CASE event_id % 5 WHEN 0 THEN 'ETH' WHEN 1 THEN 'BTC' WHEN 2 THEN 'USDT'
                    WHEN 3 THEN 'USDC' ELSE 'MATIC' END                AS token_symbol,
  CASE event_type WHEN 'view' THEN 'transfer' WHEN 'click' THEN 'swap' WHEN 'purchase' THEN 'mint'
                  WHEN 'signup' THEN 'burn' ELSE 'stake' END           AS tx_type,
  CASE WHEN event_id % 109 = 2 THEN 'unknown'
       WHEN event_type = 'error' THEN 'failed'
       WHEN event_type = 'signup' THEN 'pending' ELSE 'confirmed' END  AS status,
  CASE user_id % 6 WHEN 0 THEN 'src_eth' WHEN 1 THEN 'src_btc' ELSE 'src_other' END AS _source
FROM events
"""

TX_LINEITEM = """
SELECT
  concat('0x', md5(concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)))) AS transaction_hash,
  l_partkey                                   AS block_number,
  l_shipdate                                  AS timestamp,
  CASE r_name WHEN 'AFRICA' THEN 'ethereum' WHEN 'AMERICA' THEN 'bitcoin' WHEN 'ASIA' THEN 'polygon'
              WHEN 'EUROPE' THEN 'solana' ELSE 'avalanche' END AS chain,
  concat('0x', cast(o_custkey AS string))     AS from_address,
  concat('0x', cast(l_suppkey AS string))     AS to_address,
  l_extendedprice * (1 - l_discount)          AS amount_usd,
  l_extendedprice * l_tax                     AS gas_fee_usd,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ETH' WHEN '2' THEN 'BTC' WHEN '3' THEN 'USDT'
                                     WHEN '4' THEN 'USDC' ELSE 'MATIC' END AS token_symbol,
  CASE l_returnflag WHEN 'A' THEN 'transfer' WHEN 'N' THEN 'swap' ELSE 'mint' END AS tx_type,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  r_name                                      AS _source
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

# Labels of receiving addresses, from the supplier table by key modulo.
ADDRESS_LABELS = """
SELECT concat('0x', cast(s_suppkey AS string)) AS address,
       CASE s_suppkey % 5 WHEN 0 THEN 'risky' WHEN 1 THEN 'mixer' WHEN 2 THEN 'exchange' ELSE 'other' END AS category,
       (s_suppkey % 10) / 10.0E0 AS risk_score
FROM supplier
"""


def _view(spark: SparkSession, sf_dir: str, text: str, tables: list[str]) -> DataFrame:
    """The text over the sample tables, which are given to it as arguments: no view of the session is replaced."""
    for table in tables:
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables})


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TX_EVENTS, ["events"])


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TX_LINEITEM, ["lineitem", "orders", "customer", "nation", "region"])


def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ADDRESS_LABELS, ["supplier"])
