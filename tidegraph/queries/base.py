"""Registry of queries, and the SQL of the adapters that oracles start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources import edges as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

USER_EDGES = """
raw AS (
  SELECT CAST(ts AS DATE) AS date, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS next_id
  FROM events),
edges AS (
  SELECT date, 'u' || user_id AS from_addr, 'u' || next_id AS to_addr,
         CASE WHEN event_type = 'click' THEN '0xtok' || (k % 3) ELSE 'ETH' END AS erc20,
         CAST(1 AS BIGINT) AS tx_count,
         CASE WHEN event_type IN ('purchase', 'click') THEN value ELSE 0.0 END AS tx_value,
         CASE WHEN event_type <> 'click' THEN k * CAST(0.001 AS DOUBLE) END AS total_gas_fees,
         CASE WHEN event_type <> 'click' THEN 6 * k END AS total_input_bytes
  FROM raw WHERE next_id IS NOT NULL),
canon AS (
  SELECT date, least(from_addr, to_addr) AS from_addr, greatest(from_addr, to_addr) AS to_addr, erc20, tx_count, tx_value, total_gas_fees, total_input_bytes FROM edges)"""

SHIP = """
tx AS (
  SELECT CAST(l_shipdate AS DATE) AS date, o_orderkey AS block_number, 'c' || o_custkey AS from_address, 's' || l_suppkey AS to_address,
         CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_extendedprice END AS value, 12 * l_quantity AS n_input_nonzero_bytes,
         l_quantity AS gas_used, l_tax AS gas_price, CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END AS transaction_type,
         l_discount AS max_fee_per_gas, l_tax / 2 AS max_priority_fee_per_gas, l_partkey AS part, l_returnflag AS flag, l_linenumber AS log_index
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
blk AS (
  SELECT o_orderkey AS block_number, o_totalprice / 1e6 AS base_fee_per_gas, CAST(o_orderdate AS DATE) AS block_date FROM orders WHERE o_orderkey % 7 <> 0)"""

SERIES = """
series AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice), 2) AS value
  FROM lineitem GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its DuckDB SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.canonicalised(E.user_edges(spark, sf_dir))
