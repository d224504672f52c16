"""Transactions to edges: daily aggregates, weekly roll-ups, and what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalars import WEI, decimals, fee, scaled, week_of_month


def native_edges(transactions: DataFrame, blocks: DataFrame, unit: float = WEI) -> DataFrame:
    """Daily sums by sender and receiver; amounts are turned to doubles and units before any sum can overflow."""
    t = transactions.join(blocks.select("block_number", "base_fee_per_gas"), "block_number", "left")
    paid = fee(F.col("gas_used"), F.col("transaction_type"), F.col("max_fee_per_gas"), F.col("max_priority_fee_per_gas"), F.col("base_fee_per_gas"), F.col("gas_price"))
    value = F.col("value").cast("double") / unit
    return t.groupBy("date", F.col("from_address").alias("from_addr"), F.col("to_address").alias("to_addr")).agg(
        F.min("block_number").alias("start_block"),
        F.max("block_number").alias("end_block"),
        F.count("*").alias("tx_count"),
        F.sum(value).alias("tx_value"),
        F.max(value).alias("max_value"),
        F.sum("gas_price").alias("total_gas_price"),
        (F.sum(paid) / unit).alias("total_gas_fees"),
        F.sum("n_input_nonzero_bytes").alias("total_input_bytes"),
        F.min("n_input_nonzero_bytes").alias("min_input_bytes"),
        F.count_if((F.col("value") == 0) & (F.col("n_input_nonzero_bytes") > 200)).alias("factory_approx"),
    )


def token_edges(transfers: DataFrame, known: dict[str, int] | None = None, default: int = 18) -> DataFrame:
    """Daily sums by sender, receiver and token, in units of each token."""
    amount = scaled(F.col("value"), decimals(F.col("erc20"), known, default))
    return transfers.groupBy("date", F.col("from_address").alias("from_addr"), F.col("to_address").alias("to_addr"), "erc20").agg(
        F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.count("*").alias("tx_count"), F.sum(amount).alias("tx_value"), F.max(amount).alias("max_value")
    )


#: How each measure rolls up; all are decomposable, so aggregation is partial on the map side.
ROLL_UP = {"start_block": F.min, "end_block": F.max, "tx_count": F.sum, "tx_value": F.sum, "max_value": F.max, "total_gas_price": F.sum, "total_gas_fees": F.sum, "total_input_bytes": F.sum, "min_input_bytes": F.min, "factory_approx": F.sum}


def rolled_up(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks re-aggregated by ``keys`` (add the token for token edges)."""
    return edges.groupBy(*keys).agg(*(how(c).alias(c) for c, how in ROLL_UP.items() if c in edges.columns))


def with_weeks(edges: DataFrame) -> DataFrame:
    """ISO year and week, and the week-of-month label, of each row's date."""
    return edges.withColumns({"iso_year": F.expr("extract(YEAROFWEEK FROM date)").cast("int"), "iso_week": F.weekofyear("date"), "week_label": week_of_month(F.col("date"))})


def week_groups(edges: DataFrame) -> DataFrame:
    """Per ISO week: the days it holds, its first day and that day's label."""
    days = with_weeks(edges.select("date").distinct())
    return days.groupBy("iso_year", "iso_week").agg(F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ",").alias("days"), F.min("date").alias("first_day"), F.min_by("week_label", "date").alias("week_label"))


def pair_sums(edges: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums by key; rows with a NULL key are left out, sums of nothing are 0."""
    present = edges.na.drop(subset=keys)
    return present.groupBy(*keys).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))


def daily_counts(edges: DataFrame) -> DataFrame:
    """Edge rows and distinct endpoints per day."""
    ends = edges.select("date", F.explode(F.array("from_addr", "to_addr")).alias("address"))
    rows = edges.groupBy("date").agg(F.count("*").alias("n_edges"))
    return rows.join(ends.groupBy("date").agg(F.count_distinct("address").alias("n_nodes")), "date")


def endpoints(edges: DataFrame, *keep: Column | str) -> DataFrame:
    """Both endpoints of each edge from one scan."""
    return edges.select(*keep, F.explode(F.array("from_addr", "to_addr")).alias("address"))
