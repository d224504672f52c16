"""Edge tables: the driver's tables as transfer records, and the unified two-source scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.layers import alive

NATIVE_LABEL = "ETH"
KEYS = ("date", "from_addr", "to_addr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a day points from its user to the user of the day's next event; clicks are token transfers without fees and bytes."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    e = e.select(F.to_date("ts").alias("date"), "ts", "event_id", "user_id", "event_type", "value", k.alias("k"))
    following = F.lead("user_id").over(Window.partitionBy("date").orderBy("ts", "event_id"))
    e = e.withColumn("next_id", following).where("next_id IS NOT NULL")
    token = F.col("event_type") == "click"
    return e.select(
        "date",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("from_addr"),
        F.concat(F.lit("u"), F.col("next_id").cast("string")).alias("to_addr"),
        F.when(token, F.concat(F.lit("0xtok"), (F.col("k") % 3).cast("string"))).otherwise(NATIVE_LABEL).alias("erc20"),
        F.lit(1).cast("bigint").alias("tx_count"),
        F.when(F.col("event_type").isin("purchase", "click"), F.col("value")).otherwise(0.0).alias("tx_value"),
        F.when(~token, F.col("k") * 0.001).alias("total_gas_fees"),
        F.when(~token, 6 * F.col("k")).alias("total_input_bytes"),
    )


def ship_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier transaction records, one per line item."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.to_date("l_shipdate").alias("date"),
        F.col("o_orderkey").alias("block_number"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_address"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_address"),
        F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("value"),
        (12 * F.col("l_quantity")).alias("n_input_nonzero_bytes"),
        F.col("l_quantity").alias("gas_used"),
        F.col("l_tax").alias("gas_price"),
        F.when(F.col("l_linestatus") == "O", 2).otherwise(0).alias("transaction_type"),
        F.col("l_discount").alias("max_fee_per_gas"),
        (F.col("l_tax") / 2).alias("max_priority_fee_per_gas"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("log_index"),
    )


def ship_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base fees by block; every seventh block is unknown."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("block_number"), (F.col("o_totalprice") / 1e6).alias("base_fee_per_gas"), F.to_date("o_orderdate").alias("block_date"))


def ship_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token transfers: returned line items, with the part's brand as token."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("erc20"))
    return ship_transactions(spark, sf_dir).where("flag = 'R'").join(part, F.col("part") == F.col("p_partkey")).select("date", "block_number", "from_address", "to_address", "erc20", "value")


def unified(native: DataFrame, token: DataFrame, start: str | None = None, end: str | None = None, dead: tuple[str, ...] = ("\\N",), canonical: bool = True) -> DataFrame:
    """Both sources in one schema: token label on native rows, NULL for measures a source lacks, NaN taken as missing, dates clamped, dead ends dropped."""
    both = native.withColumn("erc20", F.lit(NATIVE_LABEL)).unionByName(token, allowMissingColumns=True)
    both = both.select(*(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in both.dtypes))
    if start is not None:
        both = both.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        both = both.where(F.col("date") <= F.lit(end).cast("date"))
    both = alive(both, dead)
    return canonicalised(both) if canonical else both


def canonicalised(edges: DataFrame) -> DataFrame:
    """Endpoints in order, so both directions of a pair are one edge."""
    low, high = F.least("from_addr", "to_addr"), F.greatest("from_addr", "to_addr")
    return edges.withColumns({"from_addr": low, "to_addr": high})


def deduplicated(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def key_ranges(spark: SparkSession, low: int, high: int, step: int) -> DataFrame:
    """Inclusive ranges of at most ``step`` keys that cover low..high."""
    starts = F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"), F.lit(step).cast("bigint"))) if low <= high else F.explode(F.array().cast("array<bigint>"))
    return spark.range(1).select(starts.alias("lo")).select("lo", F.least(F.col("lo") + step - 1, F.lit(high)).alias("hi"))


def block_ranges(blocks: DataFrame) -> DataFrame:
    """First and last block of every day."""
    return blocks.groupBy(F.col("block_date").alias("date")).agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def daily_series(spark: SparkSession, sf_dir: str, by: str | None = "l_returnflag") -> DataFrame:
    """series_id, date, value: daily sums of line item prices."""
    line = table(spark, sf_dir, "lineitem")
    series = F.col(by) if by else F.lit("all")
    return line.groupBy(series.alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
