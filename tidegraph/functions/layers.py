"""Named row filters ("layers"), metrics, and which of them go together.

A layer is one boolean SQL expression over the unified edge table, so the same
text serves Column filters, SQL and documentation. Missing measures are NULL,
never NaN: a comparison with NULL keeps a row out, which is the rule for token
rows without byte counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The byte bands and the 14 layer names with their predicates.
NATIVE, TOKEN = "erc20 <=> 'ETH'", "NOT (erc20 <=> 'ETH')"
CONTRACT, SIMPLE = "tx_value = 0", "tx_value > 0"
BANDS = {
    "factory": "total_input_bytes >= 100",
    "nonFactory": "total_input_bytes < 100",
    "highInput": "total_input_bytes >= 500",
    "mediumInput": "total_input_bytes >= 100 AND total_input_bytes < 500",
}
LAYERS: dict[str, str] = {
    "contract_txs_ETH_only": f"{CONTRACT} AND {NATIVE}",
    "simple_txs_ETH_only": f"{SIMPLE} AND {NATIVE}",
    **{f"contract_{band}_ETH_only": f"{CONTRACT} AND {rule} AND {NATIVE}" for band, rule in BANDS.items()},
    "contract_txs_ALL": CONTRACT,
    "simple_txs_ALL": SIMPLE,
    **{f"contract_{band}_ALL": f"{CONTRACT} AND {rule}" for band, rule in BANDS.items()},
    "contract_txs_ERC20_only": f"{CONTRACT} AND {TOKEN}",
    "simple_txs_ERC20_only": f"{SIMPLE} AND {TOKEN}",
}
METRICS = ("tx_count", "tx_value", "total_gas_fees")


def token_layers(tokens: dict[str, str]) -> dict[str, str]:
    """One layer per token address, compared in lower case."""
    return {symbol: f"lower(erc20) = '{address.lower()}'" for symbol, address in tokens.items()}


def valid_combinations() -> list[tuple[str, str]]:
    """(metric, layer) pairs that make sense: values only where value moves, fees only where rows carry them."""
    return [
        (metric, layer)
        for metric in METRICS
        for layer in LAYERS
        if not (metric == "tx_value" and layer.startswith("contract_")) and not (metric == "total_gas_fees" and layer.endswith("_ERC20_only"))
    ]


def condition(layer: str | Column) -> Column:
    return F.expr(LAYERS.get(layer, layer)) if isinstance(layer, str) else layer


def in_layers(edges: DataFrame, layers: dict[str, str] | None = None) -> DataFrame:
    """One row per edge row and layer it belongs to, in a single pass over the edges."""
    layers = LAYERS if layers is None else layers
    names = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in layers.items())))
    return edges.withColumn("filter", F.explode(names))


def with_absent(edges: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns; absent measures become NULL."""
    return edges.select(*(F.col(c) if c in edges.columns else F.lit(None).cast("double").alias(c) for c in columns))


def alive(edges: DataFrame, dead: tuple[str, ...] = ("\\N",)) -> DataFrame:
    """Drop rows whose endpoint is NULL or one of the dead addresses."""
    ends = [F.col(c).isNotNull() & ~F.col(c).isin(*dead) for c in ("from_addr", "to_addr")]
    return edges.where(reduce(lambda a, b: a & b, ends))


def byte_band(mean_bytes: Column) -> Column:
    return F.when(mean_bytes < 100, "<100").when(mean_bytes < 500, "100-499").when(mean_bytes.isNotNull(), ">=500")


def repaired(weight: Column, least: float = 1e-6) -> Column:
    """Weights that are missing, NaN or not positive become ``least``."""
    return F.when(weight.isNull() | F.isnan(weight) | (weight <= 0), F.lit(least)).otherwise(weight)
