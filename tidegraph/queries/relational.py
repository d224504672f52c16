"""Ingest, filters, ranks, restriction, trailing windows and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegraph.functions import layers as L
from tidegraph.functions import scalars
from tidegraph.operators import audit, ingest, ranking, validation
from tidegraph.plans import fetch
from tidegraph.queries.base import SHIP, USER_EDGES, canonical, query, rounded
from tidegraph.sources import edges as E

TOP, START, END = 2000, "2024-01-05", "2024-01-20"
BRANDS = {"brand#1": 6, "brand#2": 6, "brand#3": 8}

_layer_rows = " UNION ALL ".join(f"SELECT '{name}' AS filter, * FROM canon WHERE {rule.replace('<=>', 'IS NOT DISTINCT FROM')}" for name, rule in L.LAYERS.items())
LAYERED = f"{USER_EDGES}, layered AS ({_layer_rows})"
_sums = "round(coalesce(sum(tx_count), 0), 9) AS tx_count, round(coalesce(sum(tx_value), 0), 9) AS tx_value, round(coalesce(sum(total_gas_fees), 0), 9) AS total_gas_fees"
DAILY_SUMS = f"{LAYERED}, sums AS (SELECT filter, date, from_addr, to_addr, {_sums} FROM layered GROUP BY ALL)"
_scored = " UNION ALL ".join(f"SELECT filter, date, from_addr, to_addr, '{m}' AS ranking_metric, CAST({m} AS DOUBLE) AS score FROM sums WHERE filter = '{layer}'" for m, layer in L.valid_combinations())
RANKED = f"""{DAILY_SUMS}, scored AS ({_scored}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filter, ranking_metric, date ORDER BY score DESC, from_addr, to_addr) AS rank FROM scored) WHERE rank <= {TOP}),
ranks AS (SELECT address, filter, ranking_metric, CAST(min(rank) AS INTEGER) AS top_rank, CAST(max(rank) AS INTEGER) AS bottom_rank, date
  FROM (SELECT filter, ranking_metric, date, rank, unnest([from_addr, to_addr]) AS address FROM top) GROUP BY ALL)"""


def daily_ranks(spark, sf_dir):
    return ranking.daily_ranking(canonical(spark, sf_dir), TOP)


@query("s02_block_ranges", f"WITH {SHIP} SELECT block_date AS date, min(block_number) AS first_block, max(block_number) AS last_block FROM blk GROUP BY 1")
def block_ranges(spark, sf_dir):
    return E.block_ranges(E.ship_blocks(spark, sf_dir))


@query("s04_dedup_latest", f"WITH {SHIP} SELECT from_address, to_address, block_number, log_index, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY block_number ORDER BY log_index DESC, part DESC, to_address DESC) AS n FROM tx) WHERE n = 1")
def dedup(spark, sf_dir):
    t = E.ship_transactions(spark, sf_dir).withColumn("version", F.struct("log_index", "part", "to_address"))
    return rounded(E.deduplicated(t, ["block_number"], "version").select("from_address", "to_address", "block_number", "log_index", "value"))


@query("s06_key_ranges", "SELECT lo, least(lo + 999, 14999) AS hi FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 14999, 1000)) AS lo)")
def key_ranges(spark, sf_dir):
    return E.key_ranges(spark, 0, 14999, 1000)


NATIVE = f"""{SHIP}, native AS (
  SELECT date, from_address AS from_addr, to_address AS to_addr, min(t.block_number) AS start_block, max(t.block_number) AS end_block, count(*) AS tx_count,
         sum(value / 1e18) AS tx_value, max(value / 1e18) AS max_value, sum(gas_price) AS total_gas_price,
         sum(gas_used * CASE WHEN transaction_type = 2 THEN least(max_fee_per_gas, coalesce(base_fee_per_gas, 0) + max_priority_fee_per_gas) ELSE gas_price END) / 1e18 AS total_gas_fees,
         sum(n_input_nonzero_bytes) AS total_input_bytes, min(n_input_nonzero_bytes) AS min_input_bytes,
         count(*) FILTER (WHERE value = 0 AND n_input_nonzero_bytes > 200) AS factory_approx
  FROM tx t LEFT JOIN blk b ON t.block_number = b.block_number GROUP BY 1, 2, 3)"""
_native_out = "round(tx_value * 1e18, 4) AS tx_value, round(max_value * 1e18, 4) AS max_value, round(total_gas_price, 6) AS total_gas_price, round(total_gas_fees * 1e18, 4) AS total_gas_fees, total_input_bytes, min_input_bytes"


def _readable(df):
    return df.withColumns({"tx_value": F.round(F.col("tx_value") * 1e18, 4), "max_value": F.round(F.col("max_value") * 1e18, 4), "total_gas_price": F.round("total_gas_price", 6), "total_gas_fees": F.round(F.col("total_gas_fees") * 1e18, 4)})


@query("a01_native_edges", f"WITH {NATIVE} SELECT date, from_addr, to_addr, start_block, end_block, tx_count, {_native_out}, factory_approx FROM native")
def native_edges(spark, sf_dir):
    return _readable(ingest.native_edges(E.ship_transactions(spark, sf_dir), E.ship_blocks(spark, sf_dir)))


_decimals = " ".join(f"WHEN lower(p_brand) = '{k}' THEN {v}" for k, v in BRANDS.items())
TOKEN = f"""{SHIP}, token AS (
  SELECT date, from_address AS from_addr, to_address AS to_addr, p_brand AS erc20, min(block_number) AS start_block, max(block_number) AS end_block, count(*) AS tx_count,
         sum(value / pow(10.0, CASE {_decimals} ELSE 2 END)) AS tx_value, max(value / pow(10.0, CASE {_decimals} ELSE 2 END)) AS max_value
  FROM tx JOIN part ON part = p_partkey WHERE flag = 'R' GROUP BY 1, 2, 3, 4)"""


def token(spark, sf_dir):
    return ingest.token_edges(E.ship_transfers(spark, sf_dir), BRANDS, 2)


@query("a02_token_edges", f"WITH {TOKEN} SELECT date, from_addr, to_addr, erc20, start_block, end_block, tx_count, round(tx_value, 6) AS tx_value, round(max_value, 6) AS max_value FROM token")
def token_edges(spark, sf_dir):
    return rounded(token(spark, sf_dir))


@query("a03_weekly_native", f"WITH {NATIVE} SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week, from_addr, to_addr, min(start_block) AS start_block, max(end_block) AS end_block, CAST(sum(tx_count) AS BIGINT) AS tx_count, round(sum(tx_value) * 1e18, 4) AS tx_value, min(min_input_bytes) AS min_input_bytes, CAST(sum(factory_approx) AS BIGINT) AS factory_approx FROM native GROUP BY 1, 2, 3, 4")
def weekly_native(spark, sf_dir):
    daily = ingest.native_edges(E.ship_transactions(spark, sf_dir), E.ship_blocks(spark, sf_dir))
    weekly = ingest.rolled_up(ingest.with_weeks(daily), ["iso_year", "iso_week", "from_addr", "to_addr"])
    return weekly.withColumn("tx_value", F.round(F.col("tx_value") * 1e18, 4)).select("iso_year", "iso_week", "from_addr", "to_addr", "start_block", "end_block", "tx_count", "tx_value", "min_input_bytes", "factory_approx")


@query("a04_weekly_token", f"WITH {TOKEN} SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week, from_addr, to_addr, erc20, min(start_block) AS start_block, max(end_block) AS end_block, CAST(sum(tx_count) AS BIGINT) AS tx_count, round(sum(tx_value), 6) AS tx_value, round(max(max_value), 6) AS max_value FROM token GROUP BY 1, 2, 3, 4, 5")
def weekly_token(spark, sf_dir):
    return rounded(ingest.rolled_up(ingest.with_weeks(token(spark, sf_dir)), ["iso_year", "iso_week", "from_addr", "to_addr", "erc20"]))


@query("a05_week_groups", f"WITH {SHIP}, d AS (SELECT DISTINCT date FROM tx) SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS days, min(date) AS first_day, arg_min(strftime(date, '%Y-%m') || '_W' || CAST((day(date) - 1) // 7 + 1 AS VARCHAR), date) AS week_label FROM d GROUP BY 1, 2")
def week_groups(spark, sf_dir):
    return ingest.week_groups(E.ship_transactions(spark, sf_dir))


@query("x9_week_labels", f"WITH {SHIP}, d AS (SELECT DISTINCT date, strftime(date, '%Y-%m') || '_W' || CAST((day(date) - 1) // 7 + 1 AS VARCHAR) AS label FROM tx) SELECT label, CAST(date_trunc('month', min(date)) + INTERVAL (((day(min(date)) - 1) // 7) * 7) DAY AS DATE) AS first_day, CAST(least(date_trunc('month', min(date)) + INTERVAL (((day(min(date)) - 1) // 7) * 7 + 6) DAY, last_day(min(date))) AS DATE) AS last_day FROM d GROUP BY label")
def week_labels(spark, sf_dir):
    labels = E.ship_transactions(spark, sf_dir).select(scalars.week_of_month(F.col("date")).alias("label")).distinct()
    first, last = scalars.week_range(F.col("label"))
    return labels.select("label", first.alias("first_day"), last.alias("last_day"))


@query("s11_unified_scan", f"""WITH {USER_EDGES}, u AS (SELECT * FROM canon WHERE date BETWEEN '{START}' AND '{END}' AND from_addr NOT IN ('u1', '\\N') AND to_addr NOT IN ('u1', '\\N'))
SELECT date, erc20, count(*) AS n, round(sum(tx_value), 6) AS tx_value, count(total_input_bytes) AS n_with_bytes, min(from_addr) AS first_from, max(to_addr) AS last_to FROM u GROUP BY 1, 2""")
def unified_scan(spark, sf_dir):
    every = E.user_edges(spark, sf_dir)
    native = every.where("erc20 = 'ETH'").drop("erc20")
    transfers = every.where("erc20 <> 'ETH'").drop("total_gas_fees", "total_input_bytes")
    u = E.unified(native, transfers, START, END, ("u1", "\\N"))
    return rounded(u.groupBy("date", "erc20").agg(F.count("*").alias("n"), F.sum("tx_value").alias("tx_value"), F.count("total_input_bytes").alias("n_with_bytes"), F.min("from_addr").alias("first_from"), F.max("to_addr").alias("last_to")))


@query("f01_layers", f"WITH {LAYERED} SELECT filter, date, count(*) AS n, round(sum(tx_value), 6) AS tx_value FROM layered GROUP BY 1, 2")
def layer_rows(spark, sf_dir):
    return rounded(L.in_layers(canonical(spark, sf_dir)).groupBy("filter", "date").agg(F.count("*").alias("n"), F.sum("tx_value").alias("tx_value")))


@query("f02_token_layers", f"WITH {USER_EDGES} SELECT upper(erc20) AS filter, count(*) AS n FROM canon WHERE erc20 <> 'ETH' GROUP BY 1")
def token_layers(spark, sf_dir):
    rules = L.token_layers({f"0XTOK{i}": f"0xTOK{i}" for i in range(3)})
    return L.in_layers(canonical(spark, sf_dir), rules).groupBy("filter").agg(F.count("*").alias("n"))


@query("f06_keep_columns", f"WITH {USER_EDGES} SELECT date, from_addr, to_addr, CAST(sum(tx_count) AS BIGINT) AS tx_count, CAST(0.0 AS DOUBLE) AS absent FROM canon WHERE tx_value = 0 AND erc20 = 'ETH' GROUP BY 1, 2, 3")
def keep_columns(spark, sf_dir):
    rows = canonical(spark, sf_dir).where(L.condition("contract_txs_ETH_only"))
    return ingest.pair_sums(L.with_absent(rows, ["date", "from_addr", "to_addr", "tx_count", "absent"]), ["date", "from_addr", "to_addr"], ["tx_count", "absent"]).withColumn("absent", F.col("absent").cast("double"))


@query("f13_weight_repair", f"WITH {USER_EDGES} SELECT date, from_addr, to_addr, round(sum(CASE WHEN total_gas_fees IS NULL OR total_gas_fees <= 0 THEN 1e-6 ELSE total_gas_fees END), 8) AS weight FROM canon GROUP BY 1, 2, 3")
def weight_repair(spark, sf_dir):
    rows = canonical(spark, sf_dir).withColumn("w", L.repaired(F.col("total_gas_fees")))
    return rounded(rows.groupBy("date", "from_addr", "to_addr").agg(F.sum("w").alias("weight")), 8)


@query("a06_layer_sums", f"WITH {DAILY_SUMS} SELECT filter, date, from_addr, to_addr, CAST(tx_count AS BIGINT) AS tx_count, round(tx_value, 6) AS tx_value, round(total_gas_fees, 6) AS total_gas_fees FROM sums")
def layer_sums(spark, sf_dir):
    s = ranking.layer_sums(canonical(spark, sf_dir), ["date"])
    return rounded(s.withColumn("tx_count", F.col("tx_count").cast("bigint")))


@query("a07_period_sums", f"WITH {USER_EDGES} SELECT from_addr, to_addr, CAST(sum(tx_count) AS BIGINT) AS tx_count, round(sum(tx_value), 6) AS tx_value FROM canon GROUP BY 1, 2")
def period_sums(spark, sf_dir):
    return rounded(ingest.pair_sums(canonical(spark, sf_dir), ["from_addr", "to_addr"], ["tx_count", "tx_value"]))


@query("k01_daily_ranking", f"WITH {RANKED} SELECT * FROM ranks")
def daily_ranking(spark, sf_dir):
    return daily_ranks(spark, sf_dir)


@query("k01_single_layer", f"WITH {RANKED} SELECT * FROM ranks WHERE filter = 'contract_nonFactory_ETH_only' AND ranking_metric = 'tx_count'")
def single_layer(spark, sf_dir):
    """The flagship: one layer, one metric."""
    rules, wanted = ranking.single_layer("contract_nonFactory_ETH_only", "tx_count")
    return ranking.daily_ranking(canonical(spark, sf_dir), TOP, rules, wanted)


_gscored = _scored.replace("date, ", "")
GLOBAL = f"""{LAYERED}, sums AS (SELECT filter, from_addr, to_addr, {_sums} FROM layered WHERE date BETWEEN '{START}' AND '{END}' GROUP BY ALL), scored AS ({_gscored}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filter, ranking_metric ORDER BY score DESC, from_addr, to_addr) AS rank FROM scored) WHERE rank <= {TOP}),
granks AS (SELECT address, filter, ranking_metric, CAST(min(rank) AS INTEGER) AS top_rank, CAST(max(rank) AS INTEGER) AS bottom_rank, DATE '{START}' AS start_date, DATE '{END}' AS end_date
  FROM (SELECT filter, ranking_metric, rank, unnest([from_addr, to_addr]) AS address FROM top) GROUP BY ALL)"""


@query("r02_global_ranking", f"WITH {GLOBAL} SELECT * FROM granks")
def global_ranking(spark, sf_dir):
    return ranking.global_ranking(canonical(spark, sf_dir), TOP, START, END)


@query("j07_resume", f"WITH {RANKED} SELECT filter, ranking_metric, date, count(*) AS n FROM ranks WHERE date > '{START}' GROUP BY 1, 2, 3")
def resume(spark, sf_dir):
    ranks = daily_ranks(spark, sf_dir)
    done = ranks.where(F.col("date") <= F.lit(START).cast("date"))
    return ranking.not_yet(ranks, done).groupBy("filter", "ranking_metric", "date").agg(F.count("*").alias("n"))


LAYER = "simple_txs_ALL"
_of_layer = f"filter = '{LAYER}' AND ranking_metric = 'tx_value'"


@query("f08_rank_ceiling", f"WITH {RANKED} SELECT DISTINCT date, address FROM ranks WHERE {_of_layer} AND bottom_rank <= 20")
def rank_ceiling(spark, sf_dir):
    return ranking.chosen_nodes(daily_ranks(spark, sf_dir), [LAYER], "tx_value", 20)


@query("f09_rank_band", f"WITH {RANKED} SELECT DISTINCT date, address FROM ranks WHERE {_of_layer} AND top_rank > 10 AND top_rank <= 30")
def rank_band(spark, sf_dir):
    return ranking.chosen_nodes(daily_ranks(spark, sf_dir), [LAYER], "tx_value", (10, 30), "top_rank")


_edges_out = "date, from_addr, to_addr, CAST(sum(tx_count) AS BIGINT) AS tx_count, round(sum(tx_value), 6) AS tx_value"


@query("t01_restricted_edges", f"""WITH {RANKED}, g AS (SELECT from_addr, to_addr, sum(tx_value) AS v, row_number() OVER (ORDER BY round(sum(tx_value), 9) DESC, from_addr, to_addr) AS rank FROM canon WHERE tx_value > 0 GROUP BY 1, 2),
nodes AS (SELECT DISTINCT date, address FROM ranks WHERE {_of_layer} AND bottom_rank <= 40 UNION SELECT DISTINCT c.date, a.address FROM (SELECT unnest([from_addr, to_addr]) AS address FROM g WHERE rank <= 5) a, (SELECT DISTINCT date FROM canon) c)
SELECT {_edges_out} FROM canon c WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.date = c.date AND n.address = c.from_addr) AND EXISTS (SELECT 1 FROM nodes n WHERE n.date = c.date AND n.address = c.to_addr) GROUP BY 1, 2, 3""")
def restricted_edges(spark, sf_dir):
    edges = canonical(spark, sf_dir)
    nodes = ranking.chosen_nodes(daily_ranks(spark, sf_dir), [LAYER], "tx_value", 40)
    rules, wanted = ranking.single_layer(LAYER, "tx_value")
    lasting = ranking.global_ranking(edges, 5, "2024-01-01", "2024-12-31", rules, wanted).select("address").distinct()
    return rounded(ingest.pair_sums(ranking.restricted(edges, nodes, lasting), ["date", "from_addr", "to_addr"], ["tx_count", "tx_value"]))


TRAILING = f"""{USER_EDGES}, trail AS (
  SELECT c.date, e.from_addr, e.to_addr, CAST(sum(e.tx_count) AS BIGINT) AS trailing_sum
  FROM (SELECT DISTINCT date FROM edges) c JOIN edges e ON e.date BETWEEN c.date - INTERVAL 6 DAY AND c.date GROUP BY 1, 2, 3)"""


@query("w14_trailing_sums", f"WITH {TRAILING} SELECT * FROM trail")
def trailing_sums(spark, sf_dir):
    return ranking.trailing_sums(E.user_edges(spark, sf_dir))


@query("w14_trailing_edges", f"""WITH {TRAILING}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY trailing_sum DESC, from_addr, to_addr) AS r FROM trail) WHERE r <= 750),
q AS (SELECT DISTINCT date, unnest([from_addr, to_addr]) AS address FROM top)
SELECT date, from_addr, to_addr, CAST(sum(tx_count) AS BIGINT) AS tx_count FROM edges e WHERE EXISTS (SELECT 1 FROM q WHERE q.date = e.date AND q.address = e.from_addr) AND EXISTS (SELECT 1 FROM q WHERE q.date = e.date AND q.address = e.to_addr) GROUP BY 1, 2, 3""")
def trailing_edges(spark, sf_dir):
    return ingest.pair_sums(ranking.trailing_edges(E.user_edges(spark, sf_dir), 750), ["date", "from_addr", "to_addr"], ["tx_count"])


@query("a11_daily_counts", f"WITH {USER_EDGES} SELECT date, n_edges, n_nodes FROM (SELECT date, count(*) AS n_edges FROM canon GROUP BY 1) JOIN (SELECT date, count(DISTINCT address) AS n_nodes FROM (SELECT date, unnest([from_addr, to_addr]) AS address FROM canon) GROUP BY 1) USING (date)")
def daily_counts(spark, sf_dir):
    return ingest.daily_counts(canonical(spark, sf_dir))


@query("a17_coverage", f"WITH {RANKED} SELECT filter, ranking_metric, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, count(DISTINCT address) AS n_addresses FROM ranks GROUP BY 1, 2")
def coverage(spark, sf_dir):
    return ranking.coverage(daily_ranks(spark, sf_dir))


@query("a18_value_counts", f"WITH {USER_EDGES} SELECT from_addr, count(*) AS n FROM canon GROUP BY 1 ORDER BY n DESC, from_addr LIMIT 15")
def value_counts(spark, sf_dir):
    return audit.value_counts(canonical(spark, sf_dir), "from_addr")


_q = ", ".join(f"round(quantile_cont(total_input_bytes, {p}), 6) AS p{round(100 * p):02d}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


@query("a19_described", f"WITH {USER_EDGES} SELECT date, count(total_input_bytes) AS n, round(avg(total_input_bytes), 6) AS mean, round(stddev_samp(total_input_bytes), 6) AS std, min(total_input_bytes) AS min, max(total_input_bytes) AS max, {_q} FROM canon GROUP BY 1")
def described(spark, sf_dir):
    return rounded(audit.described(canonical(spark, sf_dir), "total_input_bytes", by=["date"]))


@query("a20_fractions", f"WITH {USER_EDGES} SELECT erc20, round(avg(CASE WHEN total_input_bytes >= 100 THEN 1.0 ELSE 0.0 END), 6) AS factory, round(avg(CASE WHEN tx_value > 0 THEN 1.0 ELSE 0.0 END), 6) AS simple FROM canon GROUP BY 1")
def fractions(spark, sf_dir):
    return rounded(canonical(spark, sf_dir).groupBy("erc20").agg(audit.fraction(F.col("total_input_bytes") >= 100).alias("factory"), audit.fraction(F.col("tx_value") > 0).alias("simple")))


@query("a21_histogram", f"WITH {USER_EDGES} SELECT CAST(least(floor(total_input_bytes / 20), 29) AS INTEGER) AS bin, count(*) AS n FROM canon WHERE total_input_bytes BETWEEN 0 AND 600 GROUP BY 1")
def histogram(spark, sf_dir):
    return audit.histogram(canonical(spark, sf_dir), "total_input_bytes", 20, 0, 600)


_points = [0.01 * (1000 / 0.01) ** (i / 39) for i in range(40)]
_bin = " + ".join(f"CASE WHEN tx_value >= {p!r} THEN 1 ELSE 0 END" for p in _points[1:])


@query("a22_log_histogram", f"WITH {USER_EDGES} SELECT CAST(least({_bin}, 38) AS INTEGER) AS bin, count(*) AS n FROM canon WHERE tx_value >= 0.01 AND tx_value <= 1000 GROUP BY 1")
def log_histogram(spark, sf_dir):
    return audit.log_histogram(canonical(spark, sf_dir), "tx_value", 0.01, 1000)


@query("a23_binned", f"""WITH {USER_EDGES}, m AS (SELECT total_input_bytes, CAST(round(total_gas_fees * 1000) AS BIGINT) AS fees FROM canon)
SELECT CAST(ceil(total_input_bytes / 25) - 1 AS INTEGER) AS bin, round(CAST(sum(fees) AS DOUBLE) / count(fees), 6) AS mean, round(median(fees), 6) AS median, count(fees) AS n FROM m WHERE total_input_bytes > 0 GROUP BY 1""")
def binned(spark, sf_dir):
    """Fees in whole thousandths, so that no order of addition matters."""
    rows = canonical(spark, sf_dir).withColumn("fees", F.round(F.col("total_gas_fees") * 1000).cast("bigint"))
    return rounded(audit.right_closed_bins(rows, "total_input_bytes", "fees", 25))


@query("a24_correlation", f"WITH {USER_EDGES} SELECT round(corr(total_input_bytes, tx_value), 6) AS corr, count(*) AS n FROM canon")
def correlation(spark, sf_dir):
    return rounded(audit.correlation(canonical(spark, sf_dir), "total_input_bytes", "tx_value"))


_bands = "CASE WHEN total_input_bytes < 100 THEN '<100' WHEN total_input_bytes < 500 THEN '100-499' WHEN total_input_bytes IS NOT NULL THEN '>=500' END"


@query("a25_cramers_v", f"""WITH {USER_EDGES}, x AS (SELECT date, {_bands} AS a, CASE WHEN tx_value > 0 THEN 'simple' ELSE 'contract' END AS b FROM canon WHERE total_input_bytes IS NOT NULL),
n AS (SELECT date, count(*) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM x GROUP BY 1),
r AS (SELECT date, a, count(*) AS r FROM x GROUP BY 1, 2), c AS (SELECT date, b, count(*) AS c FROM x GROUP BY 1, 2), o AS (SELECT date, a, b, count(*) AS o FROM x GROUP BY 1, 2, 3),
chi AS (SELECT r.date, sum(pow(coalesce(o, 0) - r * c * 1.0 / n, 2) / (r * c * 1.0 / n)) AS chi FROM r JOIN c ON r.date = c.date JOIN n ON n.date = r.date LEFT JOIN o ON o.date = r.date AND o.a = r.a AND o.b = c.b GROUP BY 1)
SELECT date, n, round(CASE WHEN k > 0 AND n > 1 THEN sqrt(chi / (n * k)) END, 6) AS cramers_v FROM chi JOIN n USING (date)""")
def cramers(spark, sf_dir):
    x = canonical(spark, sf_dir).select("date", L.byte_band(F.col("total_input_bytes")).alias("a"), F.when(F.col("tx_value") > 0, "simple").otherwise("contract").alias("b"))
    return rounded(audit.cramers_v(x, "a", "b", ["date"]))


@query("a27_votes", f"WITH {RANKED} SELECT date, address, count(*) AS n_votes FROM ranks WHERE top_rank <= 5 GROUP BY 1, 2 HAVING count(*) >= 4")
def votes(spark, sf_dir):
    return audit.votes(daily_ranks(spark, sf_dir).where("top_rank <= 5"), 4, ("date", "address"))


@query("a30_size_entropy", f"WITH {USER_EDGES}, s AS (SELECT date, from_addr, count(*) AS size FROM canon GROUP BY 1, 2), t AS (SELECT date, sum(size) AS t FROM s GROUP BY 1) SELECT date, round(-sum(size / t * ln(size / t + 1e-12)), 6) AS entropy FROM s JOIN t USING (date) GROUP BY 1")
def size_entropy(spark, sf_dir):
    sizes = canonical(spark, sf_dir).groupBy("date", "from_addr").agg(F.count("*").alias("size"))
    return rounded(audit.entropy_of_sizes(sizes, ["date"], "size"))


@query("a31_progress", f"WITH {RANKED} SELECT filter, count(*) AS n_rows, count(DISTINCT date) AS n_keys, CAST(0 AS BIGINT) AS n_missing FROM ranks GROUP BY 1")
def progress(spark, sf_dir):
    return audit.progress(daily_ranks(spark, sf_dir), ["filter"], ["date"])


def _overlap(a: str, b: str, empty: str) -> str:
    return f"""WITH {USER_EDGES}, m AS (SELECT date, address, max(CASE WHEN {a} THEN 1 ELSE 0 END) AS a, max(CASE WHEN {b} THEN 1 ELSE 0 END) AS b FROM (SELECT *, unnest([from_addr, to_addr]) AS address FROM canon) GROUP BY 1, 2),
s AS (SELECT date, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both, CAST(sum(greatest(a, b)) AS BIGINT) AS n_any FROM m GROUP BY 1)
SELECT date, n_a, n_b, n_both, round(CASE WHEN n_any > 0 THEN n_both / n_any ELSE {empty} END, 6) AS jaccard, round(CASE WHEN n_a > 0 THEN n_both / n_a ELSE {empty} END, 6) AS share_of_a, round(CASE WHEN n_b > 0 THEN n_both / n_b ELSE {empty} END, 6) AS share_of_b FROM s"""


@query("a32_dual_activity", "SELECT date, n_a AS n_simple_nodes, n_b AS n_contract_nodes, n_both AS n_dual_active, jaccard AS dual_active_jaccard, share_of_a AS dual_active_frac_of_simple, share_of_b AS dual_active_frac_of_contract FROM (" + _overlap("tx_value > 0", "tx_value = 0", "0.0") + ")")
def dual(spark, sf_dir):
    return rounded(audit.dual_activity(canonical(spark, sf_dir)))


@query("o03_layer_overlap", _overlap("total_input_bytes >= 500", "erc20 <> 'ETH'", "NULL"))
def overlap(spark, sf_dir):
    m = audit.membership(canonical(spark, sf_dir), {"a": "total_input_bytes >= 500", "b": "erc20 <> 'ETH'"})
    return rounded(audit.overlap(m, "a", "b", None))


@query("o04_done_or_missing", f"WITH {USER_EDGES} SELECT DISTINCT from_addr AS address FROM canon EXCEPT SELECT DISTINCT to_addr FROM canon")
def difference(spark, sf_dir):
    c = canonical(spark, sf_dir)
    return c.select(F.col("from_addr").alias("address")).subtract(c.select("to_addr"))


@query("o05_first_of_day", f"WITH {USER_EDGES} SELECT date, from_addr, to_addr FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY from_addr, to_addr) AS n FROM canon) WHERE n = 1")
def first_of_day(spark, sf_dir):
    pairs = canonical(spark, sf_dir).groupBy("date").agg(F.min(F.struct("from_addr", "to_addr")).alias("p"))
    return pairs.select("date", "p.*")


@query("f18_sampled_weeks", f"WITH {SHIP} SELECT date, count(*) AS n FROM tx WHERE month(date) IN (1, 3, 5, 7, 9, 11) AND day(date) <= 7 GROUP BY 1")
def sampled(spark, sf_dir):
    return E.ship_transactions(spark, sf_dir).where(F.month("date").isin(1, 3, 5, 7, 9, 11) & (F.dayofmonth("date") <= 7)).groupBy("date").agg(F.count("*").alias("n"))


@query("a09_two_attributes", f"WITH {USER_EDGES} SELECT date, from_addr, to_addr, CAST(sum(tx_count) AS BIGINT) AS tx_count, CAST(coalesce(sum(total_input_bytes), 0) AS BIGINT) AS total_input_bytes FROM canon GROUP BY 1, 2, 3")
def two_attributes(spark, sf_dir):
    return ingest.pair_sums(canonical(spark, sf_dir), ["date", "from_addr", "to_addr"], ["tx_count", "total_input_bytes"])


@query("f15_j12_selectors", """WITH s AS (SELECT substr(p_name, 1, 10) AS selector, count(*) AS n FROM part WHERE length(substr(p_name, 1, 10)) = 10 GROUP BY 1), names AS (SELECT DISTINCT substr(p_name, 1, 10) AS selector, upper(substr(p_name, 1, 10)) AS name FROM part WHERE p_name LIKE '%widget')
SELECT selector, n, name FROM s LEFT JOIN names USING (selector)""")
def selectors(spark, sf_dir):
    """Ten-character selectors with the names that a dimension table knows."""
    part = E.table(spark, sf_dir, "part").select(F.substring("p_name", 1, 10).alias("selector"), "p_name")
    counts = part.where(F.length("selector") == 10).groupBy("selector").agg(F.count("*").alias("n"))
    names = part.where(F.col("p_name").endswith("widget")).select("selector", F.upper("selector").alias("name")).distinct()
    return counts.join(names, "selector", "left")


@query("f16_first_dates", f"WITH {USER_EDGES} SELECT address, min(date) AS first_date, count(DISTINCT date) AS n_dates FROM (SELECT date, unnest([from_addr, to_addr]) AS address FROM canon) GROUP BY 1")
def first_dates(spark, sf_dir):
    return ingest.endpoints(canonical(spark, sf_dir), "date").groupBy("address").agg(F.min("date").alias("first_date"), F.count_distinct("date").alias("n_dates"))


@query("u01_day_median_layer", f"WITH {USER_EDGES}, m AS (SELECT *, median(tx_value) OVER (PARTITION BY date) AS m FROM canon WHERE tx_value > 0) SELECT date, count(*) AS n, round(sum(tx_value), 6) AS tx_value FROM m WHERE tx_value > m GROUP BY 1")
def day_median(spark, sf_dir):
    """A user's own filter that needs the whole day's median."""
    own = F.col("tx_value") > F.percentile("tx_value", F.lit(0.5)).over(Window.partitionBy("date"))
    rows = canonical(spark, sf_dir).where("tx_value > 0").withColumn("keep", own).where("keep")
    return rounded(rows.groupBy("date").agg(F.count("*").alias("n"), F.sum("tx_value").alias("tx_value")))


@query("o06_later_wins", f"WITH {USER_EDGES}, d AS (SELECT date, 1 AS version, count(*) AS n FROM canon GROUP BY 1 UNION ALL SELECT date, 2, CAST(sum(tx_count) * 10 AS BIGINT) FROM canon WHERE day(date) % 2 = 0 GROUP BY 1) SELECT date, arg_max(n, version) AS n FROM d GROUP BY 1")
def later_wins(spark, sf_dir):
    c = canonical(spark, sf_dir)
    first = c.groupBy("date").agg(F.count("*").alias("n")).withColumn("version", F.lit(1))
    second = c.where(F.dayofmonth("date") % 2 == 0).groupBy("date").agg((F.sum("tx_count") * 10).alias("n")).withColumn("version", F.lit(2))
    return E.deduplicated(first.unionByName(second), ["date"], "version").select("date", "n")


@query("r07_pending_ranges", f"""WITH {SHIP}, b AS (SELECT min(block_number) AS lo, max(block_number) AS hi FROM tx), r AS (SELECT unnest(generate_series(lo, hi, 1000)) AS lo, hi AS top FROM b), ranges AS (SELECT lo, least(lo + 999, top) AS hi FROM r),
done AS (SELECT lo FROM ranges WHERE lo // 1000 % 3 = 0)
SELECT r.lo, r.hi, count(*) AS n_transactions, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM ranges r JOIN tx ON block_number BETWEEN r.lo AND r.hi WHERE r.lo NOT IN (SELECT lo FROM done) GROUP BY 1, 2""")
def pending_ranges(spark, sf_dir):
    """Ranges of blocks that an earlier run has not fetched, with what they hold; every third one counts as fetched."""
    tx = E.ship_transactions(spark, sf_dir)
    low, high = tx.agg(F.min("block_number"), F.max("block_number")).first()
    ranges = E.key_ranges(spark, low, high, 1000)
    left = fetch.pending(ranges, ranges.where(F.floor(F.col("lo") / 1000) % 3 == 0))
    return fetch.rows_of(tx, left, "block_number", low, 1000).groupBy("lo", "hi").agg(F.count("*").alias("n_transactions"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("j11_common_predictions", f"""WITH {USER_EDGES}, p AS (SELECT date, CASE WHEN tx_value > 0 THEN 'paid' WHEN total_input_bytes > 300 THEN 'large' ELSE 'other' END AS arm, from_addr, sum(tx_count) AS n FROM canon GROUP BY ALL),
k AS (SELECT date, from_addr FROM p GROUP BY 1, 2 HAVING count(DISTINCT arm) = 3) SELECT date, from_addr, arm, CAST(n AS BIGINT) AS n FROM p JOIN k USING (date, from_addr)""")
def common_predictions(spark, sf_dir):
    """Rows whose key every arm has: what several models can be compared on."""
    arm = F.when(F.col("tx_value") > 0, "paid").when(F.col("total_input_bytes") > 300, "large").otherwise("other")
    rows = canonical(spark, sf_dir).groupBy("date", arm.alias("arm"), "from_addr").agg(F.sum("tx_count").alias("n"))
    return validation.in_every_arm(rows, ["date", "from_addr"], "arm").select("date", "from_addr", "arm", "n")
