"""Operators on small tables: decisions on ties, bounds, missing values, sources and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import layers, scalars
from tidegraph.operators import ingest, ranking, topology
from tidegraph.operators import series as S
from tidegraph.sources import documents
from tidegraph.sources import edges as E
from tidegraph.streaming import trailing

DAY = dt.date(2020, 1, 1)


def edges(spark, rows):
    schema = "date date, from_addr string, to_addr string, erc20 string, tx_count bigint, tx_value double, total_gas_fees double, total_input_bytes bigint"
    return spark.createDataFrame([(DAY, a, b, t, n, v, None, k) for a, b, t, n, v, k in rows], schema)


def test_combinations():
    assert len(layers.LAYERS) == 14 and len(layers.valid_combinations()) == 29


def test_missing_bytes_match_no_band(spark):
    e = edges(spark, [("a", "b", "tok", 1, 0.0, None), ("a", "c", None, 1, 0.0, 700)])
    got = {(r["to_addr"], r["filter"]) for r in layers.in_layers(e).collect()}
    assert ("b", "contract_txs_ALL") in got and not any(t == "b" and "Input" in f for t, f in got)
    assert ("c", "contract_txs_ERC20_only") in got and ("c", "contract_highInput_ALL") in got


def test_dead_and_null_ends(spark):
    e = edges(spark, [("a", None, "ETH", 1, 1.0, 1), ("\\N", "b", "ETH", 1, 1.0, 1), ("a", "b", "ETH", 1, 1.0, 1)])
    assert layers.alive(e).count() == 1


def test_hub_is_excluded_by_its_worst_edge(spark):
    e = edges(spark, [("hub", "x", "ETH", 10, 1.0, 1), ("m", "n", "ETH", 7, 1.0, 1), ("hub", "y", "ETH", 5, 1.0, 1)])
    rules, wanted = ranking.single_layer("simple_txs_ALL", "tx_count")
    ranks = ranking.daily_ranking(e, 3, rules, wanted)

    def nodes(column):
        return {r["address"] for r in ranking.chosen_nodes(ranks, ["simple_txs_ALL"], "tx_count", 2, column).collect()}

    assert "hub" not in nodes("bottom_rank") and "hub" in nodes("top_rank")
    assert "y" not in nodes("top_rank")


def test_top_edges_of_a_day(spark):
    rows = [(a, b, "ETH", n, 1.0, 1) for a, b, n in (("a", "x", 10), ("b", "y", 5), ("c", "z", 100), ("d", "w", 1), ("e", "v", 50))]
    rules, wanted = ranking.single_layer("simple_txs_ALL", "tx_count")
    ranks = ranking.daily_ranking(edges(spark, rows), 3, rules, wanted)
    assert {r["address"] for r in ranks.collect()} == {"a", "c", "e", "v", "x", "z"}


def test_trailing_pair_without_edge(spark):
    schema = "date date, from_addr string, to_addr string, tx_count bigint"
    e = spark.createDataFrame([(DAY, "a", "b", 9), (DAY + dt.timedelta(3), "c", "d", 1)], schema)
    sums = {(r["date"].day, r["from_addr"]): r["trailing_sum"] for r in ranking.trailing_sums(e).collect()}
    assert sums == {(1, "a"): 9, (4, "a"): 9, (4, "c"): 1}
    assert {(r["date"].day, r["from_addr"]) for r in ranking.trailing_edges(e, 1).collect()} == {(1, "a")}


def test_range_join_is_not_a_product(spark):
    e = spark.createDataFrame([(DAY, "a", "b", 9)], "date date, from_addr string, to_addr string, tx_count bigint")
    plan = ranking.trailing_edges(e)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_restriction_needs_both_ends(spark):
    e = edges(spark, [("a", "b", "ETH", 1, 1.0, 1), ("a", "c", "ETH", 1, 1.0, 1)])
    daily = spark.createDataFrame([(DAY, "a")], "date date, address string")
    lasting = spark.createDataFrame([("b",)], "address string")
    assert [r["to_addr"] for r in ranking.restricted(e, daily, lasting).collect()] == ["b"]
    assert ranking.restricted(e, daily).count() == 0


def test_fee_and_units(spark):
    row = spark.range(1).select(
        scalars.fee(*(F.lit(x) for x in (2.0, 2, 5.0, 1.0)), F.lit(None).cast("double"), F.lit(9.0)).alias("dynamic"),
        scalars.fee(*(F.lit(x) for x in (2.0, 0, 5.0, 1.0, 3.0, 9.0))).alias("fixed"),
        scalars.decimals(F.lit("0xDAC17F958D2EE523A2206206994597C13D831EC7")).alias("six"),
        scalars.decimals(F.lit("other")).alias("default"),
    ).first()
    assert tuple(row) == (2.0, 18.0, 6, 18)


def test_t_quantile():
    assert scalars.t_quantile(1 - 0.05 / 60, 28) == pytest.approx(3.478588, abs=1e-5)
    assert scalars.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert scalars.t_quantile(0.5, 3) == 0 and scalars.t_quantile(0.025, 10) == pytest.approx(-2.228139, abs=1e-6)


def test_period_edge_is_in_both(spark):
    s = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d)) for d in range(1, 6)], "series_id string, date date, value double")
    p = spark.createDataFrame([(0, dt.date(2020, 1, 1), dt.date(2020, 1, 3)), (1, dt.date(2020, 1, 3), dt.date(2020, 1, 5))], "period_index int, start date, end date")
    assert S.in_periods(s, p).count() == 6


def test_short_autocorrelation(spark):
    s = spark.createDataFrame([("a", dt.date(2020, 1, d), v) for d, v in enumerate((1.0, 3.0, 2.0, 2.0, 4.0), 1)], "series_id string, date date, value double")
    got = [r["x"] for r in s.withColumn("x", S.short_autocorrelation(F.col("value"))).orderBy("date").collect()]
    assert got == [None, None, -1.0, None, None]


def test_empty_tables(spark):
    none = edges(spark, []).limit(0)
    assert ranking.daily_ranking(none, 5).count() == 0 and ranking.trailing_edges(none).count() == 0
    assert ingest.daily_counts(none).count() == 0


def test_unified_turns_nan_to_null(spark):
    native = spark.createDataFrame([(DAY, "b", "a", float("nan"))], "date date, from_addr string, to_addr string, tx_value double")
    token = spark.createDataFrame([], "date date, from_addr string, to_addr string, erc20 string, tx_value double")
    row = E.unified(native, token).first()
    assert row["tx_value"] is None and (row["from_addr"], row["to_addr"], row["erc20"]) == ("a", "b", "ETH")


def test_key_ranges(spark):
    assert [tuple(r) for r in E.key_ranges(spark, 5, 12, 5).collect()] == [(5, 9), (10, 12)]
    assert E.key_ranges(spark, 3, 2, 5).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "x.tsv").write_text("a\tb\n1\t\\N\n")
    assert [tuple(r) for r in documents.read_tsv(spark, f"{path}/x.tsv", "a int, b string").collect()] == [(1, None)]
    rows = spark.createDataFrame([(DAY, "a", 1), (DAY + dt.timedelta(1), "b", 2)], "date date, k string, v int")
    documents.write_partitioned(rows, f"{path}/p")
    documents.write_partitioned(rows.where("k = 'b'").withColumn("v", F.lit(7)), f"{path}/p")
    assert sorted((r["k"], r["v"]) for r in documents.read_edges(spark, f"{path}/p", ["k", "v"]).collect()) == [("a", 1), ("b", 7)]
    documents.require_layout(spark, f"{path}/p")
    with pytest.raises(FileNotFoundError):
        documents.require_layout(spark, f"{path}/absent")
    documents.write_summary(rows, f"{path}/csv")
    assert documents.read_csv(spark, f"{path}/csv").count() == 2
    documents.write_ordered(rows, f"{path}/o", "date")
    documents.write_json(rows.withColumn("v", F.lit(None).cast("int")), f"{path}/j")
    assert documents.as_view(documents.read_edges(spark, f"{path}/o"), "ordered").count() == spark.sql("SELECT * FROM ordered").count() == 2
    assert '"v":null' in spark.read.text(f"{path}/j").first()[0]
    for value in (1, 2):
        documents.upsert(spark.createDataFrame([(f"r{value}", value)], "run string, x int"), f"{path}/u")
    documents.upsert(spark.createDataFrame([("r1", 9)], "run string, x int"), f"{path}/u")
    assert sorted((r["run"], r["x"]) for r in spark.read.parquet(f"{path}/u").collect()) == [("r1", 9), ("r2", 2)]
    (tmp_path / "runs.json").write_text('{"a": {"num_edges": 3, "distance_series": {"2020-01-02": 0.5, "2020-01-01": null}}}')
    series = documents.series_of(documents.read_runs(spark, f"{path}/runs.json")).orderBy("date").collect()
    assert [(r["series_id"], r["date"].day, r["value"]) for r in series] == [("a", 1, None), ("a", 2, 0.5)]
    runs = spark.createDataFrame([("x_ETH",), ("y_ALL",), ("z",)], "run string")
    assert {tuple(r) for r in documents.split_by_suffix(runs, {"_ETH": "eth", "_ALL": "all"}).collect()} == {("x_ETH", "eth"), ("y_ALL", "all"), ("z", "other")}


def test_documents_round_trip(spark):
    points = "array<struct<dim:int,birth:double,death:double>>"
    d = spark.createDataFrame([("r", DAY, [(0, 0.0, 0.5), (1, 0.5, 1.0)])], f"run string, date date, dgm {points}")
    s = spark.createDataFrame([("r", DAY, float("nan"))], "run string, date date, value double")
    c = spark.createDataFrame([("r", DAY, 3, 4)], "run string, date date, n_edges bigint, n_nodes bigint")
    docs = documents.run_documents(d, s, c)
    body = json.loads(docs.first()["document"])
    assert body["distance_series"] == {"2020-01-01": None} and body["pd_series"]["2020-01-01"] == {"0": [[0.0, 0.5]], "1": [[0.5, 1.0]]}
    parsed = docs.select("run", F.from_json("document", documents.RUN).alias("d")).select("run", "d.*")
    assert [tuple(p) for p in documents.diagrams_of(parsed).first()["dgm"]] == [(0, 0.0, 0.5), (1, 0.5, 1.0)]


def test_placeholder_counts_only_when_asked(spark):
    d = spark.createDataFrame([(1, [(0, 0.0, 0.5)])], "k int, dgm array<struct<dim:int,birth:double,death:double>>")
    assert topology.daily_features(d).first()["H1_num_loops"] == 0
    assert topology.daily_features(d, compat=True).first()["H1_num_loops"] == 1


def test_streamed_days_match_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 12), "a", "b") for d in (1, 1, 2, 5)] + [(dt.datetime(2024, 2, 1), "z", "z")]
    schema = "ts timestamp, from_addr string, to_addr string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for f, name in ((trailing.daily_pairs, "daily"), (trailing.trailing_pairs, "trailing")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    daily = {(r["date"].isoformat(), r["from_addr"]): r["tx_count"] for r in spark.table("daily").collect()}
    assert daily[("2024-01-01", "a")] == 2 and daily[("2024-01-05", "a")] == 1
    sums = {(r["date"].isoformat(), r["from_addr"]): r["trailing_sum"] for r in spark.table("trailing").collect()}
    assert sums[("2024-01-05", "a")] == 4 and sums[("2024-01-07", "a")] == 4 and sums[("2024-01-08", "a")] == 2


def test_point_clouds_of_any_size(spark):
    """A label of more than 400 points has all its components and its loops."""
    import numpy as np

    n = 401
    x = np.random.default_rng(1).normal(size=(n, 64))
    rows = [(1, i, p.tolist()) for i, p in enumerate(x)] + [(2, 0, [0.0, 0.0]), (2, 1, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "label int, key int, embedding array<double>")
    got = {r["label"]: r for r in topology.daily_features(topology.point_cloud_diagrams(vectors, "label", "embedding")).collect()}
    assert (got[1]["n_points"], got[1]["H0_num_components"]) == (n, n - 1)
    # the spanning tree once more, grown from one point
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near, out, total = d[0].copy(), np.arange(n) > 0, 0.0
    while out.any():
        i = int(np.where(out, near, np.inf).argmin())
        total += near[i]
        out[i] = False
        near = np.minimum(near, d[i])
    assert got[1]["H0_total_persistence"] == pytest.approx(total / d.max(), rel=1e-6)
    assert got[1]["H1_num_loops"] > 0 and got[1]["H1_max_persistence"] > 0
    assert got[2]["H0_num_components"] == 1


def test_components_of_a_long_path(spark):
    """A path of hundreds of nodes, and a ring, settle in few rounds."""
    from tidegraph.operators import graphs

    rows = [("d", f"n{i:03d}", f"n{i + 1:03d}") for i in range(300)] + [("d", f"r{i:02d}", f"r{(i + 1) % 50:02d}") for i in range(50)] + [("e", "n000", "z")]
    got = {(r["date"], r["address"]): r["component"] for r in graphs.connected_components(spark.createDataFrame(rows, "date string, a string, b string"), ["date"]).collect()}
    assert {v for (d, k), v in got.items() if d == "d" and k[0] == "n"} == {"n000"} and len(got) == 353
    assert {v for (d, k), v in got.items() if k[0] == "r"} == {"r00"} and got["e", "z"] == "n000"


def test_time_limit_of_a_day(spark):
    from tidegraph.operators import curvature

    rows = [("d", f"n{i}", f"n{(i * 7 + 1) % 40}", float(i % 3 + 1)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "date string, a string, b string, weight double")
    late = curvature.daily_curvature(pairs, ["date"], seconds=0.0).first()
    assert late["status"] == "timeout" and late["curvature_mean"] is None and late["n_edges"] > 0
    fine = curvature.daily_curvature(pairs, ["date"], seconds=600.0).first()
    assert fine["status"] == "ok" and fine["curvature_mean"] == curvature.daily_curvature(pairs, ["date"]).first()["curvature_mean"]


def test_fetch_goes_on_where_it_stopped(spark, tmp_path):
    from tidegraph.plans import fetch
    from tidegraph.sources.edges import key_ranges

    source = spark.createDataFrame([(i, i % 3) for i in range(100)], "block_number bigint, value int")
    ranges, path = key_ranges(spark, 0, 99, 10), str(tmp_path / "edges")
    sums = lambda rows: rows.groupBy("lo", "hi").agg(F.sum("value").alias("value"))
    assert fetch.fetch(source, ranges.where("lo < 40"), "block_number", 0, 10, path, sums) == 4
    assert fetch.fetch(source, ranges, "block_number", 0, 10, path, sums) == 6
    assert fetch.fetch(source, ranges, "block_number", 0, 10, path, sums) == 0
    assert spark.read.parquet(path).agg(F.sum("value"), F.count("*")).first() == (99, 10)


def plain_bootstrap(rows, metric, n_boot, seed=42):
    """One generator, one resample after another, over the sorted rows."""
    import numpy as np

    a, b, y = np.array(sorted((a, b, y) for y, a, b in rows), float).T
    rng, out = np.random.default_rng(seed), []
    for _ in range(n_boot):
        i = rng.integers(0, len(y), len(y))
        try:
            out.append(metric(y[i], b[i]) - metric(y[i], a[i]))
        except ValueError:
            continue
    d = np.array(out)
    return (metric(y, b) - metric(y, a), *np.percentile(d, [2.5, 97.5]), min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean())), len(d))


def test_bootstrap_is_one_stream_however_it_is_dealt(spark):
    import numpy as np

    from tidegraph.operators import validation

    def error(y, score):
        return float(((y - score) ** 2).mean())

    r = np.random.default_rng(3)
    groups = {"p": 1001, None: 340, "few": 4}
    rows = [(g, int(y), float(a), float(b)) for g, n in groups.items() for y, a, b in zip(r.integers(0, 2, n) if n > 4 else (1, 0, 0, 0), r.integers(0, 9, n), r.integers(0, 40, n))]
    table = spark.createDataFrame(rows, "g string, y int, a double, b double")
    for metric in (validation.auc_of, error):
        for work in (1 << 27, 7000):
            got = {x["g"]: tuple(x)[1:] for x in validation.paired_bootstrap(table, "y", "a", "b", metric, n_boot=60, by=["g"], work=work).collect()}
            assert got == {g: plain_bootstrap([x[1:] for x in rows if x[0] == g], metric, 60) for g in groups}
    assert got["p"][-1] == 60 and len(got) == 3
    assert plain_bootstrap([x[1:] for x in rows if x[0] == "few"], validation.auc_of, 60)[-1] < 60


@pytest.mark.parametrize("n", [1, 3, 1000003, 2**31 + 5, 2**32, 2**32 + 9])
def test_draws_from_any_place(n):
    """Words that numpy rejects, nearly half of them at the fourth size, shift what follows."""
    import itertools

    import numpy as np

    from tidegraph.operators import validation

    want = np.random.default_rng(5).integers(0, n, 600000)
    assert (np.concatenate(list(itertools.islice(validation.draws(5, n), 12)))[:600000] == want).all()
    if n <= 2**32:
        first = 299999
        lost = first - sum(len(validation.drawn(w, n)) for w in validation.words(5, 0, first))
        assert (lost > 100000) == (n == 2**31 + 5)
        assert (np.concatenate(list(itertools.islice(validation.draws(5, n, first, lost), 4)))[:50] == want[first : first + 50]).all()


def test_bootstrap_of_many_equal_rows(spark):
    """Before, each of the resamples sorted all rows, in one task."""
    import time

    from tidegraph.operators import validation

    table = spark.range(600000).select((F.col("id") % 7 < 3).cast("int").alias("y"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 70 / 7).alias("b"))
    began = time.monotonic()
    got = validation.paired_bootstrap(table, "y", "a", "b", n_boot=300).first()
    assert time.monotonic() - began < 25 and got["n_valid"] == 300 and got["ci_low"] < got["observed_diff"] < got["ci_high"]
