"""Readers and writers: tab-separated exports, JDBC, parquet layouts, run documents in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dates to diagrams: {date: {dimension: [[birth, death], ...]}}.
DIAGRAM_SERIES = "map<string,map<string,array<array<double>>>>"
RUN = (
    "num_edges bigint, num_nodes bigint, daily_edge_nums map<string,bigint>, daily_node_nums map<string,bigint>, "
    f"pd_series {DIAGRAM_SERIES}, distance_series map<string,double>, layer_names array<string>"
)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export with a header line; ``\\N`` is NULL."""
    return spark.read.schema(schema).options(sep="\t", header=True, nullValue="\\N", mode="FAILFAST").csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A remote SQL source, read in ``parts`` key ranges at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.options(header=True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_edges(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One file, a glob or a directory of edge files; only the wanted columns are read."""
    edges = spark.read.parquet(path)
    return edges.select(*columns) if columns else edges


def as_view(edges: DataFrame, name: str) -> DataFrame:
    edges.createOrReplaceTempView(name)
    return edges


def write_partitioned(rows: DataFrame, path: str, by: str = "date", mode: str = "overwrite") -> None:
    """One directory a value; with ``overwrite`` only the values in ``rows`` are replaced, so reruns are idempotent. Commits are atomic."""
    writer = rows.repartition(by).write.mode(mode).partitionBy(by)
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def write_ordered(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").parquet(path)


def require_layout(spark: SparkSession, *paths: str) -> None:
    """Fails unless every path exists and is not empty; works for any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        if fs.getFileStatus(p).isDirectory() and not len(fs.listStatus(p)):
            raise FileNotFoundError(f"{path} is empty")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents {run: {...}} as rows (run, document fields)."""
    whole = spark.read.text(path, wholetext=True)
    runs = whole.select(F.explode(F.from_json("value", T._parse_datatype_string(f"map<string,struct<{_fields(RUN)}>>"))).alias("run", "doc"))
    return runs.select("run", "doc.*")


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def series_of(runs: DataFrame, column: str = "distance_series") -> DataFrame:
    """series_id, date, value of a map of dates."""
    return runs.select(F.col("run").alias("series_id"), F.explode(column).alias("d", "value")).select("series_id", F.to_date("d").alias("date"), "value")


def diagrams_of(runs: DataFrame) -> DataFrame:
    """run, date, dgm: dimension keys are numbers again, points are structs."""
    days = runs.select("run", F.explode("pd_series").alias("d", "dims"))
    points = F.flatten(
        F.transform(
            F.map_entries("dims"),
            lambda e: F.transform(e["value"], lambda p: F.struct(e["key"].cast("int").alias("dim"), F.get(p, F.lit(0)).alias("birth"), F.get(p, F.lit(1)).alias("death"))),
        )
    )
    return days.select("run", F.to_date("d").alias("date"), points.alias("dgm"))


def as_map(key: Column, value: Column) -> Column:
    """Rows as one map, in key order; missing and non-finite values become null."""
    entries = F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v")))
    return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def diagram_map(dgm: Column) -> Column:
    """array of points -> {dimension: [[birth, death]]}."""
    def of(k: int) -> Column:
        return F.transform(F.filter(dgm, lambda p: p["dim"] == k), lambda p: F.array(p["birth"], p["death"]))

    return F.create_map(F.lit("0"), of(0), F.lit("1"), of(1))


def run_documents(diagrams: DataFrame, distances: DataFrame, counts: DataFrame) -> DataFrame:
    """run, document (JSON): the series of each run. Inputs are keyed by run and date."""
    d = diagrams.groupBy("run").agg(as_map(F.col("date"), diagram_map(F.col("dgm"))).alias("pd_series"))
    s = distances.groupBy("run").agg(as_map(F.col("date"), finite(F.col("value"))).alias("distance_series"))
    c = counts.groupBy("run").agg(F.sum("n_edges").alias("num_edges"), F.sum("n_nodes").alias("num_nodes"), as_map(F.col("date"), F.col("n_edges")).alias("daily_edge_nums"), as_map(F.col("date"), F.col("n_nodes")).alias("daily_node_nums"))
    rows = c.join(d, "run", "left").join(s, "run", "left")
    body = F.struct("num_edges", "num_nodes", "daily_edge_nums", "daily_node_nums", "pd_series", "distance_series")
    return rows.select("run", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def analysis_documents(flags: DataFrame, statistics: DataFrame) -> DataFrame:
    """series_id, document (JSON): periods with their statistics and the dates each method flags."""
    methods = flags.groupBy("series_id", "period_index", "method").agg(F.array_sort(F.collect_list(F.col("date").cast("string"))).alias("dates"))
    anomalies = methods.groupBy("series_id", "period_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.struct("dates", F.size("dates").alias("n")))))).alias("anomalies"))
    stats = F.struct(*(c for c in statistics.columns if c not in ("series_id", "period_index"))).alias("stats")
    joined = statistics.select("series_id", "period_index", stats).join(anomalies, ["series_id", "period_index"], "left")
    body = joined.groupBy("series_id").agg(F.collect_list(F.struct("period_index", "stats", "anomalies")).alias("p"))
    ordered = F.array_sort("p", lambda a, b: a["period_index"] - b["period_index"])
    return body.select("series_id", F.to_json(F.struct(ordered.alias("periods")), {"ignoreNullFields": "false"}).alias("document"))


def split_by_suffix(runs: DataFrame, buckets: dict[str, str], other: str = "other") -> DataFrame:
    """Run rows with the bucket that the end of their name selects; no row is lost."""
    bucket = F.coalesce(*(F.when(F.col("run").endswith(suffix), F.lit(name)) for suffix, name in buckets.items()), F.lit(other))
    return runs.withColumn("bucket", bucket)


def upsert(new: DataFrame, path: str, key: str = "run") -> None:
    """Replace the rows of the runs in ``new`` and keep all others: one directory a run."""
    write_partitioned(new, path, key)


def write_summary(rows: DataFrame, path: str) -> None:
    """A small table as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
