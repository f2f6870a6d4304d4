"""Summaries of the example tables as series: the step from large data to results tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def means_in_order(df: DataFrame, keys: list[str], value: str, places: int) -> DataFrame:
    """Rounded means (v) of the groups of a table as it was read, each added up row after row as files and their rows stand: where the exact
    mean lies halfway, the last bit decides, and that of sums by split would change with the splits."""
    df = df.select(*keys, value, F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_mean", F.avg(value).over(upto)).groupBy(*keys).agg(F.round(F.max_by("_mean", "_at"), places).alias("v"))


def series(df: DataFrame, table: str, axis: str, fixed: Column, x: Column, value: Column, label: Column | None = None) -> DataFrame:
    """Grouped rows of a summary as series rows."""
    return df.select(F.lit(table).alias("table_id"), F.lit(axis).alias("axis"), fixed.cast("string").alias("fixed_key"), x.cast("double").alias("x"), (label if label is not None else x.cast("string")).alias("x_lab"), F.lit(0).cast("long").alias("row_id"), value.cast("double").alias("value"))


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", month.alias("m")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return series(g, "monthly_revenue", "month", F.col("l_returnflag"), F.col("m"), F.col("v"))


MONTHLY = "SELECT l_returnflag AS k, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS DOUBLE) AS x, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2"


def quantity_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.round(F.avg("l_extendedprice"), 3).alias("v"))
    return series(g, "quantity_price", "quantity", F.col("l_returnflag"), F.col("l_quantity"), F.col("v"))


QUANTITY = "SELECT l_returnflag AS k, CAST(l_quantity AS DOUBLE) AS x, round(avg(l_extendedprice), 3) AS v FROM lineitem GROUP BY 1, 2"


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day by type; the last ten days count threefold, so that there is a shift to find."""
    day = F.dayofmonth("ts")
    g = read(spark, sf_dir, "events").groupBy("event_type", day.alias("d")).agg(F.count("*").alias("c"))
    return series(g, "daily_events", "day", F.col("event_type"), F.col("d"), F.col("c") * F.when(F.col("d") > 20, 3).otherwise(1))


DAILY = "SELECT event_type AS k, CAST(day(ts) AS DOUBLE) AS x, CAST(count(*) * CASE WHEN day(ts) > 20 THEN 3 ELSE 1 END AS DOUBLE) AS v FROM events GROUP BY event_type, day(ts)"


def cumulative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = read(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("c"))
    g = g.withColumn("v", F.sum("c").over(Window.partitionBy("event_type").orderBy("d")))
    return series(g, "cumulative_events", "day", F.col("event_type"), F.col("d"), F.col("v"))


CUMULATIVE = "SELECT k, x, CAST(sum(c) OVER (PARTITION BY k ORDER BY x) AS DOUBLE) AS v FROM (SELECT event_type AS k, CAST(day(ts) AS DOUBLE) AS x, count(*) AS c FROM events GROUP BY 1, 2)"


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by type for each brand; one in 97 cells has its point misplaced, so that there are outliers to find."""
    g = read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("v"), F.min("p_partkey").alias("k"))
    v = F.when(F.col("k") % 7 == 0, F.col("v") * 100).otherwise(F.col("v"))
    x = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("double")
    return series(g, "brand_prices", "brand", F.col("p_type"), x, v, F.col("p_brand"))


BRANDS = r"SELECT p_type AS k, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS DOUBLE) AS x, p_brand AS lab, CASE WHEN min(p_partkey) % 7 = 0 THEN round(sum(p_retailprice), 2) * 100 ELSE round(sum(p_retailprice), 2) END AS v FROM part GROUP BY p_type, p_brand"
