"""The driver's tables in the roles of this library's inputs. The same SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.operators import clean, cohort

#: Station readings from order lines: some values lie outside the physical limits on purpose.
READINGS = """SELECT l_returnflag AS city, CAST(l_shipdate AS DATE) AS date, l_linenumber AS hour_utc,
 l_extendedprice / 2503e0 AS tmax_c, l_extendedprice / 2503e0 - 16 AS tmin_c, l_extendedprice / 2503e0 - 2 AS temp_drybulb_c,
 l_extendedprice / 2503e0 - 9 AS dewpoint_c, l_extendedprice / 2503e0 - 8 AS dewpoint_max_c, l_extendedprice / 2503e0 - 11 AS dewpoint_min_c,
 l_quantity * 2 AS rh_pct, l_quantity * 2 + 2 AS rh_max_pct, l_quantity * 2 - 5 AS rh_min_pct,
 900 + l_quantity AS pressure_mbar, 1060 + l_quantity AS pressure_max_mbar, 845 + l_quantity AS pressure_min_mbar,
 l_extendedprice / 10e0 - 500 AS radiation_kj, l_tax * 100 + 0e0 AS wind_speed_ms, l_tax * 100 + l_quantity AS wind_gust_ms, l_discount * 100 + 0e0 AS precip_mm
FROM lineitem"""

#: A gappy daily series from orders.
SERIES = "SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 6.2831853e0 AS v, count(*) AS n_obs FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"

#: A cohort from customers and their orders.
COHORT = """SELECT o_custkey AS ext_genid, concat('wave', lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR(9)), 4, '0')) AS redcap_event_name,
 c_nationkey % 3 + 1 AS site, o_custkey % 2 AS gender, CAST(o_orderdate AS DATE) AS d_date,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 30) / 10e0 + (o_orderkey % 7) / 50e0 + 0.05 END AS age
FROM orders JOIN customer ON o_custkey = c_custkey"""

SITES = {1: "A", 2: "N", 3: "R"}
#: Windows in months, so that they fall within the series.
MONTH_WINDOWS = [("0_5", 0, 5), ("6_10", 6, 10), ("11_18", 11, 18)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    for n in names:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def readings(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, READINGS, "lineitem")


def daily(spark, sf_dir) -> DataFrame:
    return clean.hourly_to_daily(clean.range_qc(readings(spark, sf_dir)))


def full_daily(spark, sf_dir) -> DataFrame:
    return clean.clean_daily(daily(spark, sf_dir))


def series(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, SERIES, "orders")


def members(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, COHORT, "orders", "customer")


def births(spark, sf_dir) -> DataFrame:
    return cohort.derive_birth_dates(members(spark, sf_dir), SITES)


def windows(spark, sf_dir) -> DataFrame:
    return cohort.developmental_windows(births(spark, sf_dir), MONTH_WINDOWS, unit="month")


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded (and -0 made 0), or as they are without digits, whole numbers as longs."""
    kinds = dict(df.dtypes)
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" and digits is not None else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns
    ])
