"""Panels: one row for each (date, code) with open, high, low, close, volume and amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQUIRED = ["date", "code", "open", "high", "low", "close", "volume", "amount"]
#: Other names of key columns, whatever their case.
ALIASES = {"symbol": "code", "order_book_id": "code", "trade_date": "date", "datetime": "date", "instrument": "code", "total_turnover": "amount"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_panel_names(df: DataFrame) -> DataFrame:
    """Known other names become the panel's; a name that is there already is left alone."""
    have = {c.lower() for c in df.columns}
    return df.withColumnsRenamed({c: ALIASES[c.lower()] for c in df.columns if c.lower() in ALIASES and ALIASES[c.lower()] not in have})


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    """Raises before any job if columns are missing."""
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def normalize(raw: DataFrame, order: str | None = None) -> DataFrame:
    """A clean panel from a raw table: known names, numbers where they can be read, NaN and infinities
    as NULL, rows without a key dropped, of rows with one key the last by ``order`` kept, vwap added."""
    df = with_panel_names(raw)
    check_columns(df, REQUIRED)
    number = lambda c: F.when(~F.isnan(v := F.expr(f"try_cast({c} AS DOUBLE)")) & (F.abs(v) < 1.7e308), v)
    df = df.withColumns({"date": F.expr("try_cast(date AS DATE)"), "code": F.col("code").cast("string"), **{c: number(c) for c in REQUIRED[2:]}}).filter("date IS NOT NULL AND code IS NOT NULL")
    if order:
        last = Window.partitionBy("date", "code").orderBy(F.col(order).desc())
        df = df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return df.withColumn("vwap", F.try_divide("amount", F.when(F.col("volume") != 0, F.col("volume"))))


def _brand_number() -> Column:
    return F.regexp_extract("code", r"(\d+)", 1).cast("int")


def classified(panel: DataFrame) -> DataFrame:
    """Groups and a size for panels that have none: by the number in the code."""
    k = _brand_number()
    named = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    return panel.withColumns({"sector": named("sector", 3), "industry": named("industry", 4), "subindustry": named("sub", 5), "cap": F.col("close") * (80e6 + 12e6 * (k % 10))})


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of part brands by week, out of order lines: prices are line prices by the piece."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumns({"px": F.try_divide("l_extendedprice", "l_quantity"), "place": F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")})
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  sums that don't depend on the order
    panel = own.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("p_brand").alias("code")).agg(
        F.min_by("px", "place").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "place").alias("close"), exact("l_quantity").alias("volume"), exact("l_extendedprice").alias("amount")
    )
    return classified(panel)


def supplier_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of suppliers by week: its codes grow with the tables, about as many as there are thousands of order lines over six."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    own = lines.withColumns({"px": F.try_divide("l_extendedprice", "l_quantity"), "place": F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")})
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    panel = own.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code")).agg(
        F.min_by("px", "place").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "place").alias("close"), exact("l_quantity").alias("volume"), exact("l_extendedprice").alias("amount")
    )
    return classified(panel)


#: The same panel of brands in SQL, as a table expression named ``panel``.
BRAND_WEEK_SQL = """
  SELECT *, 'sector' || CAST(k % 3 AS VARCHAR) AS sector, 'industry' || CAST(k % 4 AS VARCHAR) AS industry, 'sub' || CAST(k % 5 AS VARCHAR) AS subindustry, close * (80e6 + 12e6 * (k % 10)) AS cap
  FROM (SELECT date, code, open, high, low, close, volume, amount, CAST(regexp_extract(code, '([0-9]+)', 1) AS INTEGER) AS k
    FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS code,
        first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open, max(px) AS high, min(px) AS low,
        last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
      FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS px FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2))
"""
