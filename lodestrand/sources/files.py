"""Readers and writers of the panel's outside world: CSV, ZIP, JSON, Parquet folders, databases, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrand.sources.panel import check_columns, with_panel_names

PANEL_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("code", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")]])


def read_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, codes: list[str] | None = None) -> DataFrame:
    """A Parquet panel; ranges and codes become filters that the scan itself applies."""
    df = with_panel_names(spark.read.parquet(path))
    check_columns(df, PANEL_SCHEMA.fieldNames())
    for test in ([F.col("date") >= F.lit(start)] if start else []) + ([F.col("date") <= F.lit(end)] if end else []) + ([F.col("code").isin(codes)] if codes else []):
        df = df.filter(test)
    return df


def read_values_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded factor values: (date, code, value, extra), where extra is JSON of all other columns.
    Rows without a key or a readable value are left out."""
    df = with_panel_names(spark.read.option("header", True).csv(path))
    check_columns(df, ["date", "code"])
    value = next((c for c in df.columns if c in ("value", "factor_value")), next(c for c in df.columns if c not in ("date", "code")))
    extra = [c for c in df.columns if c not in ("date", "code", value)]
    packed = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    out = df.select(F.expr("try_cast(date AS DATE)").alias("date"), "code", F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("value"), packed.alias("extra"))
    return out.filter("date IS NOT NULL AND code IS NOT NULL AND value IS NOT NULL")


def read_parts(spark: SparkSession, pattern: str, required: list[str]) -> DataFrame:
    """All Parquet files that a pattern matches, with ``source``, the file of each row. A file that lacks a required column raises before any
    job reads rows: footers alone are merged."""
    df = spark.read.option("mergeSchema", True).parquet(pattern)
    check_columns(df, required)
    return df.withColumn("source", F.input_file_name())


def read_zip_csv(spark: SparkSession, path: str, keyword: str, columns: list[str]) -> DataFrame:
    """(archive, member, the columns as strings) of all CSV members of ZIP archives whose names have the keyword, in UTF-8 with or without
    a byte order mark. An archive is one task's; its members are read line by line. A column that a member lacks is NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("archive", "member", *columns)])

    def run(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        arrow = pa.schema([(f.name, pa.string()) for f in schema])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if keyword in m and m.lower().endswith(".csv")):
                        with io.TextIOWrapper(z.open(member), "utf-8-sig", newline="") as text:
                            rows = []
                            for row in csv.DictReader(text):
                                rows.append((name, member, *(row.get(c) for c in columns)))
                                if len(rows) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=arrow)
                                    rows = []
                            if rows:
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database table in ``parts`` reads by ranges of an integer key, each streamed; filters and columns go down to the database. A read that
    fails is a task that Spark tries again."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


def read_pages(spark: SparkSession, fetch, schema: str | T.StructType, total: int, size: int = 1000) -> DataFrame:
    """A paged interface as a table: ``fetch(offset, size)`` gives a list of dictionaries, fewer than ``size`` on the last page. Pages are read
    in parallel by tasks, ``total`` rows at most are known of; each row is read once, missing fields are NULL."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = kind.fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = fetch(number * size, size)
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

    pages = -(-total // size)
    return spark.range(0, pages, 1, max(1, min(pages, 200))).mapInArrow(run, kind)


def first_of(*readers) -> DataFrame:
    """What the first of some readers gives that doesn't fail; the last one's error if all do. Readers are called without arguments."""
    for k, read in enumerate(readers):
        try:
            return read()
        except Exception:
            if k == len(readers) - 1:
                raise
    raise ValueError("no readers")


def refresh(old: DataFrame, incoming: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """An incremental load: rows of ``incoming`` later than the old table's last date, merged by key. The last date stays in the plan."""
    last = old.agg(F.max(date_col).alias("_last"))
    new = incoming.join(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(date_col) > F.col("_last"))).drop("_last")
    return merge_unique(old, new.dropDuplicates(keys), keys)


def renamed(df: DataFrame, names: dict[str, str], dates: tuple[str, ...] = ()) -> DataFrame:
    """A full load under the library's names: columns renamed, dates as dates, columns that aren't named left out."""
    own = df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])
    return own.withColumns({c: F.expr(f"coalesce(try_cast({c} AS DATE), try_to_date(CAST({c} AS STRING), 'yyyyMMdd'))") for c in dates})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a small report, in its own order, as a Markdown table."""
    head = df.columns
    body = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body])


def read_nav_json(spark: SparkSession, path: str) -> DataFrame:
    """(date, nav) from JSON documents with a nav_history list."""
    schema = "nav_history array<struct<date: string, nav: double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("nav_history").alias("p")).select(F.to_date("p.date").alias("date"), "p.nav")


def read_signals_json(spark: SparkSession, path: str) -> DataFrame:
    """(date, symbol, weight, action) from signal files keyed by date."""
    schema = "signals map<string, array<struct<symbol: string, weight: double, action: string>>>"
    days = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("signals").alias("date", "own"))
    return days.select(F.to_date("date").alias("date"), F.explode("own").alias("s")).select("date", "s.symbol", "s.weight", "s.action")


def merge_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, of equal keys the new one's; the new one's own repeats should be gone already."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col("_n").desc())
    return both.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_n", "_k")


def write_values(df: DataFrame, path: str) -> None:
    """Factor values, a folder for each family and factor, so that one factor is read alone."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("factor_family", "factor_name").parquet(path)


def manifest(df: DataFrame, date_col: str = "date") -> dict:
    """Rows, columns and last date of a dataset, from one aggregate."""
    n, last = df.agg(F.count("*"), F.max(date_col)).first()
    return {"rows": n, "columns": df.columns, "last_date": str(last) if last else None}
