"""The warehouse of factor values: normalizing, merging, publishing, catalogs, readiness, lifecycle; and symbols.

A change of a table gives the new table: written over, it is the mutation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.plans.layers import rounded


def canonical(symbol: Column) -> Column:
    """A code with the suffix .SH, .SZ or .BJ, whatever way the exchange was written."""
    s = F.upper(F.trim(symbol))
    return (
        F.when(s.endswith(".XSHG"), F.concat(F.substring_index(s, ".", 1), F.lit(".SH"))).when(s.endswith(".XSHE"), F.concat(F.substring_index(s, ".", 1), F.lit(".SZ"))).when(s.rlike(r"^(SHSE|SH)\."), F.concat(F.substring_index(s, ".", -1), F.lit(".SH")))
        .when(s.rlike(r"^(SZSE|SZ)\."), F.concat(F.substring_index(s, ".", -1), F.lit(".SZ"))).when(s.contains("."), s).when(s.startswith("6"), F.concat(s, F.lit(".SH"))).when(s.rlike("^[48]"), F.concat(s, F.lit(".BJ"))).otherwise(F.concat(s, F.lit(".SZ")))
    )


def spellings(symbol: Column) -> Column:
    """The five ways in which sources write a canonical symbol."""
    code, place = F.substring_index(symbol, ".", 1), F.substring_index(symbol, ".", -1)
    long = F.when(place == "SH", "XSHG").when(place == "SZ", "XSHE").otherwise(place)
    back = F.when(place == "SH", "SHSE").when(place == "SZ", "SZSE").otherwise(place)
    return F.array(symbol, F.concat_ws(".", code, long), F.concat_ws(".", back, code), F.concat(F.lower(place), code), code)


def in_universe(frame: DataFrame, members: DataFrame | None, column: str = "symbol") -> DataFrame:
    """The rows of ``frame`` whose symbol is one of the members' (symbol, canonical) in any spelling; None is the whole market."""
    if members is None:
        return frame
    every = members.select(F.explode(spellings(F.col("symbol"))).alias(column)).distinct()
    return frame.join(every, column, "left_semi")


def listed_stocks(stocks: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Stocks (code, name) of the main boards that are neither under special treatment, delisting nor new; a seeded sample of them if asked for."""
    own = stocks.filter(~F.col("code").rlike("^[89]") & ~F.upper("name").rlike(r"ST|退|^N|^C"))
    return own if sample is None else own.orderBy(F.xxhash64("code", F.lit(seed)), "code").limit(sample)


def covered_universe(panel: DataFrame, least: float = 0.95, most: int | None = None) -> DataFrame:
    """(code, days) of codes that are there on ``least`` of all dates, the first ``most`` by code."""
    total = panel.agg(F.count_distinct("date").alias("total"))
    own = panel.groupBy("code").agg(F.count_distinct("date").alias("days")).join(F.broadcast(total)).filter(F.col("days") >= F.ceil(F.col("total") * least)).select("code", "days")
    return own if most is None else own.orderBy("code").limit(most)


def panel_quality(panel: DataFrame, required: Sequence[str], least: float = 0.5, idle: float = 0.2) -> DataFrame:
    """One row: counts, dates, the least coverage of a required column, and status: failed (empty, duplicate keys, low coverage, dates before 2005,
    high under low), warning (too many rows without volume) or passed."""
    rows = panel.agg(
        F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.when(F.col("high") < F.col("low"), 1)).alias("crossed"),
        F.count(F.when(F.coalesce("volume", F.lit(0.0)) <= 0, 1)).alias("idle"), F.least(*[F.count(c) for c in required]).alias("filled"),
    )
    keys = panel.groupBy("date", "code").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0)).alias("duplicates"))
    told = rows.join(F.broadcast(keys)).withColumns({"coverage": F.try_divide("filled", "n"), "idle": F.try_divide("idle", "n")})
    failed = (F.col("n") == 0) | (F.col("duplicates") > 0) | (F.col("coverage") < least) | (F.year("first_date") < 2005) | (F.col("crossed") > 0)
    status = F.when(failed, "failed").when(F.col("idle") > idle, "warning").otherwise("passed")
    return told.select("n", "codes", "dates", "first_date", "last_date", "crossed", "duplicates", rounded(F.col("idle"), 6).alias("idle"), rounded(F.col("coverage"), 6).alias("coverage"), status.alias("status"))


def freshness(panel: DataFrame, today: Column, least: int = 3000, lag: int = 7) -> DataFrame:
    """One row: the last date, how many codes it has, whether those are enough, and whether it is recent. Two aggregates, no window."""
    days = panel.groupBy("date").agg(F.count_distinct("code").alias("codes"))
    last = days.agg(F.max("date").alias("last_date"), F.max_by("codes", "date").alias("codes"))
    return last.select("last_date", "codes", (F.col("codes") >= least).alias("enough"), (F.datediff(today, F.col("last_date")) <= lag).alias("recent"))


def as_of(left: DataFrame, left_date: str, snapshots: DataFrame, date: str = "date") -> DataFrame:
    """``left`` with ``snap``, the latest date of ``snapshots`` up to its own, however long ago; NULL before the first. Dates of both
    sides are put in one order, a row a date; the rest is an equal join."""
    own = left.withColumn("_d", F.col(left_date).cast("date"))
    marks = snapshots.select(F.col(date).alias("_d")).distinct().withColumn("snap", F.col("_d")).unionByName(own.select("_d").distinct().withColumn("snap", F.lit(None).cast("date")))
    marks = marks.filter("_d IS NOT NULL").groupBy("_d").agg(F.max("snap").alias("snap"))
    told = marks.select("_d", F.last("snap", ignorenulls=True).over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)).alias("snap"))
    return own.join(told, "_d", "left").drop("_d")


def adjusted(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """``prices`` (date, code, close) with close_adj: over the last factor (date, code, factor) of the code, 1 for a code without any."""
    last = factors.filter("factor IS NOT NULL").groupBy("code").agg(F.max_by("factor", "date").alias("factor"))
    return prices.join(last, "code", "left").withColumn("close_adj", F.try_divide("close", F.coalesce("factor", F.lit(1.0)))).drop("factor")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that fails while it runs if a key is there twice on a side."""
    def once(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        checked = df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} side has a key twice")).cast("long")).otherwise(F.col("_n")))
        return checked.filter("_n = 1").drop("_n")

    return once(left, "left").join(once(right, "right"), list(keys))


def outer_filled(left: DataFrame, right: DataFrame, keys: Sequence[str], value=0) -> DataFrame:
    """A full outer join with what is missing filled."""
    return left.join(right, list(keys), "outer").fillna(value)


def one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two frames of a row each, or none, side by side: a row if either has one."""
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k", "outer").drop("_k")


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


VALUE_KEYS = ("family", "factor", "value_type", "symbol", "trade_date", "version")


def normalized_values(staging: DataFrame) -> DataFrame:
    """Staged values with clean names, of equal keys the last loaded, without missing values."""
    clean = staging.withColumns({c: F.lower(F.trim(c)) for c in ("family", "factor")}).withColumn("symbol", F.trim("symbol"))
    return keep_last(clean.filter("value IS NOT NULL"), VALUE_KEYS, "load_seq").drop("load_seq")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables' rows, of equal keys the new one's; a column that the new row doesn't have keeps its old value."""
    kept = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_there"))
    joined = old.withColumn("_old", F.lit(True)).join(fresh, list(keys), "outer")
    value = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if f"_new_{c}" in fresh.columns else F.col(c)
    return joined.select(*keys, *[value(c).alias(c) for c in kept])


def batch_status(batches: DataFrame, results: DataFrame) -> DataFrame:
    """``batches`` (batch, status) with the status of their ``results`` (batch, rows, error): failed with an error, published with rows, else empty."""
    told = results.groupBy("batch").agg(F.max("error").alias("error"), F.sum("rows").alias("rows"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("rows") > 0, "published").when(F.col("rows") == 0, "empty").otherwise(F.col("status"))
    return batches.join(told, "batch", "left").select("batch", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "error")


def published(values: DataFrame, order: Sequence[str] = ("truth", "submitted", "reproduced", "research")) -> DataFrame:
    """(family, factor, value_type, version, n): the values of each factor that are shown, by kind in ``order`` and then the latest version."""
    n = values.groupBy("family", "factor", "value_type", "version").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("value_type"))
    best = Window.partitionBy("family", "factor").orderBy(F.when(place > 0, place).otherwise(len(order) + 1), F.desc("version"))
    return n.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def truth_backfill(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """``rows`` (id, library, truth_status) in which a factor of a library that needs truth is "not_compared" where it said "not_applicable", and changed."""
    wrong = (F.col("truth_status") == "not_applicable") & F.lower("library").isin([x.lower() for x in required])
    return rows.withColumns({"changed": F.coalesce(wrong, F.lit(False)), "truth_status": F.when(wrong, "not_compared").otherwise(F.col("truth_status"))})


def merged_catalog(sources: Sequence[DataFrame]) -> DataFrame:
    """All definitions (library, name, ...) of the sources; of equal (library, name) that of the last source."""
    every = [s.withColumn("_seq", F.lit(k)) for k, s in enumerate(sources)]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return keep_last(out, ["library", "name"], "_seq").drop("_seq")


def natural(name: str) -> list[Column]:
    """What to order a name by so that alpha9 comes before alpha10: its letters, its number, itself."""
    return [F.regexp_extract(name, r"^\D*", 0), F.expr(f"try_cast(regexp_extract({name}, '([0-9]+)', 1) AS BIGINT)").asc_nulls_first(), F.col(name)]


def latest(reports: DataFrame, key: str = "factor", time: str = "created") -> DataFrame:
    """The last report of each key."""
    return reports.groupBy(key).agg(F.max_by(F.struct(*[c for c in reports.columns if c != key]), time).alias("r")).select(key, "r.*")


@dataclass(frozen=True)
class Dataset:
    """What readiness asks of a dataset. freshness: "present", "data_version" (as late as the version) or "max_age_days"."""

    name: str
    columns: tuple[str, ...]
    date: str | None = None
    freshness: str = "present"
    max_age: int = 0
    required: bool = True


def readiness(frames: Mapping[str, DataFrame], specs: Sequence[Dataset], version_source: str) -> DataFrame:
    """(dataset, required, rows, max_date, errors, status) of every dataset; the version is the last date of ``version_source``. One aggregate a
    dataset; missing columns and missing datasets are errors and read nothing."""
    first = next(iter(frames.values()))
    spark = first.sparkSession
    out = None
    for spec in specs:
        df = frames.get(spec.name)
        missing = [] if df is None else sorted(set(spec.columns) - set(df.columns))
        if df is None or spec.date and spec.date not in df.columns:
            one = spark.range(1).select(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("date").alias("max_date"))
        else:
            one = df.agg(F.count("*").alias("rows"), (F.max(spec.date).cast("date") if spec.date else F.lit(None).cast("date")).alias("max_date"))
        told = "missing dataset" if df is None else f"missing columns: {', '.join(missing)}" if missing else None
        one = one.select(F.lit(spec.name).alias("dataset"), F.lit(spec.required).alias("required"), "rows", "max_date", F.lit(told).cast("string").alias("schema_error"), F.lit(spec.freshness).alias("freshness"), F.lit(spec.max_age).alias("max_age"))
        out = one if out is None else out.unionByName(one)
    version = out.filter(F.col("dataset") == version_source).select(F.col("max_date").alias("version"))
    told = out.join(F.broadcast(version), how="left")
    age = F.datediff("version", "max_date")
    late = F.when((F.col("freshness") == "data_version") & ~F.col("max_date").eqNullSafe(F.col("version")), F.lit("not at the data version"))
    late = late.when((F.col("freshness") == "max_age_days") & (F.col("max_date").isNull() | (age < 0) | (age > F.col("max_age"))), F.lit("too old"))
    empty = F.when(F.col("schema_error").isNull() & (F.col("rows") == 0), F.lit("no rows"))
    errors = F.filter(F.array("schema_error", empty, F.when(F.col("schema_error").isNull() & F.col("version").isNotNull(), late), F.when(F.col("version").isNull(), F.lit("no data version"))), lambda e: e.isNotNull())
    return told.select("dataset", "required", "rows", "max_date", F.array_join(errors, "; ").alias("errors"), F.when(F.size(errors) > 0, "failed").otherwise("ready").alias("status"))


def ready(manifest: DataFrame) -> DataFrame:
    """One row: blocked if a required dataset isn't ready, and which."""
    bad = F.when(F.col("required") & (F.col("status") != "ready"), F.col("dataset"))
    return manifest.agg(F.array_join(F.array_sort(F.collect_list(bad)), ",").alias("failures")).select(F.when(F.col("failures") == "", "ready").otherwise("blocked").alias("status"), "failures")


#: The states of a factor, each reached from the one before.
STATES = ("candidate", "implemented", "internal_validated", "strategy_candidate", "external_sim_ready", "external_sim_passed", "live_ready", "live_approved")


def promoted(current: DataFrame, requests: DataFrame) -> DataFrame:
    """(factor, from_state, to_state, accepted, reason, state) of requests (factor, to_state, approvals) on the states of factors (factor, state):
    only the next state may follow, and states of live trading need approvals."""
    at = lambda c: F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(c))
    own = requests.join(current, "factor", "left").withColumn("from_state", F.coalesce("state", F.lit(STATES[0])))
    reason = F.when(at("to_state") == 0, "unknown state").when(at("to_state") != at("from_state") + 1, "not the next state").when(F.col("to_state").startswith("live_") & (F.coalesce(F.size("approvals"), F.lit(0)) < 1), "needs approvals")
    return own.select("factor", "from_state", "to_state", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNull(), F.col("to_state")).otherwise(F.col("from_state")).alias("state"))


def five_checks(specs: DataFrame) -> DataFrame:
    """(factor, check, status) of factors (factor, formula, required, available, samples, sections, truth_given, truth_ok): formula told, fields there,
    samples there, truth compared and met, sections enough. What isn't told yet is pending."""
    ok = lambda c: F.when(c, "passed").otherwise("failed")
    checks = {
        "formula_match": F.when(F.trim(F.coalesce("formula", F.lit(""))) != "", "passed").otherwise("pending"), "field_mapping_match": ok(F.size(F.array_except("required", "available")) == 0), "sample_point_reconciliation": ok(F.col("samples") > 0),
        "cross_section_truth_compare": F.when(F.col("truth_given"), ok(F.coalesce("truth_ok", F.lit(False)))).otherwise("pending"), "evaluation_consistency": ok(F.col("sections") > 0),
    }
    each = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("status")) for k, c in checks.items()])
    return specs.select("factor", F.explode(each).alias("c")).select("factor", "c.check", "c.status")


def parsed_notes(notes: DataFrame, column: str = "note") -> DataFrame:
    """``notes`` with action and shares of a trader's note: hold a number of shares, sell all, or nothing that can be read."""
    n = F.coalesce(F.col(column), F.lit(""))
    shares = F.coalesce(*[F.nullif(F.regexp_extract(n, p, 1), F.lit("")) for p in (r"持有(\d+)股", r"\?\?(\d+)\?")]).cast("long")
    action = F.when(n.contains("全部卖出"), "sell").when(shares.isNotNull(), "hold").otherwise("skip")
    return notes.withColumns({"action": action, "shares": F.when(action == "hold", shares)})


def keyword_sector(symbol: Column, name: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first sector one of whose words is in the name, "Other:" and the symbol if none is."""
    out = None
    for sector, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        out = F.when(hit, sector) if out is None else out.when(hit, sector)
    return out.otherwise(F.concat(F.lit("Other:"), symbol))


def traffic(events: DataFrame, last: Column, days: int = 14) -> DataFrame:
    """(day, views, visitors, signed_in, views_7d, visitors_7d) of the ``days`` dates up to ``last``, with zeros where nothing came;
    the means are of a date and the six before it within the window, rounded to whole numbers. ``events`` has (ts, visitor, user)."""
    spine = events.agg(last.alias("last")).select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    own = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("user").alias("signed_in"))
    told = spine.join(own, "day", "left").fillna(0)
    week = Window.orderBy("day").rowsBetween(-6, 0)
    return told.withColumns({f"{c}_7d": F.round(F.avg(c).over(week) + 1e-9).cast("long") for c in ("views", "visitors")})


def top_paths(events: DataFrame, path: str, size: int = 5) -> DataFrame:
    """(day, path, views) of the most seen paths of each date, ties by name."""
    n = events.groupBy(F.to_date("ts").alias("day"), F.col(path)).agg(F.count("*").alias("views"))
    order = Window.partitionBy("day").orderBy(F.desc("views"), path)
    return n.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size).drop("k")


def page(df: DataFrame, order: Sequence[Column | str], size: int, number: int) -> DataFrame:
    """Page ``number``, from 0, of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)
