"""Queries of panels as data, of the warehouse, of documents and of traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.operators import decisions as dc
from lodestrand.operators import documents as dm
from lodestrand.operators import evaluation as ev
from lodestrand.operators import portfolio as pt
from lodestrand.operators import warehouse as wh
from lodestrand.plans.evaluation_queries import factors, long, mom
from lodestrand.plans.layers import rounded
from lodestrand.plans.oracles.frames import corr, place, query, r
from lodestrand.plans.registry import Registry
from lodestrand.sources import panel as panels
from lodestrand.sources.panel import brand_week, table
from lodestrand.streaming import bars

QUERIES = Registry()
PANEL = ("date", "code", "open", "high", "low", "close", "volume", "amount")


# panels

@QUERIES.add(query("SELECT date, code, open, high, low, close, volume, amount, sector, industry, subindustry FROM panel", "panel"))
def panel_load(s, d):
    return brand_week(s, d).select(*PANEL, "sector", "industry", "subindustry")


_STATUS = "SELECT p_brand AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, bool_and(l_linestatus = 'F') AS suspended FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def status(s, d) -> DataFrame:
    """A daily status: a brand whose lines of a week are all closed counts as suspended."""
    parts = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("code"))
    lines = table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_linestatus").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("code", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("suspended"))


@QUERIES.add(query("SELECT p.date, p.code, p.close FROM panel p JOIN security USING (code) JOIN status USING (code, date) WHERE kind = 'EQUITY' AND NOT suspended", "panel", status=_STATUS, security="SELECT p_brand AS code, CASE WHEN max(p_size) > 45 THEN 'EQUITY' ELSE 'FUND' END AS kind FROM part GROUP BY p_brand"))
def panel_listed(s, d):
    """Prices of equities on dates on which they trade: prices, securities and status, three tables joined."""
    kind = F.when(F.max("p_size") > 45, "EQUITY").otherwise("FUND")
    security = table(s, d, "part").groupBy(F.col("p_brand").alias("code")).agg(kind.alias("kind")).filter("kind = 'EQUITY'")
    return brand_week(s, d).join(F.broadcast(security), "code").join(status(s, d).filter("NOT suspended"), ["code", "date"]).select("date", "code", "close")


@QUERIES.add(f"""SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS code, l_extendedprice AS close, l_quantity AS volume, {r('(l_extendedprice * l_quantity / nullif(l_quantity, 0))')} AS vwap FROM
  (SELECT *, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_suppkey DESC) AS k FROM lineitem) q WHERE k = 1""")  # fmt: skip
def panel_normalize(s, d):
    """Raw rows under other names, with keys more than once: the last by load order is kept."""
    raw = table(s, d, "lineitem").select(
        F.col("l_shipdate").alias("Trade_Date"), F.col("l_partkey").alias("symbol"), *[F.col("l_extendedprice").cast("string").alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").cast("string").alias("volume"),
        (F.col("l_extendedprice") * F.col("l_quantity")).cast("string").alias("total_turnover"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice", "l_quantity", "l_suppkey").alias("place"),
    )
    return panels.normalize(raw, "place").select("date", "code", "close", "volume", rounded(F.col("vwap"), 6).alias("vwap"))


@QUERIES.add(query(f"""SELECT count(*) AS n, count(DISTINCT code) AS codes, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (high < low) AS crossed, count(*) - count(DISTINCT (date, code)) AS duplicates,
  {r('(count(*) FILTER (coalesce(volume, 0) <= 0) / count(*))')} AS idle, {r('(least(count(open), count(high), count(low), count(close), count(volume), count(amount)) / count(*))')} AS coverage,
  CASE WHEN count(*) > count(DISTINCT (date, code)) OR year(min(date)) < 2005 OR count(*) FILTER (high < low) > 0 THEN 'failed' WHEN count(*) FILTER (coalesce(volume, 0) <= 0) > 0.2 * count(*) THEN 'warning' ELSE 'passed' END AS status FROM panel""", "panel"))  # fmt: skip
def panel_quality(s, d):
    return wh.panel_quality(brand_week(s, d), PANEL)


@QUERIES.add(query("SELECT code, count(DISTINCT date) AS days FROM panel GROUP BY code HAVING count(DISTINCT date) >= ceil((SELECT count(DISTINCT date) FROM panel) * 0.95)", "panel"))
def universe_by_coverage(s, d):
    return wh.covered_universe(brand_week(s, d))


@QUERIES.add(query("SELECT last_date, codes, codes >= 20 AS enough, true AS recent FROM (SELECT date AS last_date, count(DISTINCT code) AS codes FROM panel GROUP BY date ORDER BY date DESC LIMIT 1)", "panel"))
def freshness_check(s, d):
    return wh.freshness(brand_week(s, d), F.col("last_date"), least=20)


@QUERIES.add(query("PIVOT_", "panel").replace("PIVOT_", "SELECT date, " + ", ".join(f"max(close) FILTER (code = 'Brand#{k}') AS b{k}" for k in range(1, 26)) + " FROM panel GROUP BY date"))
def panel_to_wide(s, d):
    codes = [f"Brand#{k}" for k in range(1, 26)]
    wide = brand_week(s, d).groupBy("date").pivot("code", codes).agg(F.max("close"))
    return wide.select("date", *[F.col(f"`{c}`").alias(c.replace("Brand#", "b")) for c in codes])


@QUERIES.add(query(f"SELECT p.date, p.code, {r('(p.close / coalesce(f.factor, 1.0))')} AS close_adj FROM panel p LEFT JOIN (SELECT code, arg_max(1 + volume / 1000, date) AS factor FROM panel WHERE sector <> 'sector0' AND month(date) = 6 GROUP BY code) f USING (code)", "panel"))
def adjusted_prices(s, d):
    """The last factor of a code adjusts all its prices; codes of one sector have none."""
    panel = brand_week(s, d)
    own = panel.filter("sector <> 'sector0' AND month(date) = 6").select("date", "code", (1 + F.col("volume") / 1000).alias("factor"))
    return wh.adjusted(panel.select("date", "code", "close"), own).select("date", "code", rounded(F.col("close_adj"), 6).alias("close_adj"))


@QUERIES.add(query("SELECT o_orderkey, (SELECT max(date) FROM dates WHERE date <= CAST(o_orderdate AS DATE)) AS snap FROM orders", "panel", dates="SELECT DISTINCT date FROM panel"))
def asof_join(s, d):
    return wh.as_of(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", brand_week(s, d)).select("o_orderkey", "snap")


@QUERIES.add(query(f"SELECT date, code, {r('(a.close - b.open)')} AS gap FROM panel a JOIN panel b USING (date, code)", "panel"))
def raw_adjusted_join(s, d):
    """Two price tables joined by keys that must be there once on each side."""
    panel = brand_week(s, d)
    both = wh.one_to_one(panel.select("date", "code", "close"), panel.select("date", "code", "open"), ["date", "code"])
    return both.select("date", "code", rounded(F.col("close") - F.col("open"), 6).alias("gap"))


@QUERIES.add("SELECT code, date, coalesce(a.suspended, 0) AS suspended, coalesce(b.st, 0) AS st FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, 1 AS suspended FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) a FULL JOIN (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, 1 AS st FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b USING (code, date)")
def status_outer(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), "l_linestatus", "l_returnflag")
    flags = {"suspended": "l_linestatus = 'F'", "st": "l_returnflag = 'A'"}
    one, two = (lines.filter(w).select("code", "date").distinct().withColumn(c, F.lit(1)) for c, w in flags.items())
    return wh.outer_filled(one, two, ["code", "date"])


@QUERIES.add(query(f"SELECT s_suppkey AS strategy, s_name AS name, coalesce(n, 0) AS n, {r('paid', 2)} AS paid FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS paid FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey) ON l_suppkey = s_suppkey"))
def strategies_kpis(s, d):
    """Every strategy with its figures, those without any too."""
    own = table(s, d, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("n"), rounded(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("paid"))
    return table(s, d, "supplier").join(own, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("strategy"), F.col("s_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), "paid")


@QUERIES.add("SELECT (SELECT count(*) FROM orders) AS n_values, CAST(NULL AS BIGINT) AS n_metrics")
def summary_beside_metrics(s, d):
    """A summary of one row beside metrics that are missing."""
    one = table(s, d, "orders").agg(F.count("*").alias("n_values"))
    none = table(s, d, "orders").filter("false").groupBy("o_orderstatus").agg(F.count("*").alias("n_metrics")).select("n_metrics")
    return wh.one_row(one, none)


@QUERIES.add(query("SELECT date, code, volume FROM panel WHERE volume > 100", "panel"))
def traded_rows(s, d):
    """Rows with volume; a floor stands in for zero, which this panel never has."""
    return brand_week(s, d).filter("volume > 100").select("date", "code", "volume")


@QUERIES.add(query("SELECT date, code, close FROM panel WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND code IN ('Brand#1', 'Brand#12')", "panel"))
def fetch_kline(s, d):
    members = s.createDataFrame([("Brand#1",), ("Brand#12",)], "code string")
    return brand_week(s, d).filter("date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'").join(F.broadcast(members), "code", "left_semi").select("date", "code", "close")


# symbols and screens

_RAW = "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '600' || s_suppkey || '.XSHG' WHEN 1 THEN '000' || s_suppkey || '.XSHE' WHEN 2 THEN 'SHSE.6' || s_suppkey WHEN 3 THEN '300' || s_suppkey WHEN 4 THEN 'szse.0' || s_suppkey ELSE '83' || s_suppkey END AS raw FROM supplier"


def raw_symbols(s, d) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    forms = [F.concat(F.lit("600"), k, F.lit(".XSHG")), F.concat(F.lit("000"), k, F.lit(".XSHE")), F.concat(F.lit("SHSE.6"), k), F.concat(F.lit("300"), k), F.concat(F.lit("szse.0"), k), F.concat(F.lit("83"), k)]
    return table(s, d, "supplier").select("s_suppkey", F.element_at(F.array(*forms), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("raw"))


_CANON = f"SELECT s_suppkey, raw, CASE s_suppkey % 6 WHEN 0 THEN '600' || s_suppkey || '.SH' WHEN 1 THEN '000' || s_suppkey || '.SZ' WHEN 2 THEN '6' || s_suppkey || '.SH' WHEN 3 THEN '300' || s_suppkey || '.SZ' WHEN 4 THEN '0' || s_suppkey || '.SZ' ELSE '83' || s_suppkey || '.BJ' END AS symbol FROM ({_RAW}) q"


@QUERIES.add(f"SELECT s_suppkey, symbol FROM ({_CANON}) c")
def canonical_symbol(s, d):
    return raw_symbols(s, d).select("s_suppkey", wh.canonical(F.col("raw")).alias("symbol"))


@QUERIES.add(f"SELECT s_suppkey, raw FROM ({_CANON}) c WHERE s_suppkey % 7 = 0 AND s_suppkey % 6 <> 4")
def resolve_universe(s, d):
    """Rows under any spelling of the members of an index."""
    raw = raw_symbols(s, d)
    members = raw.filter("s_suppkey % 7 = 0").select(wh.canonical(F.col("raw")).alias("symbol"))
    return wh.in_universe(raw, members, "raw").select("s_suppkey", "raw")


@QUERIES.add("SELECT p_partkey FROM part WHERE p_retailprice > 3 AND p_size > 0 AND p_size < 40 AND NOT (upper(p_name) LIKE '%ST%' OR p_name LIKE '%退%') AND p_type NOT LIKE '%TIN%'")
def stock_screen(s, d):
    """Price, valuation and name screens, with size for valuation and type for the board."""
    return table(s, d, "part").filter((F.col("p_retailprice") > 3) & (F.col("p_size") > 0) & (F.col("p_size") < 40) & ~F.upper("p_name").rlike("ST|退") & ~F.col("p_type").contains("TIN")).select("p_partkey")


@QUERIES.add("SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part WHERE NOT (CAST(p_partkey AS VARCHAR) LIKE '8%' OR CAST(p_partkey AS VARCHAR) LIKE '9%') AND NOT regexp_matches(upper(p_name), 'ST|退|^N|^C')")
def listed_stocks(s, d):
    return wh.listed_stocks(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name")))


@QUERIES.add(f"SELECT s_suppkey, {r('(CASE WHEN m > 1 THEN s_acctbal / 10000 ELSE s_acctbal END)')} AS dividend_yield FROM supplier, (SELECT quantile_cont(abs(s_acctbal), 0.5) AS m FROM supplier) q")
def dividend_yield_normalize(s, d):
    """Basis points become shares of one if the median size says that they are basis points."""
    own = table(s, d, "supplier")
    m = own.agg(F.percentile(F.abs("s_acctbal"), F.lit(0.5)).alias("m"))
    return own.join(F.broadcast(m)).select("s_suppkey", rounded(F.when(F.col("m") > 1, F.col("s_acctbal") / 10000).otherwise(F.col("s_acctbal")), 6).alias("dividend_yield"))


_SECTOR_RULES = (("Metal", ("BRASS", "COPPER")), ("Tin", ("TIN",)), ("Steel", ("STEEL", "NICKEL")))


@QUERIES.add("SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN 'Metal' WHEN p_type LIKE '%TIN%' THEN 'Tin' WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%NICKEL%' THEN 'Steel' ELSE 'Other:' || p_partkey END AS sector FROM part")
def classify_sector(s, d):
    return table(s, d, "part").select("p_partkey", wh.keyword_sector(F.col("p_partkey").cast("string"), F.col("p_type"), _SECTOR_RULES).alias("sector"))


@QUERIES.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'sell' WHEN 2 THEN 'hold' ELSE 'skip' END AS action, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_custkey * 100 ELSE 0 END AS shares FROM orders")
def note_parsing(s, d):
    n = (F.col("o_custkey") * 100).cast("string")
    notes = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("[开盘价] 持有"), n, F.lit("股"))).when(F.col("o_orderkey") % 4 == 1, F.lit("[开盘价] 全部卖出")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("[??] ??"), n, F.lit("?")))
    return wh.parsed_notes(table(s, d, "orders").select("o_orderkey", "o_custkey", notes.alias("note"))).select("o_orderkey", "action", F.coalesce("shares", F.lit(0)).alias("shares"))


# values

_STAGED = " UNION ALL ".join(f"SELECT ' Panel' AS family, '{f.upper()} ' AS factor, code AS symbol, date AS trade_date, {r(f'({f} + {k} * 0.001)')} AS value, '{t}' AS value_type, 'v{k}' AS version, {q} AS load_seq FROM factor" for f, t, k, q in (("mom", "truth", 0, 1), ("mom", "submitted", 1, 2), ("mom", "submitted", 2, 3), ("mom", "submitted", 2, 4), ("rev", "reproduced", 1, 5), ("liq", "research", 1, 6)))
_KINDS = (("mom", "truth", 0, 1), ("mom", "submitted", 1, 2), ("mom", "submitted", 2, 3), ("mom", "submitted", 2, 4), ("rev", "reproduced", 1, 5), ("liq", "research", 1, 6))
_CLEAN = {"staged": _STAGED, "clean": "SELECT 'panel' AS family, lower(trim(factor)) AS factor, value_type, symbol, trade_date, version, value FROM staged a WHERE value IS NOT NULL AND load_seq <> 3"}


def staged(s, d) -> DataFrame:
    """Values of several kinds and versions under unclean names, one load twice."""
    f = factors(s, d)
    out = None
    for name, kind, k, seq in _KINDS:
        one = f.select(F.lit(" Panel").alias("family"), F.lit(f"{name.upper()} ").alias("factor"), F.col("code").alias("symbol"), F.col("date").alias("trade_date"), rounded(F.col(name) + k * 0.001, 6).alias("value"), F.lit(kind).alias("value_type"), F.lit(f"v{k}").alias("version"), F.lit(seq).alias("load_seq"))
        out = one if out is None else out.unionByName(one)
    return out


def clean(s, d) -> DataFrame:
    return wh.normalized_values(staged(s, d))


@QUERIES.add(query("SELECT family, factor, value_type, symbol, trade_date, version, value FROM clean", "factor", **_CLEAN))
def normalize_values(s, d):
    return clean(s, d).select("family", "factor", "value_type", "symbol", "trade_date", "version", "value")


@QUERIES.add(query("SELECT DISTINCT factor FROM clean", "factor", **_CLEAN))
def list_factors(s, d):
    return clean(s, d).select("factor").distinct()


@QUERIES.add(query("SELECT symbol, trade_date, value FROM clean WHERE factor = 'rev' AND trade_date >= DATE '1999-01-01' AND symbol IN ('Brand#2', 'Brand#3')", "factor", **_CLEAN))
def fetch_factor_values(s, d):
    return clean(s, d).filter("factor = 'rev' AND trade_date >= DATE '1999-01-01' AND symbol IN ('Brand#2', 'Brand#3')").select("symbol", "trade_date", "value")


@QUERIES.add(query("SELECT symbol, trade_date, arg_max(value, version) AS value, max(version) AS version FROM clean WHERE factor = 'mom' AND value_type = 'submitted' GROUP BY ALL", "factor", **_CLEAN))
def merge_unique(s, d):
    own = clean(s, d).filter("factor = 'mom' AND value_type = 'submitted'")
    return wh.keep_last(own, ["symbol", "trade_date"], "version").select("symbol", "trade_date", "value", "version")


@QUERIES.add(query(f"SELECT family, factor, value_type, version, count(*) AS n, count(DISTINCT symbol) AS symbols, min(trade_date) AS first_date, max(trade_date) AS last_date, {r('avg(value)')} AS mean_value FROM clean GROUP BY ALL", "factor", **_CLEAN))
def factor_values_summary(s, d):
    return clean(s, d).groupBy("family", "factor", "value_type", "version").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), rounded(F.avg("value"), 6).alias("mean_value"))


@QUERIES.add(query("SELECT family, factor, value_type, version, n FROM (SELECT family, factor, value_type, version, count(*) AS n FROM clean GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY factor ORDER BY list_position(['truth', 'submitted', 'reproduced', 'research'], value_type), version DESC) = 1", "factor", **_CLEAN))
def publish_factor(s, d):
    return wh.published(clean(s, d))


@QUERIES.add(query("""SELECT '{"date":"' || strftime(trade_date, '%Y-%m-%d') || '","symbol":"' || symbol || '","version":"' || version || '"}' AS json, value FROM clean WHERE factor = 'liq'""", "factor", **_CLEAN))
def values_json(s, d):
    """Rows as JSON documents, and their values."""
    own = clean(s, d).filter("factor = 'liq'")
    return own.select(F.to_json(F.struct(F.date_format("trade_date", "yyyy-MM-dd").alias("date"), "symbol", "version")).alias("json"), "value")


@QUERIES.add(query(f"SELECT date, code, {r('coalesce(CASE WHEN month(date) = 6 THEN rev END, mom)')} AS value, 'v2' AS version FROM factor", "factor"))
def metric_upsert(s, d):
    """New values over old ones by key; where the new table has none the old stay."""
    f = factors(s, d)
    old = f.select("date", "code", F.col("mom").alias("value"), F.lit("v2").alias("version"))
    new = f.filter("month(date) = 6").select("date", "code", F.col("rev").alias("value"))
    return wh.upsert(old, new, ["date", "code"]).select("date", "code", rounded(F.col("value"), 6).alias("value"), "version")


@QUERIES.add("SELECT l_suppkey AS batch, CASE WHEN max(CASE WHEN l_quantity > 49 AND l_discount > 0.09 THEN 'bad row' END) IS NOT NULL THEN 'failed' ELSE 'published' END AS status, count(*) AS rows, max(CASE WHEN l_quantity > 49 AND l_discount > 0.09 THEN 'bad row' END) AS error FROM lineitem GROUP BY l_suppkey UNION ALL SELECT s_suppkey, 'staged', 0, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
def batch_status(s, d):
    results = table(s, d, "lineitem").select(F.col("l_suppkey").alias("batch"), F.lit(1).alias("rows"), F.when((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09), "bad row").alias("error"))
    batches = table(s, d, "supplier").select(F.col("s_suppkey").alias("batch"), F.lit("staged").alias("status"))
    return wh.batch_status(batches, results)


@QUERIES.add("SELECT p_partkey AS id, p_brand AS library, CASE WHEN p_size % 3 = 0 AND p_brand IN ('Brand#11', 'Brand#12') THEN 'not_compared' WHEN p_size % 3 = 0 THEN 'not_applicable' ELSE 'passed' END AS truth_status, p_size % 3 = 0 AND p_brand IN ('Brand#11', 'Brand#12') AS changed FROM part")
def truth_backfill(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("library"), F.when(F.col("p_size") % 3 == 0, "not_applicable").otherwise("passed").alias("truth_status"))
    return wh.truth_backfill(rows, ["brand#11", "BRAND#12"])


@QUERIES.add("SELECT o_orderkey, flag, value FROM (SELECT o_orderkey, o_orderpriority LIKE '1%' AS urgent, o_orderstatus = 'O' AS open FROM orders) UNPIVOT (value FOR flag IN (urgent, open))")
def boolean_matrix_melt(s, d):
    return table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").startswith("1").alias("urgent"), (F.col("o_orderstatus") == "O").alias("open")).unpivot("o_orderkey", ["urgent", "open"], "flag", "value")


@QUERIES.add("SELECT p_brand AS library, p_type AS category, count(*) AS n FROM part GROUP BY ALL")
def catalog_counts(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("library"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"))


@QUERIES.add("SELECT p_brand AS library, p_name AS name, arg_max(src, src) AS src, arg_max(size, src) AS size FROM (SELECT p_brand, p_name, 1 AS src, max(p_size) AS size FROM part GROUP BY ALL UNION ALL SELECT p_brand, p_name, 2, min(p_size) FROM part WHERE p_size > 25 GROUP BY ALL) q GROUP BY ALL")
def catalog_merge(s, d):
    part = table(s, d, "part").select(F.col("p_brand").alias("library"), F.col("p_name").alias("name"), "p_size")
    one = part.groupBy("library", "name").agg(F.max("p_size").alias("size")).withColumn("src", F.lit(1))
    two = part.filter("p_size > 25").groupBy("library", "name").agg(F.min("p_size").alias("size")).withColumn("src", F.lit(2))
    return wh.merged_catalog([one, two]).select("library", "name", "src", "size")


@QUERIES.add("SELECT name, row_number() OVER (ORDER BY CAST(substr(name, 7) AS INT)) AS place FROM (SELECT DISTINCT p_brand AS name FROM part) q")
def natural_sort(s, d):
    names = table(s, d, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(*wh.natural("name"))).cast("long").alias("place"))


@QUERIES.add("SELECT o_custkey AS factor, max(o_orderdate) AS created, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS report FROM orders GROUP BY o_custkey")
def latest_report(s, d):
    reports = table(s, d, "orders").select(F.col("o_custkey").alias("factor"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("report"), F.struct("o_orderdate", "o_orderkey").alias("place"))
    return wh.latest(reports, "factor", "place").select("factor", "created", "report")


@QUERIES.add(query(f"SELECT code, {r('w')} AS weight, row_number() OVER (ORDER BY abs(w) DESC, code) AS place FROM (SELECT code, mom / 10 AS w FROM factor WHERE date = (SELECT max(date) FROM factor WHERE mom IS NOT NULL) AND mom IS NOT NULL)", "factor"))
def position_weights(s, d):
    own = factors(s, d).filter("mom IS NOT NULL")
    last = own.agg(F.max("date").alias("date"))
    day = own.join(F.broadcast(last), "date").select("code", (F.col("mom") / 10).alias("w"))
    return day.select("code", rounded(F.col("w"), 6).alias("weight"), F.row_number().over(Window.orderBy(F.desc(F.abs("w")), "code")).cast("long").alias("place"))


@QUERIES.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(s, d):
    """The third page of fifty."""
    return wh.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 2)


# decisions on data

@QUERIES.add("""WITH t AS (SELECT 'orders' AS dataset, true AS required, count(*) AS rows, CAST(max(o_orderdate) AS DATE) AS max_date, 'data_version' AS f, 0 AS a FROM orders UNION ALL SELECT 'lineitem', true, count(*), CAST(max(l_shipdate) AS DATE), 'max_age_days', 400 FROM lineitem
  UNION ALL SELECT 'events', false, count(*), CAST(max(ts) AS DATE), 'max_age_days', 10 FROM events UNION ALL SELECT 'part', true, count(*), NULL, 'present', 0 FROM part UNION ALL SELECT 'missing', false, 0, NULL, 'present', 0), v AS (SELECT max_date AS version FROM t WHERE dataset = 'orders'),
  e AS (SELECT t.*, concat_ws('; ', CASE WHEN dataset = 'missing' THEN 'missing dataset' WHEN dataset = 'part' THEN 'missing columns: p_colour' END, CASE WHEN dataset NOT IN ('missing', 'part') AND f = 'max_age_days' AND (version - max_date < 0 OR version - max_date > a) THEN 'too old' END) AS errors FROM t, v)
  SELECT dataset, required, rows, max_date, errors, CASE WHEN errors <> '' THEN 'failed' ELSE 'ready' END AS status FROM e""")  # fmt: skip
def readiness_manifest(s, d):
    return wh.readiness(*_readiness(s, d))


def _readiness(s, d):
    frames = {t: table(s, d, t) for t in ("orders", "lineitem", "events", "part")}
    specs = [
        wh.Dataset("orders", ("o_orderkey", "o_orderdate"), "o_orderdate", "data_version"), wh.Dataset("lineitem", ("l_orderkey",), "l_shipdate", "max_age_days", 400),
        wh.Dataset("events", ("ts",), "ts", "max_age_days", 10, required=False), wh.Dataset("part", ("p_partkey", "p_colour")), wh.Dataset("missing", ("x",), required=False),
    ]
    return frames, specs, "orders"


@QUERIES.add("SELECT 'blocked' AS status, CASE WHEN (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) NOT BETWEEN 0 AND 400 THEN 'lineitem,part' ELSE 'part' END AS failures")
def readiness_status(s, d):
    return wh.ready(wh.readiness(*_readiness(s, d)))


_RULES = {"ic_mean": ">= 0.02", "icir": ">= 0.3", "ic_std": "< 0.25", "n": "> 100", "missing": ">= 1"}


@QUERIES.add(query(" UNION ALL ".join(f"SELECT factor, '{m}' AS metric, {x} AS value, '{rule}' AS rule, CASE WHEN {x} IS NULL THEN 'pending' WHEN {x} {rule} THEN 'passed' ELSE 'failed' END AS status FROM m" for (m, rule), x in zip(_RULES.items(), ("ic_mean", "icir", "ic_std", "CAST(n AS DOUBLE)", "CAST(NULL AS DOUBLE)"))), "ic5", m=f"SELECT factor, count(*) AS n, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std, {r('(avg(ic) / stddev_samp(ic))')} AS icir FROM ic5 GROUP BY factor"))
def threshold_report(s, d):
    metrics = ev.ic_summary(ev.daily_ic(long(s, d), 5).filter("ic IS NOT NULL")).withColumn("missing", F.lit(None).cast("double"))
    return dc.threshold_report(metrics, _RULES)


_SPECS = """SELECT p_partkey AS factor, CASE WHEN p_size % 5 > 0 THEN p_type ELSE ' ' END AS formula, p_size, p_size % 7 > 0 AS mapped, p_size % 11 AS samples, p_size % 13 AS sections, p_size % 2 = 0 AS truth_given, p_size % 4 = 0 AS truth_ok FROM part"""


def specs(s, d) -> DataFrame:
    k = F.col("p_size")
    wanted = F.array(F.lit("close"), F.lit("volume"))
    return table(s, d, "part").select(
        F.col("p_partkey").alias("factor"), F.when(k % 5 > 0, F.col("p_type")).otherwise(" ").alias("formula"), wanted.alias("required"), F.when(k % 7 > 0, wanted).otherwise(F.array(F.lit("close"))).alias("available"), (k % 11).alias("samples"),
        (k % 13).alias("sections"), (k % 2 == 0).alias("truth_given"), (k % 4 == 0).alias("truth_ok"),
    )


@QUERIES.add(f"""SELECT factor, CASE WHEN failed > 0 THEN 'failed' WHEN pending > 0 AND 5 - failed - pending > 0 THEN 'partial' WHEN pending > 0 THEN 'pending' ELSE 'passed' END AS status, failed, pending, 5 - failed - pending AS passed FROM
  (SELECT factor, CAST((NOT mapped)::INT + (samples = 0)::INT + (sections = 0)::INT + (truth_given AND NOT truth_ok)::INT AS BIGINT) AS failed, CAST((trim(formula) = '')::INT + (NOT truth_given)::INT AS BIGINT) AS pending FROM ({_SPECS}) q) w""")  # fmt: skip
def five_check_report(s, d):
    return dc.overall(wh.five_checks(specs(s, d)))


_STATES = "['" + "', '".join(wh.STATES) + "']"


@QUERIES.add(f"""SELECT factor, from_state, to_state, reason = '' AS accepted, reason, CASE WHEN reason = '' THEN to_state ELSE from_state END AS state FROM (SELECT *, CASE WHEN list_position({_STATES}, to_state) IS NULL THEN 'unknown state' WHEN list_position({_STATES}, to_state) <> list_position({_STATES}, from_state) + 1 THEN 'not the next state' WHEN to_state LIKE 'live%' AND p_size % 2 = 1 THEN 'needs approvals' ELSE '' END AS reason
  FROM (SELECT p_partkey AS factor, p_size, {_STATES}[CAST(p_size % 8 + 1 AS INT)] AS from_state, CASE WHEN p_size % 9 = 0 THEN 'nowhere' ELSE {_STATES}[CAST((p_size + p_size % 3) % 8 + 1 AS INT)] END AS to_state FROM part) q) w""")  # fmt: skip
def lifecycle(s, d):
    k, names = F.col("p_size"), F.array(*[F.lit(x) for x in wh.STATES])
    part = table(s, d, "part")
    current = part.select(F.col("p_partkey").alias("factor"), F.element_at(names, (k % 8 + 1).cast("int")).alias("state"))
    asked = part.select(F.col("p_partkey").alias("factor"), F.when(k % 9 == 0, "nowhere").otherwise(F.element_at(names, ((k + k % 3) % 8 + 1).cast("int"))).alias("to_state"), F.when(k % 2 == 0, F.array(F.lit("a"))).alias("approvals"))
    return wh.promoted(current, asked)


# research payload

@QUERIES.add(query(f"SELECT date, factor, 'daily' AS frequency, {r(corr('rv', 'rf'))} AS rank_ic, {r(corr('value', 'fwd'))} AS ic, count(*) AS n FROM ranked WHERE factor IN ('mom', 'rev') GROUP BY ALL UNION ALL SELECT date, 'month_end', 'monthly', {r(corr('a', 'b'))}, {r(corr('value', 'fwd'))}, count(*) FROM placed GROUP BY date",
    "ranked", "factor", "panel",
    months=f"SELECT code, last_day(date) AS date, sum(ret) AS ret FROM (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM panel) GROUP BY ALL",
    monthly="SELECT f.date, f.code, f.value, m.fwd FROM (SELECT code, last_day(date) AS date, avg(mom) AS value FROM factor WHERE day(date) <= 7 GROUP BY ALL) f JOIN (SELECT code, date, lead(ret) OVER (PARTITION BY code ORDER BY date) AS fwd FROM months) m USING (code, date) WHERE value IS NOT NULL AND fwd IS NOT NULL",
    placed=f"SELECT *, {place('value', 'date')} AS a, {place('fwd', 'date')} AS b FROM monthly"))
def research_payload(s, d):
    """The IC series of a payload. A factor with values on fewer than half of the panel's dates is looked at by month: mean value
    against the sum of the next month's returns."""
    every = long(s, d)
    dense = every.filter("factor IN ('mom', 'rev')")
    sparse = mom(s, d).filter("day(date) <= 7").withColumn("factor", F.lit("month_end"))
    return research(dense.unionByName(sparse), brand_week(s, d))


def research(values: DataFrame, panel: DataFrame) -> DataFrame:
    """(date, factor, frequency, rank_ic, ic, n) of long values (date, code, factor, value, fwd), by day or by month as dense as they are."""
    dates = panel.agg(F.count_distinct("date").alias("all"))
    dense = values.groupBy("factor").agg(F.count_distinct("date").alias("own")).join(F.broadcast(dates)).select("factor", F.when(F.col("own") < 0.5 * F.col("all"), "monthly").otherwise("daily").alias("frequency"))
    marked = values.join(F.broadcast(dense), "factor")
    step = F.try_divide("close", F.lag("close").over(Window.partitionBy("code").orderBy("date"))) - 1
    months = panel.select("code", F.last_day("date").alias("date"), step.alias("ret")).groupBy("code", "date").agg(F.sum("ret").alias("ret"))
    months = months.select("code", "date", F.lead("ret").over(Window.partitionBy("code").orderBy("date")).alias("fwd"))
    monthly = marked.filter("frequency = 'monthly'").groupBy("factor", "frequency", "code", F.last_day("date").alias("date")).agg(F.avg("value").alias("value")).join(months, ["code", "date"])
    columns = ["date", "code", "factor", "frequency", "value", "fwd"]
    both = marked.filter("frequency = 'daily'").select(columns).unionByName(monthly.select(columns))
    return ev.daily_ic(both, 1, ("date", "factor", "frequency")).select("date", "factor", "frequency", F.col("ic").alias("rank_ic"), F.col("pearson").alias("ic"), "n")


@QUERIES.add(query(f"SELECT date, code, {r('(x * x * x - (slope * x + start))', 4)} AS nonlinear_size FROM sized, line", "panel", sized="SELECT date, code, ln(cap) - 20 AS x FROM panel WHERE cap > 0", line="SELECT covar_pop(x * x * x, x) / var_pop(x) AS slope, avg(x * x * x) - covar_pop(x * x * x, x) / var_pop(x) * avg(x) AS start FROM sized"))
def barra_nonlinear_size(s, d):
    """What the cube of size has beyond a straight line in size; size is ln(cap) - 20, which keeps the cubes small."""
    own = brand_week(s, d).filter("cap > 0").select("date", "code", (F.ln("cap") - 20).alias("x"))
    cube = F.col("x") * F.col("x") * F.col("x")
    line = own.agg(F.regr_slope(cube, F.col("x")).alias("slope"), F.regr_intercept(cube, F.col("x")).alias("start"))
    return own.join(F.broadcast(line)).select("date", "code", rounded(cube - (F.col("slope") * F.col("x") + F.col("start")), 4).alias("nonlinear_size"))


# events

_VISITS = "SELECT ts, user_id AS visitor, CASE WHEN user_id % 3 = 0 THEN user_id END AS person, event_type FROM events"


def visits(s, d) -> DataFrame:
    return table(s, d, "events").select("ts", F.col("user_id").alias("visitor"), F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("user"), "event_type")


@QUERIES.add(f"""WITH v AS ({_VISITS}), spine AS (SELECT CAST(unnest(range((SELECT CAST(max(ts) AS DATE) FROM v) - 13 + INTERVAL 2 DAY, (SELECT CAST(max(ts) AS DATE) FROM v) + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day),
  own AS (SELECT CAST(ts AS DATE) AS day, count(*) AS views, count(DISTINCT visitor) AS visitors, count(DISTINCT person) AS signed_in FROM v GROUP BY 1), told AS (SELECT day, coalesce(views, 0) AS views, coalesce(visitors, 0) AS visitors, coalesce(signed_in, 0) AS signed_in FROM spine LEFT JOIN own USING (day))
  SELECT *, CAST(round(avg(views) OVER w + 1e-9) AS BIGINT) AS views_7d, CAST(round(avg(visitors) OVER w + 1e-9) AS BIGINT) AS visitors_7d FROM told WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""")  # fmt: skip
def traffic_daily(s, d):
    """The fourteen dates up to two days after the last event."""
    return wh.traffic(visits(s, d), F.date_add(F.max(F.to_date("ts")), 2))


@QUERIES.add("SELECT day, event_type, views FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS views FROM events GROUP BY 1, 2) q QUALIFY row_number() OVER (PARTITION BY day ORDER BY views DESC, event_type) <= 3")
def traffic_top_paths(s, d):
    return wh.top_paths(visits(s, d), "event_type", 3)


@QUERIES.add("SELECT CAST(unnest(range(DATE '2024-02-20', DATE '2024-03-05', INTERVAL 1 DAY)) AS DATE) AS day")
def date_spine(s, d):
    return s.range(1).select(F.explode(F.sequence(F.lit("2024-02-20").cast("date"), F.lit("2024-03-04").cast("date"))).alias("day"))


@QUERIES.add("SELECT event_type, bar, count(*) AS n, (list(value ORDER BY ts, event_id) FILTER (value IS NOT NULL))[1] AS open, max(value) AS high, min(value) AS low, (list(value ORDER BY ts DESC, event_id DESC) FILTER (value IS NOT NULL))[1] AS close FROM (SELECT *, date_trunc('day', ts) AS bar FROM events) q GROUP BY ALL")
def event_bars(s, d):
    """The bars of the streaming operator, over the events as a batch."""
    own = bars.bars(table(s, d, "events"), order="event_id")
    return own.select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "n", "open", "high", "low", "close")


# documents

_FILES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.md' ELSE '.csv' END AS kind, CASE doc_id % 8 WHEN 0 THEN 'mineru' WHEN 4 THEN 'pypdf2' ELSE 'docling' END AS engine, doc_id % 7 AS warnings, 'file ' || doc_id AS name, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM documents"
_IN = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_HEADS = f"list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x LIKE '#%' OR (length(x) < 90 AND {_IN('lower(x)', dm.MARKERS)})), lambda x: trim(regexp_replace(x, '^[# ]+', ''), ' '))"
_TOLD = f"""SELECT *, CASE WHEN len({_HEADS}) > 0 THEN {_HEADS}[1:18] ELSE ['Overview'] END AS outline,
  CASE WHEN {_IN('src', dm.HINTS[0][1])} AND {_IN('src', dm.HINTS[1][1])} THEN 'paper-reproduction-agent, strategy-signal-agent' WHEN {_IN('src', dm.HINTS[0][1])} THEN 'paper-reproduction-agent' WHEN {_IN('src', dm.HINTS[1][1])} THEN 'strategy-signal-agent' ELSE 'general-analysis-agent' END AS hints,
  CAST(greatest(10, least(98, CASE kind WHEN '.pdf' THEN CASE engine WHEN 'mineru' THEN 78 WHEN 'docling' THEN 72 ELSE 68 END WHEN '.docx' THEN 84 WHEN '.md' THEN 90 ELSE 45 END + CASE WHEN length(t) >= 50000 THEN 12 WHEN length(t) >= 25000 THEN 8 WHEN length(t) >= 8000 THEN 4 ELSE 0 END - least(20, 4 * warnings))) AS INT) AS score
  FROM (SELECT *, lower(name || chr(10) || substr(t, 1, 6000)) AS src, lower(name || chr(10) || substr(t, 1, 8000)) AS front FROM ({_FILES}) f) g"""
_COUNT = lambda w: f"(length(lower(t)) - length(replace(lower(t), '{w}', ''))) // {len(w)}"
_LABEL = "CASE WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'usable' WHEN score >= 50 THEN 'partial' ELSE 'limited' END"


def evaluated(s, d) -> DataFrame:
    k = F.col("doc_id")
    files = table(s, d, "documents").select(
        "doc_id", "text", F.concat(F.lit("file "), k.cast("string")).alias("name"), F.when(k % 4 == 0, ".pdf").when(k % 4 == 1, ".docx").when(k % 4 == 2, ".md").otherwise(".csv").alias("kind"),
        F.when(k % 8 == 0, "mineru").when(k % 8 == 4, "pypdf2").otherwise("docling").alias("engine"), (k % 7).cast("int").alias("warnings"),
    )
    return dm.evaluated(files)


@QUERIES.add(f"SELECT doc_id, md5(t) AS text_md5 FROM ({_FILES}) f")
def doc_normalize(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(dm.normalized(F.col("text")).cast("binary")).alias("text_md5"))


@QUERIES.add(f"SELECT doc_id, len(outline) AS n_lines, md5(array_to_string(outline, chr(10))) AS outline_md5 FROM ({_TOLD}) q")
def doc_outline(s, d):
    return evaluated(s, d).select("doc_id", F.size("outline").cast("long").alias("n_lines"), F.md5(F.array_join("outline", "\n").cast("binary")).alias("outline_md5"))


@QUERIES.add(f"SELECT doc_id, hints FROM ({_TOLD}) q")
def doc_route_hints(s, d):
    return evaluated(s, d).select("doc_id", F.array_join("hints", ", ").alias("hints"))


@QUERIES.add(f"SELECT doc_id, score, {_LABEL} AS label FROM ({_TOLD}) q")
def doc_completion(s, d):
    return evaluated(s, d).select("doc_id", "completion.score", "completion.label")


@QUERIES.add(f"SELECT doc_id, CASE WHEN kind <> '.pdf' THEN 'general' WHEN {_IN('front', dm.PROFILES[0][1])} THEN 'paper' WHEN {_IN('front', dm.PROFILES[1][1])} THEN 'report' ELSE 'general' END AS profile FROM ({_TOLD}) q")
def doc_profile(s, d):
    return evaluated(s, d).select("doc_id", "profile")


_SCORES = {
    "completeness": "CASE WHEN length(t) >= 50000 THEN 5 WHEN length(t) >= 25000 THEN 4 WHEN length(t) >= 8000 THEN 3 WHEN length(t) >= 1500 THEN 2 ELSE 1 END",
    "structure": "CASE WHEN len(outline) >= 12 AND (length(t) - length(replace(t, chr(10) || '#', ''))) // 2 + (t LIKE '#%')::INT >= 10 THEN 5 WHEN len(outline) >= 8 THEN 4 WHEN len(outline) >= 4 THEN 3 ELSE 2 END",
    "objects": "CASE WHEN engine = 'pypdf2' AND " + " + ".join(_COUNT(w) for w in dm.COMPLEX) + " >= 8 THEN 1 WHEN engine = 'mineru' THEN 5 WHEN engine = 'docling' THEN 4 ELSE 2 END",
    "downstream": "CASE WHEN score >= 85 THEN 5 WHEN score >= 70 THEN 4 WHEN score >= 55 THEN 3 ELSE 2 END",
    "revision": "greatest(1, 5 - least(4, warnings))",
}


@QUERIES.add(f"SELECT *, CASE WHEN total >= 21 THEN 'high_quality' WHEN total >= 16 THEN 'usable_with_light_review' WHEN total >= 11 THEN 'draft_only' ELSE 'not_recommended' END AS verdict FROM (SELECT *, {' + '.join(_SCORES)} AS total FROM (SELECT doc_id, " + ", ".join(f"CAST({x} AS INT) AS {k}" for k, x in _SCORES.items()) + f" FROM ({_TOLD}) q) w) v")
def doc_evaluation(s, d):
    return evaluated(s, d).select("doc_id", *_SCORES, "total", "verdict")


@QUERIES.add(f"""SELECT doc_id, md5(array_to_string(['# AI-Ready Document Package', '', '## Overview', '- Original file: ' || name, '- File type: ' || kind, '- Extractor: ' || engine, '- Completion score: ' || score || '%', '- Completion label: ' || {_LABEL}, '- Recommended next agents: ' || hints, '', '## Extraction Warnings',
  CASE WHEN warnings > 0 THEN '- ' || warnings || ' warnings' ELSE '- No major warnings detected.' END, '', '## Outline'] || list_transform(outline, lambda x: '- ' || x) || ['', '## Normalized Text', '', substr(t, 1, 16000)], chr(10))) AS package_md5 FROM ({_TOLD}) q""")  # fmt: skip
def doc_package(s, d):
    return evaluated(s, d).select("doc_id", F.md5(dm.composed().cast("binary")).alias("package_md5"))
