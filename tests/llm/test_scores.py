import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestrand.llm import quality, rules, toxicity


def auc(s, y):
    r = pd.Series(s).rank().to_numpy()
    n = int(sum(y))
    return (r[np.array(y) == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.6)).astype(float)
    m = rules.fit(list("abcd"), x, y)
    assert auc(m.score(x), y) > 0.98 and 0 < len(m.rules) < 400


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    m = rules.fit(list("abc"), x, (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = [r[0] for r in df.select(m.column()).collect()]
    assert np.allclose(sorted(got), sorted(m.score(x)))


def test_quality_on_held_out_rows(spark, data):
    data = data.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    part = quality.fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels, part != 0)
    got = quality.quality_scores(docs, model).join(labels, "doc_id").filter(part == 0).toPandas()
    assert auc(got["score"], got["quality"]) > 0.95
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "word " * 30_000, 3.0)], "doc_id long, text string, s_words double")
    assert quality.quality_scores(odd, model).filter("score between 0 and 1").count() == 3
    assert quality.quality_scores(odd.filter("doc_id = 9"), model).count() == 0


def test_constant_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none, F.lit(True))
    assert {r["score"] for r in quality.quality_scores(docs, model).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs, toxicity.fit(docs, none, F.lit(True))).count() == 2


def test_toxicity_on_held_out_rows(spark, data):
    data = data.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    part = quality.fold(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels, part != 1)
    got = toxicity.toxicity_scores(docs.join(labels.filter("toxic is not null").select("doc_id"), "doc_id"), model).join(labels, "doc_id").filter(part == 1).toPandas()
    assert auc(got["score"], got["toxic"]) > 0.9
    bad = got[got["toxic"] == 1]["predicted"].mean()
    clean = got[got["toxic"] == 0]["predicted"].mean()
    assert bad > 0.8 and clean < 0.02
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "word " * 30_000)], "doc_id long, text string")
    assert toxicity.toxicity_scores(odd, model).filter("score between 0 and 1").count() == 3
