import corpus_pipeline as cp
from lodestrand.llm import queries


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == cp.COLUMNS, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.6 * counts[0]
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = cp.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]
