"""Each stage of the pipeline against what its operator alone says, on its own input."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from sprachwerk.llm import decontaminate, quality, registry, toxicity
from sprachwerk.llm.common import table
from test_near_copies import kept_are_one_per_class


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, data):
    d = f"{data}/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_copies", "decontamination", "packing"]
    stages = dict(pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, d)
    assert calm.columns == docs.columns
    assert ids(calm) == ids(toxicity.score(docs, toxicity.train(docs, labels)).where("toxicity.score < 0.3"))
    good = stages["quality"](spark, calm, d)
    assert ids(good) == ids(quality.score(calm, quality.train(calm, labels), "s").where("s >= 0.3"))
    one = stages["near_copies"](spark, good, d)
    kept_are_one_per_class(good.collect(), one.collect())
    clean = stages["decontamination"](spark, one, d)
    found = decontaminate.find_contamination(one, table(spark, d, "benchmark"))
    assert ids(clean) == ids(found.where("size(hits.spans) = 0"))
    packed = stages["packing"](spark, clean, d)
    assert set(ids(packed)) == set(ids(clean))
    assert set(ids(pipeline.run(spark, d))) == set(ids(clean))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, data, rows):
    d = f"{data}/sf0.001"
    texts = [(None, "no id here"), (None, "another without an id"), (7, None), (7, ""), (7, "two texts of one id, the first"), (7, "two texts of one id, the first"), (8, "Ünï " * 4000), (9, " \n\t ")]
    docs = spark.createDataFrame([(i, t, "日本語", None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"a.b": F.lit(1), "score": F.lit("x"), "row": F.lit(2), "class": F.lit(3), "node": F.lit(4), "_sw_quality": F.lit(5)}).repartition(3)
    docs = docs if rows == "odd" else docs.where("false")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns or name in ("quality", "toxicity", "decontamination") and set(got.columns) == set(docs.columns)
        texts_of = {(r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()}
        assert texts_of <= set(texts)
        if name in ("toxicity", "decontamination"):
            assert got.count() == docs.count()
        if name == "near_copies":
            kept_are_one_per_class(docs.collect(), got.collect())
    assert {(r["doc_id"]) for r in pipeline.STAGES[-1][1](spark, docs, d).collect()} == {r["doc_id"] for r in docs.collect()}


def test_registry():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
