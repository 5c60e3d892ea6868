"""What keep_one keeps of rows with null and repeated ids."""

from sprachwerk.llm import simhash


def test_keep_one_of_null_and_repeated_ids(spark):
    rows = [(None, "red green blue yellow"), (None, "quite other words than those"), (None, "red green blue yellow"), (7, "first text under seven here"), (7, "second one under the same number"), (7, "second one under the same number"), (8, "first text under seven here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "quite other words than those"), (0, "red green blue yellow"), (7, "first text under seven here"), (7, "second one under the same number")]
