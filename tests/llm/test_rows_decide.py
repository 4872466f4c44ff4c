from voxelspark.llm import decontaminate


def test_clean_of_decides_by_row_on_both_paths(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(None, passage, "a"), (None, other, "b"), (1, passage, "c"), (1, other, "d"), (2, other, "e"), (3, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    small = sorted(r["name"] for r in decontaminate.clean_of(docs, bench).collect())
    large = sorted(r["name"] for r in decontaminate.clean_of(docs, bench, 0).collect())
    assert small == large == ["b", "d", "e", "f"]
