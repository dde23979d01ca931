from heliograph.llm import line_dedup


def test_boilerplate_lines_of_null_ids(spark):
    rows = [(None, "a", "line one\nown a"), (1, "b", "line one\nown b"), (2, "c", "line one\nown c"), (3, "a", "own d\nline one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {None: "own a", 1: "line one\nown b", 2: "own c", 3: "own d"}
