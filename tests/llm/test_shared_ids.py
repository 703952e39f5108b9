"""Line dedup of rows that share an id but not a text."""

from cadence.llm.line_dedup import dedup_lines, removed_lines


def test_lines_go_from_their_own_text_only(spark):
    docs = spark.createDataFrame([(0, "A"), (1, "A\nB"), (1, "C\nD"), (1, "E\nF"), (1, "E\nF")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect()) == [(0, "A"), (1, "B"), (1, "C\nD"), (1, "E\nF"), (1, "E\nF")]
    assert [(r.doc_id, r.removed) for r in removed_lines(docs).collect()] == [(1, [0])]


def test_near_lines_of_one_id_and_number(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:40], x, *words[41:]]) for x in ("p", "q")]
    docs = spark.createDataFrame([(1, near[0] + "\nX"), (1, near[1] + "\nY")], "doc_id long, text string")
    got = sorted(r.text for r in dedup_lines(docs).collect())
    assert got in (sorted([near[0] + "\nX", "Y"]), sorted(["X", near[1] + "\nY"]))


def test_query_counts_by_row(spark, tmp_path):
    from cadence.llm.queries import op4_line_dedup

    spark.createDataFrame([(0, "A"), (1, "A\nB"), (1, "C\nD")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in op4_line_dedup(spark, str(tmp_path)).collect()) == [(0, 1, 0, ""), (1, 2, 0, ""), (1, 2, 1, "0")]
