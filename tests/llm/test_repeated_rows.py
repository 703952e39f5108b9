"""The pipeline's near-dedup on rows that repeat an id."""


def test_one_of_repeated_rows_stays(spark):
    import corpus_pipeline as p

    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(0, x), (1, x), (1, y), (2, y + " z"), (3, "a b"), (3, "a b"), (3, "a b"), (4, None), (4, None), (None, x), (None, x)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = p.near_dedup(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in got.collect()) == sorted([(0, x), (1, y), (3, "a b"), (4, ""), (-1, x), (-1, x)])
