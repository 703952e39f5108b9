"""Language ID learns every label or says that it does not."""

import pytest

from cadence.llm import language_id


def test_labels_are_never_left_out(spark):
    docs = spark.createDataFrame([(i, f"wort{i % 4} noch{i % 4}", f"l{i % 4}") for i in range(80)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, languages=4).languages == ["l0", "l1", "l2", "l3"]
    with pytest.raises(ValueError, match="more than 3 labels"):
        language_id.fit(docs, languages=3)
