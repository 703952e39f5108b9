"""The line join: rows shuffled once, and pairs across the classes of lengths found, short and long."""

import numpy as np
import pytest

from cadence.llm import line_dedup
from cadence.llm.line_dedup import removed_lines


def lines_around(rng, lengths, percent):
    """Lines of these lengths, each with one that lacks words, one that has more, and one just beyond the similarity."""
    rows = []
    for n in lengths:
        words = [f"w{k}" for k in rng.choice(100_000, 2 * n + 4, replace=False)]
        extra = n * (100 - percent) // percent
        for some in (words[:n], words[: n + extra], words[: n + extra + 1], words[: n - n * (100 - percent) // 100]):
            rows.append((len(rows), " ".join(rng.permutation(some))))
    order = rng.permutation(len(rows))
    return [(int(order[i]), text) for i, text in rows]


def brute(rows, percent):
    sets = [(d, frozenset(t.split())) for d, t in sorted(rows)]
    return {d for k, (d, s) in enumerate(sets) if any(100 * len(s & e) >= percent * len(s | e) for _, e in sets[:k])}


@pytest.mark.parametrize("percent", [75, 45])
def test_pairs_across_classes_of_lengths(spark, percent):
    rng = np.random.default_rng(percent)
    rows = lines_around(rng, [1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 15, 16, 18, 23, 24, 31, 32, 47, 48, 63, 64, 95, 96, 97, 100, 127, 128, 150, 191, 192, 256], percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, percent)
    assert len(want) > 60
    assert {r.doc_id for r in removed_lines(docs, percent=percent).collect()} == want


def test_rows_of_the_join_are_shuffled_once(spark, monkeypatch):
    plans, keep = [], line_dedup.keep

    def looked_at(df, name, **options):
        if name == "pairs":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
        return keep(df, name, **options)

    monkeypatch.setattr(line_dedup, "keep", looked_at)
    # near copies without ids stay candidates in the join, whatever has been found before it
    line = " ".join(f"word{i}" for i in range(24))
    docs = spark.createDataFrame([(None, f"{line} own{i}") for i in range(6)], "doc_id long, text string")
    assert removed_lines(docs).count() == 5
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert joins and all("ReusedExchange" in p for p in joins)
