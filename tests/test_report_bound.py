"""Reports have all their rows or raise."""

import pytest

from cadence.sources import sinks


def test_markdown_raises_above_its_bound(spark):
    assert len(sinks.markdown(spark.range(1000)).splitlines()) == 1002
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(1001))
