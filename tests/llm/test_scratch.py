import time

import pytest
from pyspark.sql import functions as F

from marginalia.llm import scratch
from tests.llm.test_pipeline import shuffles


@pytest.mark.parametrize("setting", [None, "false", "true"])
def test_shuffles_go_whatever_the_session_says(spark, setting):
    """And the session's setting stays as it was, also if nobody has set it or the write fails."""
    if setting is not None:
        spark.conf.set(scratch._CLEANUP, setting)
    try:
        before = shuffles(spark)
        table = scratch.written(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "few")
        until = time.monotonic() + 10
        while shuffles(spark) - before and time.monotonic() < until:  # they go in the background
            time.sleep(0.1)
        assert not shuffles(spark) - before
        assert table.agg(F.sum("count")).first()[0] == 1000
        with pytest.raises(Exception, match="wrong"):
            scratch.written(spark.range(3).select(F.raise_error(F.lit("wrong")).cast("string").alias("x")), "none")
        assert spark.conf.get(scratch._CLEANUP, None) == setting
    finally:
        spark.conf.unset(scratch._CLEANUP)
