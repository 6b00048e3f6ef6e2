"""The ordered map: order without a sort, and reported progress."""

import pytest
from pyspark.sql import functions as F

from probelake.operators.apply import ordered_map_with_progress


def test_order_and_progress(spark):
    import time

    df = spark.range(0, 400, 1, 8).withColumn("x", F.col("id") * 2)
    seen = []

    def slow(pdf):
        time.sleep(0.05 * (pdf["id"].iloc[0] % 7))
        return pdf.assign(y=pdf["x"] + 1)[["id", "y"]]

    out = ordered_map_with_progress(df, slow, "id bigint, y bigint", seen.append, poll_seconds=0.01)
    assert [(r["id"], r["y"]) for r in out.toLocalIterator()] == [(i, 2 * i + 1) for i in range(400)]
    assert seen == sorted(set(seen)) and seen[-1] == 400


def test_errors_of_function_and_callback_are_raised(spark):
    df = spark.range(10)
    with pytest.raises(Exception, match="bad row"):
        ordered_map_with_progress(df, lambda pdf: (_ for _ in ()).throw(ValueError("bad row")), "id bigint", lambda n: None)
    with pytest.raises(ZeroDivisionError):
        ordered_map_with_progress(df, lambda pdf: pdf, "id bigint", lambda n: 1 // 0)


def test_no_rows(spark):
    seen = []
    assert ordered_map_with_progress(spark.range(0), lambda pdf: pdf, "id bigint", seen.append).count() == 0 and seen == []
