"""A class that stands in many buckets meets its sketch in one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.llm.op6_neardup import with_own


def test_classes_of_many_buckets_are_joined_once(spark):
    held = spark.createDataFrame([(k, i, k % 3, None if k % 2 else i) for i in range(5) for k in range(40)], "key long, id long, n long, component long")
    own = spark.createDataFrame([(i, [i, i + 1]) for i in range(4)], "id long, sketch array<long>")
    got = with_own(held, own)
    want = held.join(own, "id")
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Generate") < joined.index("Join") < joined.index("Aggregate")  # buckets come out after the join
