import pytest
from pyspark.sql import functions as F
from txnwatch.functions.buckets import Sliding
from txnwatch.functions.distinct import distinct_up_to


@pytest.mark.parametrize("limit", [1, 4, 15, 16, 40])
def test_bounded_count_compares_like_the_true_one(spark, limit):
    # groups of 0 to 99 distinct values, empty text among them, each value several times
    rows = spark.range(0, 100).selectExpr("id as g", "explode(sequence(0, 98)) as v", "explode(array(1, 2, 3)) as copy")
    value = F.expr("case when v >= g then null when v = 0 then '' else concat('v', v) end")
    counted = (
        rows.select("g", value.alias("v"))
        .groupBy("g")
        .agg(F.expr(f"{distinct_up_to('v', limit)} as bounded"), F.countDistinct("v").alias("exact"))
    )
    assert counted.agg(F.max("exact")).first()[0] == 99
    assert counted.where(f"(bounded > {limit}) <> (exact > {limit})").count() == 0
    assert counted.where(f"exact <= {limit} and bounded <> exact").count() == 0


def test_window_shapes():
    assert Sliding(30, 5).steps == 6
    for minutes, slide in ((10, 3), (5, 0)):
        with pytest.raises(ValueError):
            Sliding(minutes, slide)
