"""The first rows by number, block by block."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from addrloom.operators.numbering import first_by_number
from addrloom.plans import evaluation


@pytest.mark.parametrize("count", [0, 1, 9, 10, 11, 55, 1000])
def test_first_by_number(spark, count):
    numbers = [n for n in range(140) if n % 7 and not 40 <= n < 60]
    df = spark.createDataFrame([(n, f"r{n}") for n in reversed(numbers)] + [(None, "none")], "n long, _place string").repartition(5)
    out = first_by_number(df, F.col("n"), count, block=10)
    assert out.columns == df.columns
    assert sorted(r["n"] for r in out.collect()) == numbers[:count]


def test_no_rows(spark):
    assert first_by_number(spark.range(0), F.col("id"), 5).collect() == []


def test_distractors_are_not_sorted_in_one_task(spark, gazetteer):
    pairs = evaluation.match_pairs(gazetteer, 40)
    out = evaluation.distractors(gazetteer, pairs, 300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan
    assert out.count() == 300
