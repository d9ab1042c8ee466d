from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from addrloom.operators import page_store, pages


def made(spark, rows=5_000):
    """Scores with many ties; a third of the rows are equal in every column."""
    i = F.col("id")
    return spark.range(0, rows, 1, 6).select(
        F.when(i % 3 == 0, "same").otherwise(F.format_string("e%05d", i)).alias("enterprise_id"),
        F.when(i % 3 == 0, 0.5).otherwise((i * 37 % 11) / 10.0).alias("exact_match"),
        F.when(i % 7 == 0, None).when(i % 3 == 0, None).otherwise((i % 5) / 10.0).alias("partial_match"),
    )


def test_pages_are_those_of_the_sorted_rows(spark, tmp_path):
    df, path = made(spark), str(tmp_path / "p")
    page_store.store(df, pages.match_order(), path, 300)
    assert page_store.total(spark, path) == 5_000
    want = [tuple(r) for r in df.orderBy(*pages.match_order()).collect()]
    for number, size in ((1, 20), (7, 43), (63, 43), (100, 49), (3, 1500), (103, 49), (1, 6000)):
        got = [tuple(r) for r in page_store.page(spark, path, number, size).collect()]
        assert got == want[(number - 1) * size : number * size]
    assert page_store.page(spark, path, 0, 5).count() == 5 and page_store.page(spark, path, 1001, 5).count() == 0
    assert page_store.page(spark, path, 1001, 5).columns == df.columns


def test_equal_rows_are_divided_and_a_page_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path / "p")
    page_store.store(made(spark), pages.match_order(), path, 300)
    lines = sorted(spark.read.parquet(f"{path}/directory").where("part >= 0").collect(), key=lambda r: r["part"])
    assert len(lines) >= 12 and max(r["rows"] for r in lines) < 900  # 1,667 equal rows
    wanted = page_store.page(spark, path, 50, 40).collect()
    touched = {r["part"] for r in lines if r["before"] < 2000 and r["before"] + r["rows"] > 1960}
    assert len(touched) <= 2
    for file in (tmp_path / "p" / "rows").rglob("*.parquet"):
        if int(file.parent.name.split("=")[1]) not in touched:
            file.write_bytes(b"no parquet")
    assert page_store.page(spark, path, 50, 40).collect() == wanted and len(wanted) == 40
    with pytest.raises(Exception):
        page_store.page(spark, path, 1, 5000).collect()


def test_empty_table_and_names(spark, tmp_path):
    path = str(tmp_path / "p")
    page_store.store(made(spark).limit(0), pages.match_order(), path)
    assert page_store.total(spark, path) == 0 and page_store.page(spark, path).collect() == []
    with pytest.raises(ValueError, match="_part"):
        page_store.store(made(spark).withColumn("_PART", F.lit(1)), ["enterprise_id"], str(tmp_path / "q"))
    with pytest.raises(Exception, match="(?i)exist"):
        page_store.store(made(spark, 10), ["enterprise_id"], path)
