"""One-row statistics; each is a single pass with map-side partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.functions.scores import percent
from addrloom.operators.filters import filled


def _class_counts() -> list[Column]:
    status = F.col("match_status")
    return [
        F.count("*").alias("total_count"),
        F.count_if(status == vocab.EXACT).alias("exact_match_count"),
        F.count_if(status == vocab.PARTIAL).alias("partial_match_count"),
        F.count_if(status == vocab.NOT_MATCHED).alias("not_match_count"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in vocab.SCORE_COLUMNS],
    ]


def _class_rates() -> dict[str, Column]:
    total = F.col("total_count")
    matched = F.col("exact_match_count") + F.col("partial_match_count")
    return {
        "match_rate": percent(matched, total),
        "exact_match_rate": percent(F.col("exact_match_count"), total),
        "partial_match_rate": percent(F.col("partial_match_count"), total),
        "not_match_rate": percent(F.col("not_match_count"), total),
    }


def match_stats(matches: DataFrame) -> DataFrame:
    source = F.col("correction_source")
    counted = matches.agg(
        *_class_counts(),
        F.count_if(source.isin(vocab.SOURCE_PICKED, vocab.SOURCE_EDITED)).alias("manual_correction_count"),
        F.count_if(source == vocab.SOURCE_PICKED).alias("manual_select_count"),
        F.count_if(source == vocab.SOURCE_EDITED).alias("manual_match_count"),
        F.count_if((source == vocab.SOURCE_AUTO) | source.isNull()).alias("auto_match_count"),
    )
    return counted.withColumns(
        {
            **_class_rates(),
            "manual_correction_rate": percent(F.col("manual_correction_count"), F.col("total_count")),
        }
    )


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*_class_counts()).withColumns(_class_rates())


def fill_stats(tagged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, and per field the rows that fill it and their share in percent."""
    counted = tagged.agg(
        F.count("*").alias("total_count"), *[F.count_if(filled(f)).alias(f"{f}_count") for f in fields]
    )
    return counted.withColumns({f"{f}_rate": percent(F.col(f"{f}_count"), F.col("total_count")) for f in fields})


def vector_profile(vectors: DataFrame) -> DataFrame:
    """Rows, smallest and largest dimension, columns, earliest write."""
    earliest = F.min("created_at") if "created_at" in vectors.columns else F.lit(None).cast("timestamp")
    return vectors.agg(
        F.count("*").alias("row_count"),
        F.min(F.size("vector")).alias("min_dim"),
        F.max(F.size("vector")).alias("max_dim"),
        earliest.alias("created_at"),
    ).withColumn("columns", F.lit(", ".join(f"{n} {t}" for n, t in vectors.dtypes)))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row tables as one row: stacked, then folded (no join)."""
    stacked = one_row[0]
    for table in one_row[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("row_count"))


def duplicate_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Per column: rows with a value minus distinct values.  One scan: every row gives a row per
    column, of which the value's hash travels, so long texts do not."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), F.sha2(F.col(c).cast("string"), 256)).alias("v")) for c in columns])
    each = df.select(F.inline(values)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    spare = F.sum(F.when(F.col("v").isNotNull(), F.col("n") - 1).otherwise(0))
    return each.groupBy("column_name").agg(spare.cast("long").alias("duplicate_count"))
